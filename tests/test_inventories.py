"""Inventories item by item: five states of sections, and every way in which an item can't be read."""

import json

from quillspark.operators import inventories as I

EMPTY = {key: [] for key in I.LISTS}
GOOD = {"heading": "1. A", "locator": "d:1-4", "passes": 2, "full_passes": 2, **EMPTY}


def made(spark, *sections, runs=2):
    raw = spark.createDataFrame([("d", json.dumps({"doc": "d", "runs": runs, "sections": list(sections)}))], "slug string, json string")
    return I.section_states(I.entries(raw)[0])


def test_sections_and_why_they_weren_t_read(spark):
    cases = [
        (GOOD, "read", None), (GOOD | {"passes": 1, "full_passes": 1}, "short", None), (GOOD | {"passes": 2, "full_passes": 1, "degraded": True}, "read", None),
        (GOOD | {"passes": 1, "full_passes": 0, "degraded": True}, "partial", None), ({"heading": "x", "error": "timeout"}, "unread", "extraction failed"), ({"error": "", "skipped": True}, "unread", "skipped without a reason"),
        ({"error": "over the\nlimit", "skipped": True}, "unread", "over the limit"), (None, "unread", "nothing is there"), ({}, "unread", "nothing is there"), (3, "unread", "it is a whole"), (["x"], "unread", "it is a list"),
        (GOOD | {"heading": -1}, "unread", "its heading is a whole"), (GOOD | {"locator": "a\nb"}, "unread", "its locator has a line break"), (GOOD | {"passes": True}, "unread", "its passes is a truth"),
        (GOOD | {"full_passes": 99}, "unread", "its counts of passes don't agree"), (GOOD | {"passes": 0, "full_passes": 0}, "unread", "no pass answered"), (GOOD | {"capabilities": None}, "unread", "its capabilities is a null"),
        ({k: v for k, v in GOOD.items() if k != "produces"}, "unread", "it has no produces"), (GOOD | {"degraded": "yes"}, "unread", "its degraded is a text"), (GOOD | {"deferred": 2}, "unread", "its deferred is a whole"),
        ({k: v for k, v in GOOD.items() if k != "passes"}, "unread", "one of its two counts of passes is missing"),
        ({k: v for k, v in GOOD.items() if "passes" not in k} | {"degraded": True, "consumes": [None, " "]}, "partial", None), ({k: v for k, v in GOOD.items() if "passes" not in k} | {"degraded": True, "consumes": [3]}, "read", None),
    ]
    got = made(spark, *[c[0] for c in cases]).orderBy("position").collect()
    assert [(r["state"], r["why"]) for r in got] == [c[1:] for c in cases]
    assert got[0]["heading"] == "1. A" and got[4]["heading"] == "x" and got[7]["locator"] == "" and got[0]["of"] == len(cases)


def test_items_are_kept_or_set_aside(spark):
    items = {
        "capabilities": ["ingests", {"name": "routes", "quote": "q"}, {"name": 3}, {}, None, "  ", 7], "consumes": ["a", {"name": " "}], "produces": [["x"]],
        "evidence_claims": [{"claim": "is assessed", "points_to": ["Section 2", "Appendix A"]}, {"claim": "x", "points_to": 4}, "bare", {"claim": "y", "points_to": None, "quote": 3}, {"points_to": "z"}],
        "authority": [{"capability": "c", "owner": "o", "polarity": "owns"}, {"capability": "c", "owner": ""}, {"capability": "c", "owner": "o", "polarity": "maybe"}, {"capability": "c", "owner": "o", "action": []}, {"capability": "c", "owner": "o", "polarity": None}],
        "defers_to": [{"capability": "c", "to": "hydrology"}, {"capability": "c", "to": {"x": 1}}],
    }
    out = I.inventory_items(made(spark, GOOD | items, GOOD, {"error": "x"} | EMPTY | {"produces": ["never"]}))
    got = {(r["list"], r["item"]): r for r in out.collect()}
    why = {k: r["why"] for k, r in got.items() if r["why"]}
    assert why == {
        ("capabilities", 3): "has a whole for its name", ("capabilities", 4): "has no name", ("capabilities", 7): "is a whole, not a mapping", ("consumes", 2): "has nothing in its name", ("produces", 1): "is a list, not a mapping",
        ("evidence_claims", 2): "has a whole for its points_to", ("evidence_claims", 3): "is a text, not a mapping", ("evidence_claims", 5): "has no claim", ("authority", 2): "has nothing in its owner",
        ("authority", 3): "has a polarity that isn't owns or excludes", ("defers_to", 2): "has a mapping for its to",
    }
    assert [got["capabilities", k]["name"] for k in (1, 2, 3)] == ["ingests", "routes", None] and got["capabilities", 2]["quote"] == "q" and len(got) == 20 and got["consumes", 1]["name"] == "a"
    assert got["evidence_claims", 1]["points_to"] == "Section 2 and Appendix A" and got["evidence_claims", 4]["quote"] is None and got["authority", 1]["polarity"] == "owns" and got["defers_to", 1]["to"] == "hydrology"
    assert {(r["list"], r["aside"]) for r in I.blurred(out).collect()} == {("capabilities", 3), ("consumes", 1), ("produces", 1), ("evidence_claims", 3), ("authority", 2), ("defers_to", 1)}


def test_what_is_no_inventory_is_refused(spark):
    raw = [("a", "{broken"), ("b", None), ("c", "[]"), ("d", '{"doc": "d"}'), ("e", '{"sections": 3}'), ("f", '{"sections": []}'), ("g", '{"sections": [null], "runs": "2"}')]
    good, bad = I.entries(spark.createDataFrame(raw, "slug string, json string"))
    assert {r["slug"]: r["reason"] for r in bad.collect()} == {"a": "not JSON", "b": "not JSON", "c": "a list", "d": "no sections", "e": "sections aren't a list"}
    assert [(r["slug"], r["runs"], r["state"]) for r in I.section_states(good).collect()] == [("g", None, "unread")]

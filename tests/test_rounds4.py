"""Findings of the fourth review, each by the smallest table that shows it."""

import json

from pyspark.sql import functions as F

from quillspark import catalogue

QUERIES = catalogue.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inventories_are_parsed_once(spark):
    from quillspark.operators import inventories as I

    entry = {"heading": "1", "locator": "d:1", "passes": 1, "full_passes": 1, **{key: [{"name": "n", "claim": "c", "capability": "k", "owner": "o"}, 7] for key in I.LISTS}}
    raw = spark.createDataFrame([("d", json.dumps({"runs": 1, "sections": [entry, {}, 3, {"x": 1}]})), ("e", "{"), ("f", "[]"), ("g", "{}"), ("h", '{"sections": 2}')], "slug string, json string")
    good, refused = I.entries(raw)
    states = I.section_states(good)
    assert plan_of(I.inventory_items(states)).count("parseJson") == 1
    assert [r["why"] for r in states.orderBy("position").collect()] == [None, "nothing is there", "it is a whole", "it has no heading"]
    assert {(r["slug"], r["reason"]) for r in refused.collect()} == {("e", "not JSON"), ("f", "a list"), ("g", "no sections"), ("h", "sections aren't a list")}
    got = I.inventory_items(states).groupBy("list").agg(F.count("*").alias("n"), F.count("why").alias("aside")).collect()
    assert {tuple(r) for r in got} == {(key, 2, 1) for key in I.LISTS}


def test_lines_are_not_copied_for_their_words(spark):
    from quillspark.operators import synthesis as S

    said = ["# Gate", "# Glossary", "drift, mass, gate", "the mass of it", "# Other", "flow: what passes", "A gauge", "means a reading", " ".join(f"w{k}" for k in range(300))]
    lines = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(said)], "slug string, line_no int, text string")
    terms = spark.createDataFrame([("d", t) for t in ("Gate", "mass", "flow", "gauge", "none at all", "w299", "!")], "slug string, term string")
    got = S.definitions(terms, lines)
    assert {r["term"]: r["defined"] for r in got.collect()} == {"Gate": "has its own heading", "mass": "glossary entry", "flow": "definition list entry", "gauge": "definition sentence", "none at all": None, "w299": None, "!": None}
    assert "explode(array_distinct(split" not in plan_of(got)


def test_a_text_is_hashed_once_for_its_vector(spark):
    import hashlib
    import math

    from quillspark.functions import text as T

    told = spark.createDataFrame([("",), ("a gate",), ("b",), (None,)], "t string").select("t", T.offline_vector(F.col("t")).alias("v"))
    assert plan_of(told).count("sha2(") == 1
    for r in told.collect():
        if r["t"] is None:
            assert r["v"] == [None] * 32
            continue
        raw = [b / 255.0 - 0.5 for b in hashlib.sha256(r["t"].encode()).digest()]
        total = 0.0
        for x in raw:
            total += x * x
        assert r["v"] == [x / math.sqrt(total) for x in raw]


def test_copies_are_matched_without_rounds(spark, monkeypatch):
    from quillspark.operators import attribution as B

    texts = ["the gate holds water", "the gate opens late", "a late reading of it"]
    rows = [(i, 200 - i if i % 7 else i, "ab"[i % 2], 10 + i if i % 5 == 0 else None, 12 + i if i % 5 == 0 else None, texts[i % 3] if i % 4 else None) for i in range(60)]
    defects = spark.createDataFrame(rows, "defect long, pos long, kind string, first int, last int, anchor string")
    found = [(i, i * 37 % 61, "ab"[i % 2]) for i in range(45)]
    told = [(i, texts[i % 3][: 14 + i % 7], None) for i in range(45)] + [(i, None, 10 + i) for i in range(0, 45, 3)]
    findings, evidence = spark.createDataFrame(found, "finding long, pos long, kind string"), spark.createDataFrame(told, "finding long, text string, line int")
    near = {}
    for d, f in B.reached(defects, findings, evidence).collect():
        near.setdefault(d, set()).add(f)
    place, taken, wanted = {f[0]: f[1] for f in found}, set(), set()
    for d in sorted(rows, key=lambda r: (r[1], r[0])):
        if free := sorted((place[f], f) for f in near.get(d[0], ()) if f not in taken):
            taken.add(free[0][1])
            wanted.add((d[0], free[0][1]))
    rounds, asked = B.match_in_order, []
    monkeypatch.setattr(B, "match_in_order", lambda *a: asked.append(1) or rounds(*a))
    for most, times in ((2_000_000, 0), (50, 1)):
        monkeypatch.setattr(B, "AT_ONCE", most, raising=False)
        asked.clear()
        assert {tuple(r) for r in B.attribution_scores(defects, findings, evidence)[0].collect()} == wanted and len(asked) == times

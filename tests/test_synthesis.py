"""Inventories, pointers, claims, sections and labels, by hand."""

import json

from pyspark.sql import functions as F

from quillspark.operators import synthesis as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def read_of(spark, *texts):
    docs = [(f"d{k}", i, t) for k, text in enumerate(texts) for i, t in enumerate(text, 1)]
    got = S.prose(spark.createDataFrame(docs, "slug string, line_no int, text string").repartition(5)).orderBy("slug", "line_no").collect()
    return [[r["text"] for r in got if r["slug"] == f"d{k}"] for k in range(len(texts))]


def test_prose_leaves_out_what_is_not_text(spark):
    first = "---\na: 1\n---\nOne\n```\ncode\n```\n<!-- x\ny -->\n<div>\nraw\n\nTwo".split("\n")
    second = ["````markdown", "```sh", "# no", "```", "````", "```twin``` is a span", "<pre>", "# no", "</pre> gone", "<pre>x</pre>", "   ~~~", "        ~~~", "~~~", "yes"]
    third = ["---", "open to the end", "<!-- one line -->", "<SCRIPT>", "x", "</script>", "~~~ a`b", "code", "~~~~  ", "# end"]
    assert read_of(spark, first, second, third) == [["One", "<div>", "raw", "", "Two"], ["```twin``` is a span", "<pre>x</pre>", "yes"], ["---", "open to the end", "<!-- one line -->", "# end"]]


def test_outline_nests(spark):
    docs = spark.createDataFrame([("d", "# 1. A\nx\n## 1.2 B\n```\n# no\n```\n### Deep\n# C #\n### Appendix B: D\n## E"), ("e", "no heading")], "slug string, text string")
    assert rows(S.outline(docs).select("line", "depth", "title", "end", "over_line", "kind", "number"), "line") == [
        (1, 1, "1. A", 7, None, "section", "1"), (3, 2, "1.2 B", 7, 1, "section", "1.2"), (7, 3, "Deep", 7, 3, None, None), (8, 1, "C", 10, None, None, None), (9, 3, "Appendix B: D", 9, 8, "appendix", "b"), (10, 2, "E", 10, 8, None, None)]


def test_heading_keys(spark):
    one = spark.range(1)
    assert [one.select(S.heading_key(F.lit(x))).first()[0] for x in ("## 03.1 Scope", "Open-Issues")] == ["3.1", "open issues"]


def test_malformed_inventories_are_refused_and_sections_told_apart(spark):
    good = {"doc": "d", "runs": 2, "sections": [
        {"heading": "A", "locator": "d:1-4", "full_passes": 2, "consumes": ["x"]}, {"heading": "B", "locator": "d:6-9", "error": "timeout"},
        {"heading": "C", "locator": "d:10-12", "degraded": True}, {"heading": "D", "locator": "d:13-14", "full_passes": 1}, {"heading": "E", "locator": "d:15-15", "skipped": True}]}
    raw = spark.createDataFrame([("a", json.dumps(good)), ("b", "[]"), ("c", "{broken"), ("e", '{"sections": 3}'), ("f", None)], "slug string, json string")
    read, refused = S.read_inventories(raw)
    assert {r["slug"] for r in read.collect()} == {"a"} and refused.count() == 4
    sections = S.sections_of(read)
    assert [r["state"] for r in sections.orderBy("position").collect()] == ["read", "unread", "partial", "short", "set aside"]
    assert tuple(S.shortfall(sections).first())[1:] == (5, 1, 1, 1, 1, 1)
    assert rows(S.left_out(sections).select("from", "to"), "from") == [(5, 5)]
    assert rows(S.flattened(sections, "consumes").select("heading", "item"), "heading") == [("A", "x")]


def test_sections_are_picked_and_followed(spark):
    heads = spark.createDataFrame([("8", "Fabric12", 1, 1), ("8", "Fabric", 20, 90), ("8.1", "Bus", 30, 40)], "number string, title string, line_no int, end int")
    wanted = spark.createDataFrame([("a", "8.10"), ("b", "8.1"), ("c", "9")], "id string, number string")
    assert rows(S.pick_sections(wanted, heads).select("id", "number", "line_no", "how"), "id") == [("a", "8", 20, "ancestor"), ("b", "8.1", 30, "exact")]
    old = spark.createDataFrame([("1", "Scope"), ("2", "Parts3"), ("3", "End")], "number string, title string")
    new = spark.createDataFrame([("1", "Scope"), ("4", "Parts")], "number string, title string")
    assert rows(S.follow_sections(old, new).select("old_number", "new_number", "how"), "old_number") == [("1", "1", "same"), ("2", "4", "moved"), ("3", None, "gone")]


def test_claims(spark):
    docs = spark.createDataFrame([("d", "The  bus carries every message it gets. End.")], "slug string, text string")
    claims = spark.createDataFrame([(1, "d", "the bus carries every message"), (2, "d", "short"), (3, "d", "the bus drops every message now")], "id int, slug string, quote string")
    assert rows(S.claim_quotes(claims, docs).select("id", "state"), "id") == [(1, "kept"), (2, "fragment"), (3, "dropped")]
    found = spark.createDataFrame([(1, "d", "The Buses", "carries messages", 1), (2, "d", "buses", "drops nothing", 9), (3, "d", "bus gates", "opens", 5)], "id int, slug string, subject string, predicate string, start int")
    assert rows(S.claim_pairs(found).select("a", "b", "rank"), "a") == [(1, 2, 1)]


def test_all_pairs_of_a_large_group_count(spark):
    n = 900  # the two unlike claims stand first and last, three blocks apart; the rest say the same
    said = [(i, "d", "bus", "opens gates" if i == 0 else "drops mail" if i == n - 1 else "opens gates, drops mail", i) for i in range(n)]
    found = S.claim_pairs(spark.createDataFrame(said, "id int, slug string, subject string, predicate string, start int"))
    got = rows(found.select("a", "b", "overlap", "rank"), "rank")
    assert got[0] == (0, n - 1, 0.0, 1) and len(got) == 12 and all(x[2] == 1.0 for x in got[1:])


def test_action_outcomes(spark):
    actions = spark.createDataFrame([(1, "Updated 3"), (2, "will update"), (3, "Added it"), (4, "Revised"), (5, "Changed"), (6, "Fixed? Corrected")], "id int, action string")
    changes = spark.createDataFrame([(1, "3", "substantive"), (4, "4", "missing"), (5, "5", "substantive"), (5, "6", "none"), (6, "7", "cosmetic")], "id int, section string, changed string")
    assert [r["outcome"] for r in S.action_check(actions, changes).orderBy("id").collect()] == ["SUPPORTED", "NO CLAIM", "NO SECTION", "SECTION MISSING", "MIXED", "DISPUTED"]


def inventory(spark):
    deferrals = spark.createDataFrame([
        (1, "a", "alert timing", "1.2 Inputs", "hydrology"), (2, "a", "timing of alerts", "2.1 x", "the alerting"), (3, "a", "alert timing", "3. Alerting", "sensor fabric"),
        (4, "b", "key rotation", "1. Parts", "hydrology"), (5, "a", "flood gates", "1. Sensor Fabric", "hydrology"), (6, "a", "log store", "1.1 y", "hydrology"),
    ], "id int, slug string, capability string, heading string, to string").withColumn("position", F.col("id"))
    sections = spark.createDataFrame([("a", 1, "1. Sensor Fabric"), ("a", 2, "2. Hydrology"), ("a", 3, "3. Alerting"), ("a", 4, "3. Other")], "slug string, position int, heading string")
    read = spark.createDataFrame([("a", True), ("b", False)], "slug string, complete boolean")
    owned = spark.createDataFrame([("a", 1, "store of logs and log index", "keeps", "archive", "owns"), ("a", 2, "store of logs and log index", "keeps all", "gateway", "owns"), ("b", 3, "x", "", "", "owns")], "slug string, id int, capability string, action string, owner string, polarity string").withColumn("position", F.col("id"))
    return deferrals, sections, read, owned


def test_gaps_go_round_or_have_no_owner(spark):
    deferrals, sections, read, owned = inventory(spark)
    got = rows(S.ownership_gaps(deferrals, owned, read, sections).select("slug", "label", "cycle", "status"), "slug", "label")
    assert got == [("a", "alert timing", "alerting -> fabric sensor -> hydrology -> alerting", "finding"), ("a", "flood gates", None, "finding"), ("b", "key rotation", None, "doubtful")]
    assert [r[1] for r in rows(S.ownership_gaps(deferrals, owned, read).select("slug", "label"), "slug", "label")] == ["alert timing", "flood gates", "key rotation"]


def test_dual_owners_by_concept(spark):
    owned = inventory(spark)[3]
    assert rows(S.dual_owners(owned).select("label", "action", "owners"), "label") == [("store of logs and log index", "keeps", 2)]
    vectors = spark.createDataFrame([("store of logs and log index", [1.0, 0.0]), ("keeps", [1.0, 1.0]), ("keeps all", [1.0, -1.0])], "label string, embedding array<double>")
    assert S.dual_owners(owned, vectors).count() == 0 and S.dual_owners(owned, vectors, object_identity=True).count() == 1


def test_outputs_that_nobody_takes(spark):
    produced = spark.createDataFrame([(1, "a", "run summary"), (2, "a", "summary of the run report"), (3, "a", "gate log"), (4, "b", "flow map")], "id int, slug string, value string").withColumn("position", F.col("id"))
    consumed = spark.createDataFrame([("a", "the run summary report"), ("a", "flow map")], "slug string, value string")
    read = spark.createDataFrame([("a", True), ("b", False)], "slug string, complete boolean")
    assert rows(S.unconsumed(produced, consumed, read).select("slug", "label", "status"), "slug") == [("a", "gate log", "finding"), ("b", "flow map", "doubtful")]


def test_labels(spark):
    controls = spark.createDataFrame([(1, i, i == 0) for i in range(5)] + [(2, 9, False)], "letter int, id int, positive boolean")
    assert rows(S.matched_controls(controls).select("id"), "id") == [(0,), (1,), (2,)]
    labels = spark.createDataFrame([(1, 0, "ok"), (1, 1, "bad"), (1, 2, "bad")], "id int, position int, label string")
    assert S.harshest(labels, ("ok", "bad")).first()["label"] == "bad"
    same = lambda a, b: spark.range(1).select(S.same_term(F.lit(a), F.lit(b))).first()[0]
    assert same("Alert Bus", "alert-bus") and not same("bus", "the big alert bus") and not same("bus", "busy")
    text = ["# The bus", "A gate is a", "door", "pump: moves water", "## Glossary", "Flow-meter counts", "# End", "valve is stored in y", "an outlet means", "x"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text, 1)] + [("e", 1, "bus is the thing")], "slug string, line_no int, text string")
    terms = spark.createDataFrame([("d", t) for t in ("Bus", "gate", "pump", "flow meter", "valve", "outlet", "?")] + [("e", "bus"), ("e", "gate")], "slug string, term string")
    assert {(r["slug"], r["term"]): r["defined"] for r in S.definitions(terms, lines).collect()} == {
        ("d", "Bus"): "has its own heading", ("d", "gate"): "definition sentence", ("d", "pump"): "definition list entry", ("d", "flow meter"): "glossary entry", ("d", "valve"): None, ("d", "outlet"): "definition sentence", ("d", "?"): None,
        ("e", "bus"): "definition sentence", ("e", "gate"): None}


def test_letters_keep_their_last_comment_apart(spark):
    from quillspark.operators import sections as P

    letter = ["Dear Ms. Doe:", "1.  First comment about", "18. Please revise it.", "2.  Second one.", "3.  Third. We reissue it.", "We remind you that you are responsible.", "Sincerely, Mr. Wong"]
    rows_ = [("a", i, t) for i, t in enumerate(letter)] + [("b", i, t) for i, t in enumerate([*letter[:5], "Please contact us. We reissue prior comment 4."])]
    got = {(r["slug"], r["number"]): r["body"] for r in P.letter_outline(spark.createDataFrame(rows_, "slug string, line_no int, text string")).collect()}
    assert got["a", 1] == "First comment about 18. Please revise it." and got["a", 3] == "Third. We reissue it."
    assert got["b", 3] == "Third. We reissue it. Please contact us. We reissue prior comment 4."


def test_rulings_of_other_letters_and_titles(spark):
    from quillspark.operators import sections as P

    said = [
        ("a", 1, "2023-11-29", "We note your response to prior comment 5 of our letter dated November 29, 2023. We reissue it in part."),
        ("a", 2, "2023-11-29", "See prior comment 9 of our letter dated March 14, 2023. Please revise."), ("a", 3, "2023-11-29", "In response to comment 7, you say that Mr. Wong left. We resissue the comment in its entirety."),
        ("a", 4, "2023-11-29", "We note prior comments six and 8. Tell us why the audit report was reissued."), ("a", 5, "2023-11-29", "We reissue prior comment 3 of our letter dated March 14, 2023. Prior comment 1 is noted."),
    ]
    got = P.rulings(spark.createDataFrame(said, "slug string, number int, first string, body string"))
    assert {r["prior"]: r["verdict"] for r in got.collect()} == {5: "partial", 7: "not_addressed", 6: "addressed", 8: "addressed", 1: "addressed"}


def test_a_table_goes(spark):
    from quillspark.operators import sections as P

    text = ["## A", "", "| a | b |", "|---|---|", "| 1 | 2 |", "after", "| other |", "## B", "", "| b |"]
    got = P.without_table(spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "slug string, line_no int, text string"), "## A", "Gone.")
    assert [r["text"] for r in got.orderBy("line_no").collect()] == ["## A", "", "Gone.", "after", "| other |", "## B", "", "| b |"]


def test_what_two_runs_differ_in(spark):
    schema = "obligation string, verdict string, quote string"
    a = spark.createDataFrame([("1", "met", "x "), ("2", "met", "y"), ("3", "unmet", ""), ("4", "met", "z")], schema)
    b = spark.createDataFrame([("1", "met", "x"), ("2", "met", "other"), ("3", "partial", None), ("5", "met", "z")], schema)
    told, deltas = S.run_diff(a, b, ("unmet", "partial", "met"))
    assert tuple(told.first()) == (3, 2, 1, 1, 1, 1) and rows(deltas, "place") == [(1, "unmet", 1, 0, -1), (2, "partial", 0, 1, 1), (3, "met", 3, 3, 0)]
    scores = S.absence_scores(spark.createDataFrame([("unmet", True), ("partial", True), ("unmet", False), ("met", False), (None, False)], "verdict string, absent boolean")).first()
    assert tuple(scores) == (1, 1, 1, 2, 0.6, 0.5, 0.5)


def test_open_questions(spark):
    from quillspark.functions import text as T

    runs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((1, 1), (3, 5), (7, 8), (20, 29))])
    parts = F.array(*[F.struct(F.lit(h).alias("heading"), F.lit("d:1").alias("locator")) for h in "abcd"])
    key = lambda k, n: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("number"))
    names = lambda *x: F.array(*[F.lit(y) for y in x])
    got = spark.range(1).select(
        T.line_question(runs, "could own it"), T.open_question(parts, "unread"), T.spelled(key("section", "3.1")), T.spelled(key("appendix", "b")),
        T.numbers_sections(F.lit("9"), names("1", "2")), T.numbers_sections(F.lit("3.7"), names("3.1")), T.numbers_sections(F.lit("3"), names("3", "9")),
    ).first()
    assert list(got) == ["a line that is in no section could own it: 1, 3-5, 7-8, and 10 more", "unread: a (d:1); b (d:1); c (d:1); and 1 more", "3.1", "Appendix B", True, True, False]

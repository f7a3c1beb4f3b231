"""Operators against answers that were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scale import COVERAGE, REVIEW, worst
from quillspark.operators import aggregates as A
from quillspark.operators import closure as C
from quillspark.operators import graph as G
from quillspark.operators import joins as J
from quillspark.operators import lines as L
from quillspark.plans import review
from quillspark.provider import Offline, ask_all


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


DOC = "Preface\n\n1 Scope\nThe bus SHALL log.\nIt MAY print.\n1.1 Parts\nNothing.\n2 End\nSee Section 9 and Appendix B."


def test_lines_and_cuts(spark):
    docs = spark.createDataFrame([("a", DOC), ("e", ""), ("n", None), ("t", "x\ny\n")], "slug string, text string")
    lines = L.to_lines(docs)
    assert lines.filter("slug = 'a'").count() == 9 and lines.filter("slug = 't'").count() == 2 and lines.filter("slug in ('e', 'n')").count() == 0
    chunks = rows(L.cut_documents(docs, L.CHUNKS).filter("slug = 'a'").select("heading", "start", "end"), "start")
    assert chunks == [("(front matter)", 1, 2), ("1 Scope", 3, 5), ("1.1 Parts", 6, 7), ("2 End", 8, 9)]
    assert L.unread(lines, L.cut_documents(docs, L.SECTIONS)).count() == 0
    targets = rows(L.unresolved_targets(lines.filter("slug = 'a'")).select("target", "uses", "first_line"), "target")
    assert targets == [("Appendix B", 1, 9), ("Section 9", 1, 9)]


def test_a_cut_is_lossless_for_sections_and_capped():
    body = [f"line {i}" for i in range(200)]
    parts = L.cut_lines(body, L.SECTIONS)
    assert "\n".join(t for *_, t in parts).split("\n") == body
    assert all(e - s + 1 <= 90 for _, s, e, _ in parts)
    # two headings in a row: chunks drop the first, sections keep it
    two = ["1 One", "2 Two", "text"]
    assert [h for h, *_ in L.cut_lines(two, L.CHUNKS)] == ["2 Two"]
    assert L.cut_lines(two, L.SECTIONS) == [("1 One", 1, 3, "2 Two\ntext")]


def test_headings_end_before_the_next_that_is_not_deeper(spark):
    lines = L.to_lines(spark.createDataFrame([("a", DOC)], "slug string, text string"))
    assert rows(L.headings(lines).select("number", "title", "line_no", "end"), "line_no") == [("1", "Scope", 3, 7), ("1.1", "Parts", 6, 7), ("2", "End", 8, 9)]


def test_requirement_candidates_join_lines_and_stems(spark):
    text = "1 Scope\nThe system SHALL\nlog. It MAY also print; Users MUST NOT wait.\n\nThe Architecture shall include:\n(a) a bus;\n(b) a store\n   with a log.\n\n2 End"
    found = L.candidates(spark.createDataFrame([(1, text)], "slug int, text string"))
    assert rows(found.select("section", "line", "modality_hint", "raw"), "line", "raw") == [
        ("1 Scope", 2, "SHALL", "The system SHALL log."), ("1 Scope", 3, "MAY", "It MAY also print;"), ("1 Scope", 3, "MUST NOT", "Users MUST NOT wait."),
        ("1 Scope", 6, "SHALL", "The Architecture shall include: a bus;"), ("1 Scope", 7, "SHALL", "The Architecture shall include: a store with a log."),
    ]


def test_what_ends_a_stem_and_a_paragraph(spark):
    text = "\n".join([
        "It shall have:", "1. one", "", "2. two", "plain that goes on", "", "Users MUST look. MAY be", "| a SHALL | table |", "R-12 The end SHALL come", "# Part", "(a) SHALL stand alone",
        "They should give:", "no item SHALL open this", "(b) SHALL be prose", "It may show:", "## Next", "(c) never MUST", ""])
    got = rows(L.candidates(spark.createDataFrame([(1, text)], "slug int, text string")).select("line", "section", "ref", "modality_hint", "raw", "stem_line"), "line", "raw")
    front = "(front matter)"
    assert got == [
        (2, front, None, "SHALL", "It shall have: one", 1), (4, front, None, "SHALL", "It shall have: two plain that goes on", 1),
        (7, front, None, "MAY", "MAY be", None), (7, front, None, "MUST", "Users MUST look.", None), (9, front, "R-12", "SHALL", "R-12 The end SHALL come", None),
        (11, "Part", None, "SHALL", "(a) SHALL stand alone", None), (13, "Part", None, "SHALL", "no item SHALL open this (b) SHALL be prose", None), (17, "Next", None, "MUST", "(c) never MUST", None),
    ]


def test_headings_end_before_the_next_of_their_depth(spark):
    text = ["1 A", "x", "1.1 B", "1.1.1 C", "y", "1.2 D", "2 E", "z"]
    got = L.headings(spark.createDataFrame([(1, n, x) for n, x in enumerate(text, 1)], "slug int, line_no int, text string"))
    assert rows(got.select("number", "end"), "line_no") == [("1", 6), ("1.1", 5), ("1.1.1", 5), ("1.2", 6), ("2", 8)]


@pytest.mark.parametrize(
    ("answers", "wanted"),
    [(["met", "met"], "AGREE"), (["met", "partial"], "ADJACENT"), (["met", "unmet"], "DISAGREE"), (["met", "unverifiable"], "UNRANKABLE"), (["unverifiable", "unverifiable"], "AGREE"), (["", ""], "UNRANKABLE"), (["", "met"], "AGREE")],
)
def test_agreement(spark, answers, wanted):
    df = spark.createDataFrame([(1, a) for a in answers], "id int, verdict string")
    assert A.agreement(df).first()["agreement"] == wanted


def test_scales(spark):
    df = spark.createDataFrame([("met", "unmet"), ("met", "unverifiable"), ("partial", None)], "a string, b string")
    assert rows(df.select(COVERAGE.pair(F.col("a"), F.col("b")), COVERAGE.distance(F.col("a"), F.col("b"))), F.col("a"), F.col("b").desc())[0] == ("UNRANKABLE", 9)
    assert [one(spark, x, REVIEW.coerce) for x in ("Not Addressed", " Not_Addressed\n", "mostly", "")] == ["unclear", "not_addressed", "unclear", "unclear"]
    v = lambda *own: spark.createDataFrame([(i, x) for i, x in enumerate(own)], "p int, v string").agg(worst(F.col("v"), F.col("p"))).first()[0]
    assert v("met", "unmet", "partial") == "unmet" and v("not_applicable", "met") == "not_applicable" and v("not_applicable", "partial") == "partial" and v("met", "not_applicable") == "met"


def test_closure_states(spark):
    old = spark.createDataFrame([(1, "flood model v1"), (2, "a  pump"), (3, "gate open"), (4, "same line")], "line_no int, text string")
    new = spark.createDataFrame([(1, "flood model v2"), (2, "a pump"), (5, "siren new"), (9, "same line")], "line_no int, text string")
    names = {1: "flood model", 2: "pump", 3: "gate", 4: "siren", 5: "nothing", 6: "same"}
    terms = spark.createDataFrame(list(names.items()), "id int, term string")
    findings = spark.createDataFrame([(i, i == 5) for i in range(1, 8)], "id int, absence boolean")
    got = {r["id"]: (r["state"], r["detail"]) for r in C.closure(findings, terms, old, new).collect()}
    assert got == {1: ("CHANGED", "+1 -1"), 2: ("UNCHANGED", "reformatted only"), 3: ("REMOVED", None), 4: ("ADDED", None), 5: ("STILL ABSENT", None), 6: ("UNCHANGED", None), 7: ("NO TERMS", None)}
    assert C.closure(findings, terms, old, new, too_broad=0).filter("state = 'TOO BROAD'").count() == 5


def test_scalars(spark):
    assert one(spark, " a \t b ", T.fold) == "a b"
    assert one(spark, "Platform-Adapter!", T.loose) == "platform adapter"
    assert one(spark, "03.1", T.plain_number) == "3.1" and one(spark, "3.0", T.plain_number) == "3"
    assert one(spark, "March 13, 2024", T.iso_date).isoformat() == "2024-03-13"
    assert tuple(one(spark, "doc-v1:67-90", T.locator)) == ("doc-v1", 67, 90) and tuple(one(spark, "d:6", T.locator)) == ("d", 6, 6)
    assert one(spark, "AA", T.column_number) == 27
    assert [spark.range(1).select(T.column_letters(F.lit(n))).first()[0] for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    assert one(spark, "banana bandana", lambda x: T.occurrences(x, "ana")) == 2
    assert one(spark, "we will update it", lambda x: T.is_claim(x)) is False and one(spark, "Updated section 3", lambda x: T.is_claim(x)) is True
    assert [one(spark, x, lambda c: T.citation(c, F.lit(100))) for x in ("67", "5–9", "90-120", "1-61", "x")] == ["ok", "ok", "outside", "too wide", "not a range"]
    assert one(spark, "Users must log in (yes) [no]", T.without_brackets) == "Users must log in"


def test_cycles_are_found_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("d", "a")], "src string, dst string")
    assert sorted(tuple(r["nodes"]) for r in G.cycles(edges).collect()) == [("a", "b"), ("a", "b", "c")]


def test_greedy_groups_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (1, "b", 1, [0.0, 1.0]), (1, "c", 2, [0.8, 0.8])], "grp int, id string, position long, embedding array<double>")
    assert [r["cluster"] for r in G.greedy_groups(df, threshold=0.6).orderBy("position").collect()] == [0, 1, 0]


def test_absence_is_only_said_of_a_complete_source(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, slug string")
    right = spark.createDataFrame([(1,)], "id int")
    complete = spark.createDataFrame([("a", True), ("b", False)], "slug string, complete boolean")
    assert [r["status"] for r in review.absent(left, right, ["id"], complete).orderBy("id").collect()] == ["present", "absent", "unverifiable", "unverifiable"]


def test_absence_gate_takes_the_rarest(spark):
    df = spark.createDataFrame([("o", "flood", 5), ("o", "model", 3), ("o", "rare", 0), ("p", "only", 99)], "id string, word string, hits long")
    assert rows(A.absence_gate(df), "id") == [("o", "contested", "modelx3, floodx5"), ("p", "clear", None)]


def test_overlapping_spans_meet_once(spark):
    a = spark.createDataFrame([(1, 0, 300), (1, 400, 401)], "k int, a_first long, a_last long")
    b = spark.createDataFrame([(1, 100, 250), (1, 300, 300), (1, 302, 399)], "k int, b_first long, b_last long")
    assert rows(J.overlapping(a, b, "k", 10).select("a_first", "b_first"), "a_first", "b_first") == [(0, 100), (0, 300)]


def test_provider_asks_once_and_keeps_failures(spark):
    class Flaky(Offline):
        def ask(self, system, user):
            if "bad" in user:
                raise ConnectionError("no")
            return super().ask(system, user)

    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", "bad")], "id int, system string, user string")
    got = {r["id"]: (r["answer"], r["status"]) for r in ask_all(prompts, Flaky()).collect()}
    assert got[1] == got[2] and got[1][1] == "ok" and got[3] == (None, "failed")


def test_coverage_leaves_permissive_rows_unjudged(spark):
    docs = spark.createDataFrame([("d", DOC)], "slug string, text string")
    obligations = spark.createDataFrame([("1", "SHALL", "the bus logs everything"), ("2", "MAY", "printing")], "id string, modality string, text string")
    got = {r["id"]: r["verdict"] for r in review.coverage(obligations, docs, Offline(("met",))).collect()}
    assert got == {"1": "met", "2": "not_applicable"}


def test_review_runs_end_to_end(spark):
    old = spark.createDataFrame([("d", DOC)], "slug string, text string")
    new = spark.createDataFrame([("d", DOC.replace("2 End", "3 Close"))], "slug string, text string")
    findings = spark.createDataFrame([(1, False)], "id int, absence boolean")
    terms = spark.createDataFrame([(1, "behaviour"), (1, "bus")], "id int, term string")
    lexicon = spark.createDataFrame([("behaviour", "behavior")], "term string, variant string")
    out = review.review(old, new, findings, terms, lexicon, terms.select("term"))
    assert out["drift"].first()["state"] == "edited"
    assert rows(out["headings"], "heading") == [("2 End", "removed"), ("3 Close", "added")]
    assert out["closure"].first()["state"] == "UNCHANGED"
    assert {r["term"]: r["uses"] for r in out["vocabulary"].collect()} == {"behaviour": 0, "bus": 1}


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_ranks_do_not_depend_on_partitions(spark, partitions):
    df = spark.createDataFrame([("c", i, i, "unmet" if i % 2 else "partial") for i in range(20)], "cluster string, position int, id int, verdict string")
    got = A.clusters(df.repartition(partitions)).first()
    assert (got["lead"], got["size"], got["rank"]) == (1, 20, 1) and abs(got["strength"] - 16.0) < 1e-9


def test_nearest_passages_of_the_whole_set(spark, tmp_path):
    import numpy as np

    from quillspark.plans.queries import QUERIES

    v = np.random.default_rng(3).normal(size=(130, 8)).astype(np.float32)
    v[7] = v[5]  # a tie: the later one first
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    w = v.astype(np.float64)
    cos = np.round(w @ w.T / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1)), 6)
    wanted = {(q, i, rank + 1) for q in range(0, 130, 20) for rank, i in enumerate(sorted(range(130), key=lambda i: (-cos[q, i], -i))[:12])}
    got = QUERIES["f22_nearest_passages"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == wanted and len(got) == len(wanted)


def test_candidates_come_from_all_documents_and_whole_texts(spark, tmp_path):
    from quillspark.catalogue import queries

    late = "1 Scope\n" + "Plain words come first here. " * 5 + "\n\nThe gate SHALL close at night.\n"
    spark.createDataFrame([(1, late), (2, late), (3, "Nothing is asked.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["d15_requirement_candidates"](spark, str(tmp_path)).collect()
    assert {r["slug"] for r in got} == {1, 2} and all("gate SHALL close" in r["raw"] for r in got)


def test_gate_counts_inside_words_and_variants(spark):
    from quillspark.plans import review

    docs = spark.createDataFrame([(1, "Floods flooded the FLOODPLAIN; aaaaaaa"), (2, "A storm surge. storm\nsurge")], "slug int, text string")
    words = spark.createDataFrame([(1, "flood"), (1, "surge"), (1, "aaaaa"), (2, "absent")], "id int, word string")
    lexicon = spark.createDataFrame([("surge", "storm surge"), ("absent", "plain")], "term string, variant string")
    got = {r["word"]: r["hits"] for r in review.gate_hits(words, docs, lexicon).collect()}
    assert got == {"flood": 3, "surge": 3, "aaaaa": 1, "absent": 1}


@pytest.mark.parametrize("how", ["lexical", "dense", "section"])
def test_coverage_by_each_retrieval(spark, how):
    from quillspark.plans import review
    from quillspark.provider import Offline

    obligations = spark.createDataFrame([("a", "SHALL", "gates close at night", "x"), ("b", "may", "gates open", "x"), ("c", "SHALL", "zebra", "y")], "id string, modality string, text string, scope string")
    docs = spark.createDataFrame([(1, "# Gates\nThe gates close.\n# Night\nAt night all is dark.")], "slug int, text string")
    got = {r["id"]: r for r in review.coverage(obligations, docs, Offline(("unmet",)), how=how, least_hits=1, screen=Offline(("contributes",))).collect()}
    assert got["a"]["verdict"] == "unmet" and got["a"]["gate"] == "contested" and got["a"]["evidence"] == "closex1, gatesx2, nightx2"
    assert got["b"]["verdict"] == "not_applicable" and got["b"]["gate"] is None and got["c"]["gate"] == "clear"
    assert [r["id"] for r in review.coverage(obligations, docs, Offline(), scope="y").collect()] == ["c"]
    with pytest.raises(ValueError, match="seen: x, y"):
        review.coverage(obligations, docs, Offline(), scope="z")


def test_places_over_a_whole_table(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(6)
    got = A.ranked(df, [F.col("k").desc(), F.col("id")], "place").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and sorted(r["place"] for r in got) == list(range(1, 1001))


def test_parts_cut_by_the_table_function(spark):
    import random

    rnd = random.Random(21)
    stock = ["# Head", "2 Two", "Appendix B", "", "  ", "text " * 30, "words", "3.1 Part", "Annex"]
    texts = {f"d{i}": "\n".join(rnd.choice(stock) for _ in range(rnd.randrange(0, 300))) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "slug string, text string")
    for rule in (L.CHUNKS, L.WINDOWS, L.SECTIONS):
        wanted = sorted(map(tuple, L.cut_documents(docs, rule).collect()))
        assert sorted(map(tuple, L.cut_table(L.to_lines(docs).repartition(7), rule).collect())) == wanted and len(wanted) > 12


def test_one_long_document_is_cut_as_it_comes(spark):
    long = spark.range(300_000).select(F.lit("d").alias("slug"), (F.col("id") + 1).alias("line_no"), F.lit("a line").alias("text"))
    got = L.cut_table(long, L.CHUNKS).agg(F.count("*"), F.max("end"), F.max("chunk_id"), F.max(F.col("end") - F.col("start"))).first()
    assert tuple(got) == (5000, 300_000, 4999, 59)

"""Findings of the fifth review, each by the smallest table that shows it."""

from pyspark.sql import functions as F

from quillspark.operators import joins as J


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_expanded_before_they_meet_their_rows(spark):
    lexicon = spark.createDataFrame([("red", "Crimson"), ("red", "crimson"), ("red car", "auto"), ("big", "red")], "term string, variant string")
    terms = spark.createDataFrame([(1, "Red car"), (2, "red CAR"), (3, "big red"), (3, "red red"), (3, "red red"), (4, None), (4, "x"), (5, "none")], "id int, term string")
    got = J.expand_terms(terms, lexicon)
    assert sorted((r["id"], r["term"] or "") for r in got.collect()) == [
        (1, "auto"), (1, "crimson car"), (1, "red car"), (2, "auto"), (2, "crimson car"), (2, "red car"),
        (3, "big crimson"), (3, "big red"), (3, "crimson red"), (3, "red crimson"), (3, "red red"), (4, ""), (4, "x"), (5, "none"),
    ]
    # rows of ids with one term come out as they are: no aggregate stands over them
    assert plan_of(got).startswith("Union")


def test_groups_of_rows_are_not_sent_through_the_driver(spark):
    from quillspark.operators import graph as G

    rows = spark.createDataFrame([("g", i, i, [1.0, float(i % 2)]) for i in range(6)], "grp string, id long, position long, embedding array<double>")
    got = G.greedy_groups(rows, threshold=0.9)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    assert plan_of(got).count("strategy=merge") >= 2


def test_a_block_holds_a_byte_a_pair(spark):
    import tracemalloc

    import numpy as np

    from quillspark.operators import graph as G

    u = G.units(np.random.default_rng(0).normal(size=(2048, 8)).tolist())
    tracemalloc.start()
    near = G._near(u, u, 0.6)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.nbytes == 2048 * 2048 and most < 4 * near.nbytes
    assert (near == (u @ u.T >= 0.6)).all()


def test_phrases_work_out_the_words_of_a_line_once(spark):
    from quillspark.operators import lines as L

    said = ["The Big cat-food's box", "big cat-food's BOX of big", "# Big cat", "the big"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(said)], "slug string, line_no int, text string")
    got = L.phrases(lines, ("the",), 2)
    assert {tuple(r) for r in got.collect()} == {("d", "big cat-food's", 2), ("d", "cat-food's box", 2), ("d", "big cat-food's box", 2)}
    # once for the lines and once for their headings
    assert plan_of(got).count("regexp_extract_all") == 2


def test_words_of_documents_are_not_shuffled(spark):
    from quillspark import catalogue

    plan = plan_of(catalogue.queries()["i05_first_seen"](spark, "/root/testdata/sf0.001"))
    assert plan.index("Generate posexplode") < plan.index("RepartitionByExpression [doc_id")


def test_windows_do_not_copy_the_words_of_their_text(spark):
    from quillspark.operators import closure as C

    digest = lambda x: F.sha2(F.lit(x), 256)
    denied = spark.range(1).select(F.inline(F.array(F.struct(F.lit(2).alias("n"), digest("a b").alias("digest")), F.struct(F.lit(3).alias("n"), digest("b a b").alias("digest")))))
    docs = spark.createDataFrame([("d", "A b, a B"), ("e", "a"), ("f", None), ("g", "b a")], "slug string, text string")
    got = C.denied_phrases(docs, denied)
    assert sorted((r["slug"], r["n"], r["hits"]) for r in got.collect()) == [("d", 2, 2), ("d", 3, 1)]
    # windows are exploded, not the places where they begin
    assert "explode(sequence(" not in plan_of(got)


def test_bare_pointers_are_told_in_two_passes(spark):
    from quillspark.operators import pointers as P

    asked = {"Section 5.2 to 5.5": True, "Appendices B, C and F; Annex 3": True, "1 OR (2)": True, "": True, None: True, "1\u0085": True, "see Section 5": False, "Table 4": False, "Section 4 onwards": False, "REQ-12": False, "1 \x01\x02\x03": False, "1 android": False}
    df = spark.createDataFrame([(x,) for x in asked], "t string").select("t", P.bare(F.col("t")).alias("bare"))
    assert {r["t"]: r["bare"] for r in df.collect()} == asked
    # no array of tokens is made
    assert "transform" not in plan_of(df)


def test_readings_of_a_row_are_counted_where_they_are(spark):
    from quillspark.operators import cells as K

    labelled = spark.createDataFrame([(i, c, "addressed" if c in "AB" else "not_addressed") for i, c in enumerate("AABBCCDD")], "id long, cell string, verdict string")
    said = [("m", i, "addressed") for i in range(8)] + [("m", 0, "partial"), ("n", 1, "addressed"), ("n", 2, None), ("n", 99, "addressed")]
    got = K.cell_rates(labelled, spark.createDataFrame(said, "model string, id long, verdict string"), 2)
    told = {r["model"]: (r["covered"], round(r["a"], 6), r["b"], r["c"], r["d"]) for r in got.collect()}
    assert told == {"m": (8, 0.666667, 1.0, 0.0, 0.0), "n": (2, 1.0, 0.0, 0.0, 0.0)}
    assert "distinct" not in plan_of(got).lower() and "RepartitionByExpression [id" in plan_of(got)


def test_passages_are_not_shuffled_once_a_question(spark):
    from quillspark.plans.review import screened

    class Says:
        name = "says"

        def ask(self, system, user):
            return "discharges" if "yes" in user else "contributes" if "some" in user else "none"

    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "yes")], "id int, text string")
    chunks = spark.createDataFrame([(10, "some"), (11, "yes"), (12, "some"), (13, None), (14, "yes")], "chunk_id int, text string")
    got = screened(asked, chunks, Says(), 3)
    once = [(11, 1), (14, 2), (10, 3)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()) == sorted([(q, c, r) for q in (1, 2) for c, r in once] + [(3, c, i + 1) for i, c in enumerate((10, 11, 12))])
    assert "first(user" not in plan_of(got)

"""Findings of the sixth review, each by the smallest table that shows it."""

import re

from pyspark.sql import functions as F

from quillspark.operators import joins as J
from quillspark.operators import lines as L


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_added_where_terms_are_counted(spark):
    queries = spark.createDataFrame([(1, "gate flood gate the"), (2, "storm")], "query_id int, text string")
    chunks = spark.createDataFrame([("a", "Gate gate gate the flood"), ("b", "flood, the the"), ("b", "flood"), ("c", None), ("d", "none")], "chunk_id string, text string")
    got = J.lexical_scores(queries, chunks)
    n = 5
    wanted = {(1, "a"): 2 * (n / 2) ** 0.5 + (n / 3) ** 0.5, (1, "b"): (n / 3) ** 0.5}
    assert {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in wanted.items()}
    plan = plan_of(got)
    # neither pairs of a query and a chunk nor pairs of a chunk and a term are dealt again
    assert re.search(r"hashpartitioning\(chunk_id#\d+, \d+\)", plan) and not re.search(r"hashpartitioning\((query_id#\d+, chunk_id|chunk_id#\d+, [a-z])", plan)


def test_passages_are_found_by_a_run_inside(spark):
    texts = ["The gate-house, 12 feet", "gate-house", "a he gate-house, 12 feeta", "", None, "ab ab", "x\ny", "é gate é", "THE GATE-HOUSE, 12 FEET"]
    said = ["he gate-house, 12 fee", "gate-house", "", "ab", "b a", "\n", "é gate é", " gate", "gate-house, 12", None, "zzz yyy xxx", "ab ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    passages = spark.createDataFrame(list(enumerate(said)), "query_id int, passage string")
    got = sorted((r["doc_id"], r["query_id"]) for r in J.holding(docs, passages).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(said) if t is not None and p is not None and p in t)


def test_recall_looks_for_few_passages_in_a_text(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    spark.createDataFrame([(i, f"word{i} inner{i} thing{i}.") for i in range(30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"Some word{i} inner{i} thing{i}. more") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["g19_recall_at_k"](spark, str(tmp_path))
    assert sorted((r["query_id"], r["found"], r["wanted"]) for r in got.collect()) == [(i, 1, 1) for i in range(30)]
    # every passage meets every text in no join
    assert not any("NestedLoopJoin" in x and "Contains" in x for x in plan_of(got).splitlines())


def test_lines_are_cut_at_every_mark_by_a_literal(spark):
    texts = ["a\r\nb\rc\n\n", "\r\r\n", "\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "a\x1fb c", "\r\n\r\n", "a\n\r", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "slug int, text string")
    got = {}
    for r in sorted(L.to_lines(docs).collect()):
        got.setdefault(r["slug"], []).append(r["text"])
    assert got == {0: ["a", "b", "c", ""], 1: ["", ""], 2: [""], 3: list("abcdefgh"), 4: ["a\x1fb c"], 5: ["", ""], 6: ["a", ""]}
    assert [r["line_no"] for r in L.to_lines(docs.filter("slug = 0")).orderBy("line_no").collect()] == [1, 2, 3, 4]
    # a split by a pattern of several marks costs three times the time
    plan = L.to_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "|[" not in plan


def test_modal_sentences_come_out_of_one_reading(spark):
    text = "AB-12 Gates and\ndoors SHALL\nclose. They MAY NOT\topen; Then (all)\n(is) well. It\nMUST\n\nThe keeper shall:\n(a) watch the gate\nat night\n(b) sleep.\n\nNothing.\nIt SHOULD be\n# SHALL not\nIS REQUIRED; x.\nIt is"
    got = L.candidates(spark.createDataFrame([(1, text), (2, "no word of it\nat all: none")], "slug int, text string"))
    rows = {(r["line"], r["ref"], r["section"], r["modality_hint"], r["raw"], r["stem_line"]) for r in got.collect()}
    front = "(front matter)"
    assert rows == {
        (1, "AB-12", front, "SHALL", "AB-12 Gates and doors SHALL close.", None), (3, "AB-12", front, "MAY NOT", "They MAY NOT\topen;", None), (4, "AB-12", front, "MUST", "It MUST", None),
        (8, None, front, "SHALL", "The keeper shall: watch the gate at night", 7), (10, None, front, "SHALL", "The keeper shall: sleep.", 7),
        (13, None, front, "SHOULD", "It SHOULD be", None), (15, None, "SHALL not", "SHALL", "IS REQUIRED; x.", None),
    }
    # one shuffle of the texts, no join, no second reading for the items under stems
    plan = plan_of(got).split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan


def test_texts_without_a_modal_word_are_not_cut(spark):
    got = L.candidates(spark.createDataFrame([(1, "Plain words. They\nmay open"), (2, "The gate\nMUST close")], "slug int, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # the filter stands below the shuffle of texts and the cutting of lines
    assert "RLIKE" in plan.split("RepartitionByExpression")[1].upper().replace("REPARTITIONBYEXPRESSION", "") and "Generate" not in plan.split("RepartitionByExpression")[1]
    assert [(r["slug"], r["line"], r["raw"]) for r in got.collect()] == [(2, 1, "The gate MUST close")]


def test_the_best_chunks_of_each_query_come_by_blocks(spark, monkeypatch):
    import random

    from quillspark.operators import aggregates as A

    rnd = random.Random(9)
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    queries = spark.createDataFrame([(f"q{i}", text(9)) for i in range(23)], "query_id string, text string")
    chunks = spark.createDataFrame([(f"{i // 3}:{i % 3}", rnd.choice([text(12), "wax wbx", None])) for i in range(900)] + [("7:1", "wax wax wcx")], "chunk_id string, text string")
    monkeypatch.setattr(J, "BLOCK_CHARS", 4000)
    best = lambda scored: {(r["query_id"], r["chunk_id"], r["rank"]) for r in A.top_with_rest(scored.withColumn("score", F.round("score", 6)), ["query_id"], [F.col("score").desc(), F.col("chunk_id").desc()], 5).collect()}
    got = J.lexical_top(queries, chunks, 5)
    assert best(got) == best(J.lexical_scores(queries, chunks)) and got.count() < 23 * 5 * 12
    assert not re.search(r"hashpartitioning\(query_id#\d+, chunk_id", plan_of(got))
    assert J.lexical_top(queries, chunks.limit(0), 5).count() == 0 and J.lexical_top(queries.limit(0), chunks, 5).count() == 0


def test_coverage_shuffles_no_pairs_and_no_lines(spark):
    from quillspark.plans import review
    from quillspark.provider import Offline

    obligations = spark.createDataFrame([("a", "SHALL", "gates close at night"), ("b", "MAY", "gates open")], "id string, modality string, text string")
    chunks = spark.createDataFrame([(f"c{i}", f"gates number{i}") for i in range(40)], "chunk_id string, text string")
    docs = spark.createDataFrame([(1, "The gates close.")], "slug int, text string")
    plan = review.coverage(obligations, docs, Offline(("unmet",)), chunks=chunks)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(chunk_id", plan) and not re.search(r"hashpartitioning\(query_id#\d+, chunk_id", plan)


def test_few_documents_come_out_of_the_score_for_recall(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "beta") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("g06_lexical_retrieval", "g19_recall_at_k"):
        assert "FlatMapCoGroupsInArrow" in plan_of(QUERIES[name](spark, str(tmp_path)))
    top = QUERIES["g06_lexical_retrieval"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in top) == sorted((q, i, r) for q, ids in ((1, (59, 57, 55, 53)), (2, (59, 58, 57, 56))) for r, i in enumerate(ids, 1))
    assert [(r["query_id"], r["found"], r["wanted"]) for r in QUERIES["g19_recall_at_k"](spark, str(tmp_path)).collect()] == [(1, 12, 30)]

"""Findings of the third review, each by the smallest table that shows it."""

import math

from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.operators import pointers as P

QUERIES = catalogue.queries()


def docs(spark, path, *texts):
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_lists_of_sections_that_read_as_years(spark):
    told = lambda t: [k["number"] for k in spark.range(1).select(P.pointed(F.lit(t))["keys"]).first()[0]]
    assert told("see Sections 1970, 1971, and 1972") == ["1970", "1971", "1972"]
    assert told("Sections 1899, 1900") == ["1899", "1900"]
    assert told("Section 5 of the 2024 plan") == ["5"] and told("Section 1500 of the 2024 plan") == ["1500"]


def test_letters_keep_numbers_inside_of_prose(spark, tmp_path):
    got = QUERIES["d26_letter_outline"](spark, docs(spark, tmp_path, "one\n70.32.29.134 two\n12.  three")).collect()
    assert [(r["number"], r["body"]) for r in got] == [(1, "one 70.32.29.134 two 12. three")]


def test_prose_that_begins_with_a_number_is_no_heading(spark, tmp_path):
    got = QUERIES["f07_unresolved_targets"](spark, docs(spark, tmp_path, "a", "b", "3.29.134.11 is lost")).collect()
    assert [(r["slug"], r["target"], r["uses"], r["first_line"]) for r in got] == [(3, "Section 3", 1, 1)]


def test_nearest_items_by_blocks(spark, monkeypatch):
    import numpy as np

    from quillspark.functions import text as T
    from quillspark.operators import joins as J
    from quillspark.operators import records as N

    for name, size in (("SMALL", 10), ("ITEM_BLOCK", 40), ("QUERY_BLOCK", 7), ("STRIP", 3)):
        monkeypatch.setattr(J, name, size)
    v = np.random.default_rng(5).normal(size=(150, 6)).astype(np.float32)
    v[20:90] = v[3]  # one large group of copies
    v[91] = 0
    rows = [(i, i % 3, x.tolist()) for i, x in enumerate(v)] + [(150, 0, None), (151, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (152, 2, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "item_id long, section int, embedding array<float>").cache()
    queries = items.filter("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    both = queries.select("query_id", F.col("embedding").alias("q")).crossJoin(items)
    cos = {(r[0], r[1]): r[2] for r in both.select("query_id", "item_id", T.cosine(F.col("q"), F.col("embedding")).alias("s")).collect()}
    asked = sorted({q for q, _ in cos})
    wanted = {(q, i, n + 1, cos[q, i]) for q in asked for n, i in enumerate(sorted(range(153), key=lambda i: (math.inf if cos[q, i] is None else -cos[q, i], -i))[:4])}
    assert {tuple(r) for r in J.top_k(queries, items, 4).select("query_id", "item_id", "rank", "score").collect()} == wanted
    got = N.register_hits(queries.withColumnRenamed("query_id", "id"), items.withColumnRenamed("item_id", "row"), 0.5).collect()
    assert {(r["id"], r["row"]) for r in got} == {p for p, s in cos.items() if s is not None and round(s, 6) >= 0.5} and len(got) > 100
    got = J.section_top_k(queries, items.filter("item_id < 150"), 6, 2).collect()
    assert all(sum(r["query_id"] == q for r in got) in (6, 7, 8) for q in asked)


def test_first_owner_pairs_come_without_all_of_them(spark):
    from quillspark.operators import sets as E

    rows = [(i, i % 7, i % 3, f"owner{'abc'[i * i % 3]} unit", f"cap{'xyz'[i % 3]}{i % 11}" if i % 4 else "") for i in range(120)]
    rows = [(i, s if i > 10 else None, None if i % 13 == 0 else g, o, c) for i, s, g, o, c in rows]
    told = spark.createDataFrame(rows, "id long, section int, grp int, owner string, capability string")
    from quillspark.functions import text as T

    words = {r["id"]: (tuple(sorted(r["w"])), " ".join(sorted(r["c"]))) for r in told.select("id", T.concepts(F.col("owner")).alias("w"), T.concepts(F.col("capability")).alias("c")).collect()}
    near = lambda x, y: (x[2] is not None and x[2] == y[2]) or (words[x[0]][1] != "" and words[x[0]][1] == words[y[0]][1])
    differ = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and words[x[0]][0] != words[y[0]][0]]
    wanted = sorted((x[0], y[0]) for x, y in differ if near(x, y))
    for most in (5, 300, len(wanted) + 10):
        pairs, every = E.owner_pairs(told, most)
        assert every == len(differ) and [(r["a"], r["b"]) for r in pairs.collect()] == wanted[:most]


def test_claims_of_equal_words_are_met_by_their_first(spark):
    import itertools

    from quillspark.operators import synthesis as S

    rows = [(i, "d", "the gate", ("holds water", "opens late", "holds late water")[i % 3], i % 4) for i in range(200)]
    got = S.claim_pairs(spark.createDataFrame(rows, "id int, slug string, subject string, predicate string, start int"))
    words = [frozenset(r[3].split()) for r in rows]
    every = [(len(words[x] & words[y]) / min(len(words[x]), len(words[y])), (rows[x][4], x), (rows[y][4], y)) for x, y in itertools.permutations(range(200), 2) if rows[x][4] < rows[y][4]]
    assert [(r["a"], r["b"]) for r in got.orderBy("rank").collect()] == [(a[1], b[1]) for _, a, b in sorted(every)[:12]]


def test_lines_of_a_section_keep_to_it_at_any_key(spark, tmp_path):
    part = [(1, "a b", 14), (2, "c d", 14), (400_001, "e f", 10)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(13,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in QUERIES["o11_adjudicate"](spark, str(tmp_path)).collect()] == [(13, "not_addressed", "UNCHANGED")]


def test_more_findings_than_a_broadcast_takes(spark, tmp_path, monkeypatch):
    from quillspark.operators import joins as J

    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J.small, "__defaults__", (3,))
    spark.createDataFrame([(k, "small ring") for k in range(1, 9)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "PERU"), (1, "CHINA")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r["id"]: r["status"] for r in QUERIES["o11_verify"](spark, str(tmp_path)).collect()}
    assert got == {1: "confirmed", 2: "contested", 3: "contested", 4: "contested", 5: "confirmed", 6: "refuted", 7: "contested", 8: "contested"}

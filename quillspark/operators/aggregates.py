"""Tallies, agreement, scores and rankings (2.G, 2.H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.functions.scale import COVERAGE, WEIGHTS, Scale, lookup
from quillspark.operators.durable import written


def tally(df: DataFrame, *keys: str) -> DataFrame:
    """G07, G28."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def term_counts(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Uses and first line of each term, zeros kept. Counted per line first, so documents aren't gathered."""
    from quillspark.operators.joins import small

    low = F.lower("text")
    met = lines.join(small(terms), F.contains(low, F.lower("term")))
    counted = met.groupBy("term").agg(F.sum(T.occurrences(low, F.lower("term"))).alias("uses"), F.min("line_no").alias("first_line"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("uses", F.lit(0)).alias("uses"), "first_line")


def absence_gate(hits: DataFrame, least: int = 8) -> DataFrame:
    """(id, word, hits) to clear or contested: the three rarest present words, two at least, with least hits in all."""
    order = W.partitionBy("id").orderBy("hits", "word")
    rare = hits.filter("hits > 0").withColumn("r", F.row_number().over(order)).filter("r <= 3")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hits", "word"))), lambda x: F.concat(x["word"], F.lit("x"), x["hits"].cast("string"))), ", ")
    gate = rare.groupBy("id").agg(F.count("*").alias("n"), F.sum("hits").alias("total"), shown.alias("evidence"))
    bad = (F.col("n") >= 2) & (F.col("total") >= least)
    return hits.select("id").distinct().join(gate, "id", "left").select("id", F.when(bad, "contested").otherwise("clear").alias("gate"), F.when(bad, F.col("evidence")).alias("evidence"))


def clusters(rows: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """(cluster, position, id, verdict) to strength, size, lead and rank by strength, then size, then position."""
    weight = lookup(F.col("verdict"), weights, 0.0)
    each = rows.groupBy("cluster").agg(
        F.round(F.sum(weight), 6).alias("strength"), F.count("*").alias("size"), F.max_by("id", F.struct(weight, -F.col("position"))).alias("lead"), F.min("position").alias("first")
    )
    return ranked(each, [F.col("strength").desc(), F.col("size").desc(), F.col("first")], "rank").drop("first")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Places from 1 over a whole table. Rows are dealt by ranges of the order and sorted there; only the ranges' sizes meet in one place.

    The ranges are written to the shared folder, so that counting and numbering see the same ones.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "places")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_part", "_at", "_first", "_before")


def agreement(verdicts: DataFrame, key: str = "id", scale: Scale = COVERAGE) -> DataFrame:
    """G10."""
    return verdicts.groupBy(key).agg(F.count("*").alias("judges"), scale.agreement(F.col("verdict")).alias("agreement"))


def verification(lenses: DataFrame) -> DataFrame:
    """(id, requirement, lens, refuted, failed) to a status. Only the search and rebuttal lenses vote."""
    truth = F.col("lens").isin("search", "rebuttal")
    each = lenses.groupBy("id", "requirement").agg(
        F.count_if(truth & F.col("refuted")).alias("refutations"), F.coalesce(F.bool_or(truth & F.col("failed")), F.lit(False)).alias("any_failed")
    )
    n, universal = F.col("refutations"), F.col("requirement").rlike(T.UNIVERSAL)
    status = F.when(F.col("any_failed"), "contested").when((n >= 2) & ~universal, "refuted").when(n >= 1, "contested").otherwise("confirmed")
    return each.select("id", "refutations", universal.alias("universal"), status.alias("status"))


def confusion(found: Column, wanted: Column) -> list[Column]:
    """Counts of the four cells, precision and recall."""
    tp, fp, fn, tn = F.count_if(found & wanted), F.count_if(found & ~wanted), F.count_if(~found & wanted), F.count_if(~found & ~wanted)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"),
    ]


def majority(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Every value that has the most rows; ties are all kept."""
    each = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if not keys:
        return each.join(F.broadcast(each.agg(F.max("n").alias("_m"))), F.col("n") == F.col("_m")).drop("_m")
    return each.withColumn("_m", F.max("n").over(W.partitionBy(*keys))).filter("n = _m").drop("_m")


def recall_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: found, wanted, recall at k, precision at k and whether all was found."""
    top = ranked.filter(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias("hit"))
    each = gold.join(top, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
    return each.select("query_id", "found", "wanted", (F.col("found") / F.col("wanted")).alias("recall"), (F.col("found") / k).alias("precision"), (F.col("found") == F.col("wanted")).alias("covered"))


def precision_at(ranked: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Hits within the first k of a ranking (rank, hit), for each k."""
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return ranked.select("rank", "hit", cuts).filter("rank <= k").groupBy("k").agg(F.count_if("hit").alias("hits"), F.count("*").alias("shown"))


def first_by_order(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top_with_rest(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, and how many more there are."""
    w = W.partitionBy(*keys)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0))).filter(F.col("rank") <= k)


def evaluators(verdicts: DataFrame, readers: list[str], key: str = "id") -> DataFrame:
    """One column for each reader; the readers are named, so the pivot is one aggregation."""
    return verdicts.groupBy(key).agg(*[F.max(F.when(F.col("model") == r, F.col("verdict"))).alias(r) for r in readers])


def convergence(findings: DataFrame, coverage: DataFrame, synthesis: DataFrame, keep: int = 3) -> DataFrame:
    """(id, class, term) reached by coverage rows, synthesis rows (key, text) or both; score 1 or 2 and the first rows of each."""
    from quillspark.operators.joins import contains_join

    def reached(rows: DataFrame, name: str) -> DataFrame:
        met = contains_join(rows, findings.select("id", "term")).select("id", "key").distinct()
        order = W.partitionBy("id").orderBy("key")
        return met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias(name))

    both = findings.select("id", "class").distinct().join(reached(coverage, "by_coverage"), "id", "left").join(reached(synthesis, "by_synthesis"), "id", "left")
    score = F.col("by_coverage").isNotNull().cast("int") + F.col("by_synthesis").isNotNull().cast("int")
    return both.withColumn("score", score).filter("score > 0")

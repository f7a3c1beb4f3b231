"""Middle values without sorting a group, and what a reader's rates by cell say about how it reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.operators.durable import written

#: Ranges that a round cuts a group into, and rows of a range from which on it is sorted.
RANGES, FEW = 256, 4096


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Keys and median, the middle value of each group, the upper one of two.

    Values are counted by RANGES ranges between their least and largest, and the range that holds the middle is cut again, over all groups
    at once, until it has FEW rows or one value; only that is sorted. So a group of any size is spread over all tasks, and its counts are
    what is shuffled. Values are compared as doubles; nulls don't count; a null key is a group of its own.
    """
    kind = df.schema[value].dataType
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    held = written(df.filter(F.col(value).isNotNull()).select(group.alias("_k"), F.col(value).cast("double").alias("_v")), "values")
    now = held.groupBy("_k").agg(F.floor(F.count("*") / 2).alias("rank"), F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    now = written(now, "middles")
    wide = (F.col("n") > FEW) & (F.col("lo") < F.col("hi"))
    while now.filter(wide).limit(1).count():
        inside = held.join(now.filter(wide), "_k").filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        at = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
        counts = inside.groupBy("_k", "rank", at.alias("_r")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("n").over(W.partitionBy("_k").orderBy("_r")) - F.col("n")  # RANGES rows a group
        found = counts.withColumn("_b", before).filter((F.col("_b") <= F.col("rank")) & (F.col("rank") < F.col("_b") + F.col("n")))
        now = written(now.filter(~wide).unionByName(found.select("_k", (F.col("rank") - F.col("_b")).alias("rank"), "n", "lo", "hi")), "middles")
    last = held.join(now.filter("lo < hi"), "_k").filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    placed = last.withColumn("_p", F.row_number().over(W.partitionBy("_k").orderBy("_v")) - 1).filter(F.col("_p") == F.col("rank")).select("_k", F.col("_v").alias("median"))
    told = now.filter("lo = hi").select("_k", F.col("lo").alias("median")).unionByName(placed)
    return told.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("median").cast(kind).alias("median"))


# The four cells, and what readers of four kinds would get right in each.
CELLS = {"A": "high overlap, addressed", "B": "low overlap, addressed", "C": "high overlap, not addressed", "D": "low overlap, not addressed"}
POLICIES = {
    "vocabulary matcher": (1, 0, 0, 1),
    "blanket addressed": (1, 1, 0, 0),
    "blanket refuse": (0, 0, 1, 1),
    "outcome judge": (1, 1, 1, 1),
}
#: Readings of a task.
READINGS = 500_000
#: Rows that a run has to cover.
MIN_ROWS = 80
#: What a partial answer counts as.
MAPPINGS = {"strict": "not_addressed", "lenient": "addressed"}


def cells(rows: DataFrame) -> DataFrame:
    """Rows (id, score, verdict) with cell: scores from the middle one up are high, crossed with whether the verdict is addressed."""
    middle = upper_median(rows, "score").withColumnRenamed("median", "_m")
    high, addressed = F.col("score") >= F.col("_m"), F.col("verdict") == "addressed"
    cell = F.when(high & addressed, "A").when(addressed, "B").when(high, "C").otherwise("D")
    return rows.join(F.broadcast(middle)).withColumn("cell", cell).drop("_m")


def counted_as(verdict: Column, mapping: str = "strict") -> Column:
    return F.when(verdict == "partial", MAPPINGS[mapping]).otherwise(verdict)


def cell_rates(labelled: DataFrame, runs: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """By model (of runs: model, id, verdict): covered, the rates a to d of right answers in the cells of cells(), agree, diverge, gap and policy.

    agree is the mean of the cells where words and truth agree (A, D), diverge that of the others; the policy is the nearest by the sum of
    squares, the first of several. A run of fewer than least rows has nulls: a rate over two rows says nothing. A cell without rows has the rate 0.
    """
    # rows are dealt by id, as many to a task at any size, and a row's readings are counted where they are; a distinct count would hold a whole split's
    dealt = runs.select("model", "id", "verdict").repartition(max(1, math.ceil(runs.count() / READINGS)), "id")
    met = dealt.join(labelled.select("id", "cell", F.col("verdict").alias("_true")), "id")
    right = (counted_as(F.col("verdict")) == F.col("_true")).cast("int")
    names = [c.lower() for c in CELLS]
    own = {c: F.when(F.col("cell") == c, right) for c in CELLS}
    rows = met.groupBy("model", "id").agg(*[F.sum(own[c]).alias(f"_s{c}") for c in CELLS], *[F.count(own[c]).alias(f"_n{c}") for c in CELLS])
    each = rows.groupBy("model").agg(F.count("*").alias("covered"), *[F.coalesce(F.sum(f"_s{c}") / F.nullif(F.sum(f"_n{c}"), F.lit(0)), F.lit(0.0)).alias(c.lower()) for c in CELLS])
    agree, diverge = (F.col("a") + F.col("d")) / 2, (F.col("b") + F.col("c")) / 2
    off = {name: sum(((F.col(c) - F.lit(float(p))) * (F.col(c) - F.lit(float(p))) for c, p in zip(names, policy, strict=True)), F.lit(0.0)) for name, policy in POLICIES.items()}
    best = F.least(*off.values())
    policy = F.coalesce(*[F.when(d == best, name) for name, d in off.items()])
    told = each.select("model", "covered", *names, agree.alias("agree"), diverge.alias("diverge"), (agree - diverge).alias("gap"), policy.alias("policy"))
    enough = F.col("covered") >= least
    return told.select("model", "covered", *[F.when(enough, F.col(c)).alias(c) for c in (*names, "agree", "diverge", "gap", "policy")])


def accuracy(truth: DataFrame, runs: DataFrame) -> DataFrame:
    """By model and mapping (strict, lenient): hits and seen among the rows of truth (id, verdict), and accuracy; baseline is the share of the
    most frequent label of truth, whichever of several it is."""
    total = truth.groupBy("verdict").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))
    met = truth.select("id", F.col("verdict").alias("_true")).join(runs, "id")
    each = None
    for mapping in MAPPINGS:
        one = met.groupBy("model").agg(F.lit(mapping).alias("mapping"), F.count_if(counted_as(F.col("verdict"), mapping) == F.col("_true")).alias("hits"), F.count("*").alias("seen"))
        each = one if each is None else each.unionByName(one)
    return each.join(F.broadcast(total)).select("model", "mapping", "hits", "seen", (F.col("hits") / F.col("seen")).alias("accuracy"), "baseline")

"""Mixing sources to target weights (op 11), on DataFrame functions only: weighted fair queueing.

Every source is a queue of its documents in the order of a hash, gone through once and again. A document's virtual
finish time is the words of its source up to its end, divided by the source's target. All entries are ordered by
finish time and cut where the words come to the budget, so sources advance side by side in proportion to their targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.llm.common import materialise, prepare
from quillspark.operators.aggregates import ranked

#: Weights of the sources in code-point order, repeating.
CYCLE = (3, 1, 2)
#: The budget's share of all words, as a fraction.
SHARE = (3, 2)
#: A source is gone through so often at most, so its target stops at MOST times its size.
MOST = 2
#: Rows of a source's bucket at most, about: running totals are summed inside buckets, and over buckets.
BUCKET_ROWS = 65_536
#: Buckets of each source at least, and ranges of finish times that one look at the budget's end tells apart.
BUCKETS, RANGES = 256, 1024

WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["no_source", "src"]
ORDER = ["finish", *SOURCE, "served"]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, no_source and src (a null source is told apart and comes last), size in words, and key, the hash that shuffles."""
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.unhex(key).alias("key"), F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("place"),
    )


def targets(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, share: tuple[int, int] = SHARE, most: int = MOST) -> tuple[DataFrame, int, int]:
    """Each source's source_size and target, then the budget in words and the number of rows.

    All sources rise to one level in proportion to their weights, but for those that stop at most times their size. Each round
    counts what stands at its stop and raises the level of the others: Newton's steps on a concave line with few bends,
    so rounds are few, and only sums of whole numbers meet on the driver.
    """
    each = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = (F.col("rank") - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), place + 1)
    held = materialise(ranked(each, SOURCE).select(*SOURCE, "source_size", "n", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("stop")), "sources")
    total = held.agg(F.sum("source_size").alias("s"), F.sum("n").alias("n")).first()
    words, n = total["s"] or 0, total["n"] or 0
    high = lambda column, by: column.cast("decimal(38,0)") * F.lit(by).cast("decimal(38,0)")
    stopped, before = F.lit(False), -1
    while True:
        row = held.agg(F.count_if(stopped).alias("c"), F.sum(F.when(stopped, F.col("stop"))).alias("stop"), F.sum(F.when(~stopped, F.col("weight"))).alias("w")).first()
        level, per = share[0] * words - share[1] * (row["stop"] or 0), share[1] * (row["w"] or 0)
        if row["c"] == before or not per:
            break
        before, stopped = row["c"], high(F.col("weight"), level) > high(F.col("stop"), per)
    target = F.when(stopped, F.col("stop").cast("double")).otherwise((F.col("weight") * F.lit(level)).cast("double") / F.lit(float(per or 1)))
    return held.select(*SOURCE, "source_size", target.alias("target")), share[0] * words // share[1], n


def queues(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: tuple[int, int] = SHARE, most: int = MOST) -> tuple[DataFrame, int]:
    """Every row with its source's size and target and served, the words that its source has given before it; and the budget.

    A source may hold any share of all rows: its rows are dealt to buckets by their hash, so totals run inside a bucket, and
    over the buckets' sums.
    """
    prepare(docs.sparkSession)
    rows = materialise(sized(docs), "sizes")
    aims, budget, n = targets(rows, cycle, share, most)
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.shiftright(F.col("place") * buckets, 32)).drop("place")
    sums = rows.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*SOURCE, "bucket", before.alias("before")).join(aims, SOURCE)
    run = W.partitionBy(*SOURCE, "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    served = F.col("before") + F.sum("size").over(run) - F.col("size")
    placed = rows.join(starts, [*SOURCE, "bucket"]).select("doc_id", *SOURCE, "size", "source_size", "target", served.alias("served"))
    return materialise(placed, "queues"), budget


def _pass(k: int) -> list[Column]:
    """finish and served of a row's k-th time; an entry without words is in no queue."""
    served = F.col("served") + k * F.col("source_size")
    return [((served + F.col("size")).cast("double") / F.col("target")).alias("finish"), served.alias("served")]


def entries(placed: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each time that a document comes up: ORDER orders all of them."""
    some, out = placed.filter("size > 0"), None
    for k in range(most):
        one = some.select("doc_id", *SOURCE, "size", F.lit(k).alias("pass"), *_pass(k))
        out = one if out is None else out.unionByName(one)
    return out


def cut(queue: DataFrame, budget: int) -> tuple | None:
    """Where the budget ends in the global order: ORDER's values of the entry, and the words that are left for it; None if all fits.

    Words are summed by ranges of the order, and the range that holds the end is split into ranges again until it has BUCKET_ROWS
    entries at most; only those are put in order.
    """
    left, inside = budget, queue
    ends = inside.agg(F.min("finish").alias("a"), F.max("finish").alias("b"), F.count("*").alias("n"), F.sum("size").alias("s")).first()
    if (ends["s"] or 0) <= budget:
        return None
    while ends["n"] > BUCKET_ROWS and ends["a"] < ends["b"]:
        step = F.least(F.floor((F.col("finish") - F.lit(ends["a"])) / F.lit(ends["b"] - ends["a"]) * RANGES), F.lit(RANGES - 1))
        sums = inside.groupBy(step.alias("r")).agg(F.min("finish").alias("a"), F.max("finish").alias("b"), F.count("*").alias("n"), F.sum("size").alias("s"))
        for ends in sorted(sums.collect(), key=lambda x: x["r"]):  # RANGES rows at most
            if ends["s"] > left:
                break
            left -= ends["s"]
        inside = inside.filter(F.col("finish").between(ends["a"], ends["b"]))
    run = W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("size").over(run)).filter(F.col("upto") > left).orderBy("upto").first()
    return (*[last[c] for c in ORDER], left - last["upto"] + last["size"])


def _taken(finish: Column, served: Column, end: tuple | None) -> Column:
    """The words that the mix takes of an entry."""
    size = F.col("size")
    if end is None:
        return size
    finish_at, *source_at, served_at, left = end
    here = F.struct(finish.alias("a"), F.col("no_source").alias("b"), F.col("src").alias("c"), served.alias("d"))
    there = F.struct(F.lit(finish_at).alias("a"), F.lit(source_at[0]).alias("b"), F.lit(source_at[1]).alias("c"), F.lit(served_at).cast("long").alias("d"))
    return F.when(here < there, size).when(here == there, F.lit(left).cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row: what a mix of share of all words takes of it, repeats counted.

    The last entry is cut so that the words come to the budget exactly; each source is within a document of its target.
    A null or empty text has size 0 and gives nothing; a null source is one of its own, ordered last; null ids are
    shuffled like any other; repeated rows queue one by one (which copy comes first makes no difference); an empty table
    gives no rows, and further columns are left out. Texts are read once and never shuffled.
    """
    placed, budget = queues(docs, cycle, share, most)
    end, taken = cut(entries(placed, most), budget), F.lit(0).cast("long")
    for k in range(most):
        taken = taken + _taken(*_pass(k), end)
    return placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("src")).alias("source"), "size", "source_size", "target",
        F.when(F.col("size") > 0, taken).otherwise(F.lit(0).cast("long")).alias("taken"),
    )


def stream(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: doc_id, source, pass, finish and the words taken; odd rows as in mix()."""
    placed, budget = queues(docs, cycle, share, most)
    queue = entries(placed, most)
    taken = _taken(F.col("finish"), F.col("served"), cut(queue, budget))
    kept = queue.withColumn("taken", taken).filter("taken > 0").orderBy(*ORDER)
    return kept.select("doc_id", F.when(~F.col("no_source"), F.col("src")).alias("source"), "pass", "finish", "taken")


#: DuckDB's way: the level of the targets by a running sum over sources in the order of their stops.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT ns, src, sum(size)::HUGEINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY ns, src) - 1) % 3 + 1]::HUGEINT AS w
  FROM d GROUP BY ns, src),
r AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
         2 * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w::DOUBLE, ns, src)),
f AS (SELECT a, b FROM r WHERE a * w <= 2 * source_size * b ORDER BY 2 * source_size / w::DOUBLE, ns, src LIMIT 1),
t AS (
  SELECT ns, src, source_size, CASE WHEN (SELECT a FROM f) * w > 2 * source_size * (SELECT b FROM f) THEN (2 * source_size)::DOUBLE
         ELSE ((SELECT a FROM f) * w)::BIGINT::DOUBLE / (SELECT b FROM f)::BIGINT::DOUBLE END AS target
  FROM s),
q AS (
  SELECT d.*, t.source_size::BIGINT AS source_size, t.target, row_number() OVER () AS i,
         (sum(size) OVER (PARTITION BY ns, src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t USING (ns, src)),
e AS (
  SELECT i, ns, src, size, upto - size + p * source_size AS served, (upto + p * source_size)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1)) v(p) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, ns, src, served ROWS UNBOUNDED PRECEDING) - size AS before FROM e),
m AS (SELECT i, sum(greatest(0, least(size, (SELECT 3 * sum(size) // 2 FROM d) - before))) AS taken FROM g GROUP BY i)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN m USING (i)
"""

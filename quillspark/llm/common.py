"""What the training-data operators share: session settings, durable cuts and grouped streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be very long, so batches stay small.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches; give the session a checkpoint folder where it has none."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests on a local master, a temporary one.

    On a cluster without it this is an error: executors couldn't read what another machine wrote to its own folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage is cut and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    each: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Run each() on the rows of every key. Rows are dealt by key and sorted; groups are cut from the stream."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        ready: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().copy()
            changed[0] = bool(held) and tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0])
            cuts = [0, *changed.nonzero()[0].tolist(), len(batch)]
            for position, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if position and held:
                    ready.append(each(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                    held = []
                if b > a:
                    held.append(batch.iloc[a:b].reset_index(drop=True))
                if sum(map(len, ready)) > 2000:
                    yield pd.concat(ready, ignore_index=True)
                    ready = []
        if held:
            ready.append(each(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
        if ready:
            yield pd.concat(ready, ignore_index=True)

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def beside(df: DataFrame, keep: Sequence[str], column: str, each: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """The columns keep of df, then those of schema: each() makes a tuple of every value of column, a batch at a time.

    Only the one column goes through Python. What stands beside it, ids above all, never leaves the JVM: pandas would
    turn a batch of ids with a null into floats, which round what is above 2 ** 53.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = each(batch.tolist())
            yield pd.DataFrame({n: [r[k] for r in rows] for k, n in enumerate(names)})

    # non-deterministic by name only: no later filter or projection makes Spark call it twice
    told = df.select(*keep, made.asNondeterministic()(F.col(column)).alias("_made"))
    return told.select(*keep, *[F.col(f"_made.{n}").alias(n) for n in names])


def texts(df: DataFrame) -> DataFrame:
    """Null texts become empty ones."""
    return df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """At most rows labelled documents of each class, in an order that hashes fix; doc_id, y, text. The ids are broadcast: 2 x rows at most."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.filter("y = 1").orderBy(*order).limit(rows).unionByName(usable.filter("y = 0").orderBy(*order).limit(rows))
    return texts(docs.select("doc_id", "text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")


def remainder(column, divisor: int):
    return F.crc32(column.cast("string").cast("binary")) % divisor


def fair_share(sizes: list[int], total: int) -> int | None:
    """What each of sizes may take at most so that all come to total at most; None where they do."""
    if sum(sizes) <= total:
        return None
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return max(sizes)


def whole_rows(sample: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """The rows of sample (doc_id, y) whose sizes (doc_id, y, n) come to total at most, taken whole in the order of labelled_sample().

    The classes share total fairly; a row that its class has no more room for is left out, not cut, and later ones that fit stay.
    One number a row meets on the driver, so sample is to be bounded by its rows.
    """
    each = sizes.groupBy("doc_id", "y", F.xxhash64("doc_id").alias("h")).agg(F.sum("n").alias("n")).collect()
    most = fair_share([sum(r["n"] for r in each if r["y"] == y) for y in (0, 1)], total)
    if most is None:
        return sample
    left, kept = {0: most, 1: most}, []
    for r in sorted(each, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            kept.append((r["doc_id"], r["y"]))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, sample.select("doc_id", "y").schema)), ["doc_id", "y"], "left_semi")

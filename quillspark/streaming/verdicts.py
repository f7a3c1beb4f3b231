"""Verdict files as a stream: each key once, whenever it comes (2.L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.files import append_new

VERDICT = "id string, model string, verdict string, doc string, doc_sha256 string, ts timestamp"


def verdict_stream(spark: SparkSession, path: str, schema: str = VERDICT) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def resume_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """New keys are appended to a table; a batch that runs again after a failure adds nothing twice."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, path, keys) and None).start()


def tallies(stream: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Verdicts by window, with a watermark for late ones."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "verdict").agg(F.count("*").alias("n"))

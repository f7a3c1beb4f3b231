"""The review relations that the test tables stand in for, in Spark; SQL twins are beside the queries.

lines: documents' lines. judged: an order is a reviewed row, with two judges' verdicts. readings: an order's
items are readers' verdicts of it. sections: spans of a part's items. deferrals: nations that defer to nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.lines import to_lines

FIRST = "CASE o_orderstatus WHEN 'F' THEN 'met' WHEN 'O' THEN 'unmet' ELSE 'partial' END"
SECOND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'unmet' WHEN '2' THEN 'partial' WHEN '3' THEN 'met' WHEN '4' THEN 'unverifiable' ELSE '' END"
READING = "CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'R' THEN 'unmet' ELSE CASE l_linestatus WHEN 'F' THEN 'partial' ELSE 'unverifiable' END END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file is one split and would keep one core busy; where splits are fewer than half of the cores, rows are dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(documents(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS ref", f"{FIRST} AS a", f"{SECOND} AS b")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "cast(l_linenumber AS string) AS model", "l_partkey AS ref", f"{READING} AS verdict", "l_suppkey", "l_quantity")

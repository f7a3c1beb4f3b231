"""From raw documents to packed training sequences: each stage is written as Parquet and read by the next.

1. quality: documents that the base rules or their language's perplexity band reject go.
2. toxicity: documents that the subword classifier calls toxic go.
3. lines: lines that stand on many sites stay only where they come first; n_chars follows the text.
4. near: one document of each class of near duplicates stays.
5. pack: what is left, as pieces in sequences of at most 1024 tokens.

Every stage gives no rows for an empty table, and further columns of documents pass through all but the last one. No stage
needs more than the documents that came before it and the labels table; SQL can't express a
language model, a trained classifier or best-fit packing, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import lines, nearjoin, packing, perplexity, toxicity
from quillspark.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rules and go; a null language has a band of its own; repeated rows are judged alike and all stay or go."""
    return perplexity.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts score as the bias does; without labels of both classes all rows stay or go alike; null ids stay null."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null; a null source is no site; repeated rows lose the same lines; n_chars changes only where lines went."""
    own = {f"__{c}": c for c in ("n_lines", "n_removed") if c in docs.columns}  # a table's own columns of these names stay as they are
    for held, c in own.items():
        docs = docs.withColumnRenamed(c, held)
    out = lines.dedupe_lines(docs)
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[chars if c == "n_chars" else F.col(c).alias(own.get(c, c)) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the least by doc_id (null first), then by text. Null and blank texts are one class; of repeated rows one stays."""
    return nearjoin.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one piece of one token; every row gets its own pieces."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxic), ("lines", line_dedup), ("near", near), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

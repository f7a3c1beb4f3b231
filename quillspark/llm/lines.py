"""Cross-site line deduplication (op 4), on DataFrame functions only.

A HyperLogLog sketch per line hash counts the distinct sites that a line stands on; sketches merge by
aggregation. Lines whose estimate is near the threshold get exact distinct counts. A line that is on
enough sites is boilerplate: only its first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's buckets; its relative error is about 1.04 / sqrt(2 ** LOG_BUCKETS).
LOG_BUCKETS = 11
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
MARGIN = 0.15
#: So many boilerplate lines are broadcast at most (under 10 MB); more are joined by shuffle.
BROADCAST_LINES = 100_000

SPACE = "[ \\t\\r\\x0B\\f]+"


def line_key(line):
    return F.unhex(F.md5(line.cast("binary")))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, pos and line_key of every line that isn't blank; a line is trimmed of blanks and tabs."""
    keyed = docs.select("doc_id", "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), F.split("text", "\n").alias("parts"))
    rows = keyed.select("doc_id", "source", "text_key", F.posexplode("parts").alias("pos", "line"))
    trimmed = rows.withColumn("line", F.regexp_replace("line", f"^{SPACE}|{SPACE}$", ""))
    return trimmed.filter(F.col("line") != "").select("doc_id", "source", "text_key", "pos", line_key(F.col("line")).alias("line_key"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """line_key, n_sites and the first place (doc_id, text_key, pos) of every line on at least min_sites sites."""
    place = F.struct(F.col("doc_id"), F.col("text_key"), F.col("pos"))
    sketched = rows.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LOG_BUCKETS))).alias("estimate"), F.min(place).alias("first")
    )
    near = materialise(sketched.filter(F.col("estimate") >= F.lit(int(min_sites * (1 - margin)))), "spread")
    unsure = near.filter(F.col("estimate") <= F.lit(-int(-min_sites * (1 + margin) // 1))).select("line_key")
    # every (line, site) pair is kept once before lines are counted, so a hot line or site spreads over tasks
    exact = (
        rows.select("line_key", "source").join(bounded(unsure), "line_key", "left_semi").distinct()
        .groupBy("line_key").agg(F.count("source").alias("exact"))
    )
    sites = F.coalesce(F.col("exact"), F.col("estimate"))
    found = near.join(exact, "line_key", "left").select("line_key", sites.alias("n_sites"), "first").filter(sites >= min_sites)
    return materialise(found, "boilerplate")


def bounded(df: DataFrame) -> DataFrame:
    """Broadcasts a frame of line keys whose counted size is small; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else df


def dedupe_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Removes lines that stand on min_sites distinct sources or more, but for the first occurrence by doc_id.

    Returns the columns of docs with text rewritten, then n_lines (parts between newlines) and n_removed.
    Lines are compared without blanks and tabs at their ends; blank lines are never removed. A null text is
    kept null with 0 lines; an empty one has 1 blank line. A null source is no site. Rows that repeat one
    document share what is removed. Ties in doc_id are ordered by the text's MD5. An empty table gives no
    rows. Further columns pass through, but for
    ones named n_lines or n_removed, which are replaced. Only line hashes are shuffled for counting; texts are shuffled once,
    to meet the positions to remove.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    base = docs.select("*", F.unhex(F.md5(F.col("text").cast("binary"))).alias("_text_key"))
    # texts are split and hashed once; counting, the exact counts and the places to remove read the hashes
    rows = materialise(line_rows(docs.filter(F.col("text").isNotNull())), "hashes")
    found = boilerplate(rows, min_sites)
    here = F.struct(F.col("doc_id"), F.col("text_key"), F.col("pos"))
    hit = rows.select("doc_id", "text_key", "pos", "line_key").join(bounded(found.select("line_key", "first")), "line_key")
    gone = (
        hit.filter(~here.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_gone")
    )
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_key").eqNullSafe(F.col("_key")), "left")
    parts = F.split("text", "\n")
    # the kept runs lie between removed positions, so the work is linear in the lines of a text
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(parts)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda k: F.slice(F.col("_parts"), F.element_at(F.col("_edges"), k) + 2, F.element_at(F.col("_edges"), k + 1) - F.element_at(F.col("_edges"), k) - 1),
    )
    cut = joined.withColumn("_parts", parts).withColumn("_edges", F.when(F.col("_gone").isNotNull(), edges))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return cut.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_parts")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: DuckDB's way, over a table or view named documents.
ORACLE = """
WITH l AS (
  SELECT doc_id, source, md5(text) AS tk, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM {documents} WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (
  SELECT line, min(struct_pack(a := doc_id, b := tk, c := pos)) AS first FROM t
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
k AS (
  SELECT t.doc_id, t.tk, t.raw, t.pos,
         b.line IS NOT NULL AND struct_pack(a := t.doc_id, b := t.tk, c := t.pos) <> b.first AS gone
  FROM t LEFT JOIN b ON t.line = b.line AND t.line <> ''),
d AS (
  SELECT doc_id, tk, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM k GROUP BY doc_id, tk)
"""

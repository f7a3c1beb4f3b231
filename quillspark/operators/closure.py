"""What became of findings between two revisions (closure), and of a document's integrity (2.C, J32)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.graph import diffs
from quillspark.operators.joins import contains_join

#: More matched lines than this say nothing about one finding.
TOO_BROAD = 120


def term_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, line_no, text) once for each finding and line, whatever the number of its terms in it."""
    return contains_join(lines, terms.select("id", "term")).select("id", "line_no", "text").distinct()


def closure(findings: DataFrame, terms: DataFrame, old: DataFrame, new: DataFrame, too_broad: int = TOO_BROAD) -> DataFrame:
    """(id, state, detail, old_lines, new_lines) of findings (id, absence) with expanded terms (id, term).

    A side over too_broad lines keeps its count only; texts of narrow ones are compared in line order, folded.
    """

    def side(lines: DataFrame, name: str) -> DataFrame:
        hits = term_hits(lines, terms)
        count = hits.groupBy("id").agg(F.count("*").alias(f"{name}_lines"))
        narrow = hits.join(count.filter(F.col(f"{name}_lines") <= too_broad), "id", "left_semi")
        texts = narrow.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_s"))
        return count.join(texts.select("id", F.transform("_s", lambda x: x["text"]).alias(f"{name}_text")), "id", "left")

    have = terms.select("id").distinct().withColumn("has_terms", F.lit(True))
    both = findings.join(have, "id", "left").join(side(old, "old"), "id", "left").join(side(new, "new"), "id", "left").fillna({"old_lines": 0, "new_lines": 0})
    folded = {n: F.transform(f"{n}_text", lambda x: T.fold(x)) for n in ("old", "new")}
    a, b = F.col("old_lines"), F.col("new_lines")
    state = (
        F.when(F.col("has_terms").isNull(), "NO TERMS").when((a > too_broad) | (b > too_broad), "TOO BROAD")
        .when((a == 0) & (b == 0), F.when(F.col("absence"), "STILL ABSENT").otherwise("ABSENT"))
        .when(b == 0, "REMOVED").when(a == 0, "ADDED").when(folded["old"] == folded["new"], "UNCHANGED").otherwise("CHANGED")
    )
    told = both.withColumn("state", state)
    changed = diffs(told.filter("state = 'CHANGED'").select("id", folded["old"].alias("old"), folded["new"].alias("new"))).select("id", F.format_string("+%d -%d", "added", "dropped").alias("moved"))
    detail = F.when(F.col("state") == "CHANGED", F.col("moved")).when((F.col("state") == "UNCHANGED") & (F.col("old_text") != F.col("new_text")), "reformatted only")
    return told.join(changed, "id", "left").select("id", "state", detail.alias("detail"), "old_lines", "new_lines")


def manifest(docs: DataFrame) -> DataFrame:
    """Slug, hash and size of each (slug, text)."""
    return docs.select("slug", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n")).alias("text_lines"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Each slug: never frozen, gone, edited or as frozen, with line counts."""
    a, b = before.select("slug", F.col("text_sha256").alias("h0"), F.col("text_lines").alias("lines_before")), now.select("slug", F.col("text_sha256").alias("h1"), F.col("text_lines").alias("lines_now"))
    state = F.when(F.col("h0").isNull(), "never frozen").when(F.col("h1").isNull(), "gone").when(F.col("h0") == F.col("h1"), "as frozen").otherwise("edited")
    return a.join(b, "slug", "full_outer").select("slug", state.alias("state"), "lines_before", "lines_now")


def load_pinned(docs: DataFrame, pins: DataFrame) -> DataFrame:
    """Documents with a pin (a hash or its beginning); one whose text differs stops the query."""
    hashed = docs.join(pins.select("slug", "pin"), "slug").withColumn("h", F.sha2("text", 256))
    return hashed.select(*docs.columns, F.when(F.startswith("h", "pin"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("text differs from its pin: "), F.col("slug").cast("string")))).alias("pinned"))


def stale(verdicts: DataFrame, pins: DataFrame) -> DataFrame:
    """Verdicts with a stamp: current, stale or unstamped."""
    joined = verdicts.join(pins.select("doc", F.col("text_sha256").alias("_h")), "doc", "left")
    return joined.withColumn("stamp", F.when(F.col("doc_sha256").isNull(), "unstamped").when(F.col("doc_sha256") == F.col("_h"), "current").otherwise("stale")).drop("_h")


def phrase_digests(docs: DataFrame, denied: DataFrame, n: int = 4) -> DataFrame:
    """Documents with a denied phrase of n words; phrases are known by their SHA-256 only."""
    words = F.filter(F.split(T.loose(F.col("text")), " "), lambda w: w != "")
    grams = docs.select("slug", F.explode(T.grams(words, n)).alias("gram")).select("slug", F.sha2("gram", 256).alias("digest"))
    return grams.join(denied.select("digest").distinct(), "digest", "left_semi").groupBy("slug").agg(F.count("*").alias("hits"))


def denied_phrases(docs: DataFrame, denied: DataFrame) -> DataFrame:
    """Slug, n, digest and hits of phrases of every length of a denylist (n, digest) in documents (slug, text). Only the windows of one length are held in a row."""
    lengths = denied.agg(F.collect_set(F.col("n").cast("int")).alias("lengths"))  # a handful
    words = F.filter(F.split(T.loose(F.col("text")), " "), lambda w: w != "")
    each = docs.select("slug", words.alias("w")).join(F.broadcast(lengths)).select("slug", "w", F.explode("lengths").alias("n")).filter(F.size("w") >= F.col("n"))
    # windows are cut inside of the row: one that came out beside its words would copy all of them
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    windows = each.select("slug", "n", F.explode(cut).alias("window")).select("slug", "n", F.sha2("window", 256).alias("digest"))
    return windows.join(denied.select(F.col("n").cast("int").alias("n"), "digest").distinct(), ["n", "digest"]).groupBy("slug", "n", "digest").agg(F.count("*").alias("hits"))


def slugs(paths: DataFrame, most: int = 40) -> DataFrame:
    """File names as slugs; repeated ones get -2, -3 and so on, by path."""
    from pyspark.sql.window import Window as W

    base = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "[^A-Za-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(F.lower(base), "^-|-$", ""), 1, most)
    ranked = paths.withColumn("_s", cut).withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("path")))
    return ranked.select("path", F.when(F.col("_r") == 1, F.col("_s")).otherwise(F.concat("_s", F.lit("-"), F.col("_r").cast("string"))).alias("slug"))


def corpus_entries(files: DataFrame) -> DataFrame:
    """(path, content) of a tree as entries of a new corpus: slug, hash, size, and whether another path has the same content."""
    from pyspark.sql.window import Window as W

    told = files.select("path", F.sha2("content", 256).alias("source_sha256"), F.octet_length("content").alias("bytes")).join(slugs(files.select("path")), "path")
    return told.select("path", "slug", "source_sha256", "bytes", (F.count("*").over(W.partitionBy("source_sha256")) > 1).alias("twice"))

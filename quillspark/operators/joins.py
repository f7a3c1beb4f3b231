"""Containment, as-of, interval, similarity and comparison joins (2.F)."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.functions.scale import COVERAGE, Scale
from quillspark.operators.durable import written

#: Rows of a side that is broadcast for a theta join; more are refused by contains_join() and cut by blocks elsewhere.
SMALL = 50_000


def fits(df: DataFrame, most: int = SMALL) -> bool:
    """Whether a side of an equi join is small enough to be broadcast; a larger one is left to a shuffle."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcasts a side after checking its size; a larger side is an error, because a theta join over it isn't linear."""
    if not fits(df, most):
        raise ValueError(f"a theta join takes at most {most} rows on its small side")
    return F.broadcast(df)


def contains_join(lines: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """lines with each term they contain, without regard to case."""
    return lines.join(small(terms), F.contains(F.lower(F.col(text)), F.lower(F.col(term))))


def expand_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, term) with every variant: the whole term's, and each single word's within the phrase.

    A term is expanded once however many rows bear it, and its forms are distinct before they meet the rows: a task never holds a
    set of rows that have come out. Only rows of an id that has several terms can come out equal, and are made distinct again.
    """
    low = terms.select("id", F.lower("term").alias("term"))
    lex = lexicon.select(F.col("term").alias("key"), F.lower("variant").alias("variant")).distinct()
    known = low.select("term").distinct()
    whole = known.join(lex, F.col("term") == F.col("key")).select("term", F.col("variant").alias("form"))
    parts = known.select("term", F.regexp_extract_all("term", F.lit(r"\w+|\W+"), F.lit(0)).alias("parts"))
    each = parts.select("term", "parts", F.posexplode("parts").alias("pos", "word")).join(lex, F.col("word") == F.col("key"))
    swapped = F.array_join(F.transform("parts", lambda p, i: F.when(i == F.col("pos"), F.col("variant")).otherwise(p)), "")
    every = known.select("term", F.col("term").alias("form")).unionByName(whole).unionByName(each.select("term", swapped.alias("form")))
    forms = written(every.distinct(), "forms")
    own = low.groupBy("id").agg(F.collect_set("term").alias("terms"), F.count_if(F.col("term").isNull()).alias("nulls"))
    own = own.select("id", F.explode(F.when(F.col("nulls") > 0, F.array_append("terms", F.lit(None).cast("string"))).otherwise(F.col("terms"))).alias("term"), (F.size("terms") + (F.col("nulls") > 0).cast("int") > 1).alias("several"))
    met = own.join(forms, own["term"].eqNullSafe(forms["term"])).select("id", F.col("form").alias("term"), "several")
    return met.filter(~F.col("several")).select("id", "term").unionByName(met.filter("several").select("id", "term").distinct())


def compare_judges(a: DataFrame, b: DataFrame, key: str = "id", scale: Scale = COVERAGE) -> DataFrame:
    """A's rows with B's verdict and how they agree."""
    return a.select(key, F.col("verdict").alias("a")).join(b.select(key, F.col("verdict").alias("b")), key, "left").withColumn("agreement", scale.pair(F.col("a"), F.col("b")))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "obligation", scale: Scale = COVERAGE) -> DataFrame:
    """Both runs' verdicts by key; only in one, identical or moved, and how far."""
    both = a.select(key, F.col("verdict").alias("a")).join(b.select(key, F.col("verdict").alias("b")), key, "full_outer")
    change = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").when(F.col("a") == F.col("b"), "identical").otherwise("moved")
    return both.withColumn("change", change).withColumn("distance", F.when(F.col("change") == "moved", scale.distance(F.col("a"), F.col("b"))))


def answered_by_all(verdicts: DataFrame, key: str = "id", reader: str = "model") -> DataFrame:
    """keys that every reader has answered."""
    readers = verdicts.agg(F.count_distinct(reader).alias("readers"))
    each = verdicts.groupBy(key).agg(F.count_distinct(reader).alias("n"))
    return each.join(F.broadcast(readers), F.col("n") == F.col("readers")).select(key)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """what is left to do of a resumed run."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """pairs of spans that overlap: a(key, a_first, a_last), b(key, b_first, b_last).

    Spans are put into every bucket of width that they touch and joined by bucket; the pair counts in the bucket where the
    later one begins, so each comes once and no cross join is needed.
    """
    cut = lambda df, p: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_first") / width), F.floor(F.col(f"{p}_last") / width))))
    met = cut(a, "a").join(cut(b, "b"), [key, "_bucket"])
    return met.filter((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")) & (F.col("_bucket") == F.floor(F.greatest("a_first", "b_first") / width))).drop("_bucket")


def asof(events: DataFrame, marks: DataFrame, key: str, at: str, value: str, back: Column | None = None) -> DataFrame:
    """each event with the last mark at or before it; one sort by key, no pairs. back: the oldest time that counts."""
    both = events.select("*", F.lit(None).cast(marks.schema[value].dataType).alias("_v"), F.lit(None).cast(marks.schema[at].dataType).alias("_at"), F.lit(1).alias("_o")).unionByName(
        marks.select(key, at, F.col(value).alias("_v"), F.col(at).alias("_at"), F.lit(0).alias("_o")), allowMissingColumns=True
    )
    order = W.partitionBy(key).orderBy(at, "_o").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_o") == 0, F.struct("_v", "_at")), ignorenulls=True).over(order)
    out = both.withColumn("_m", last).filter("_o = 1")
    fits = F.lit(True) if back is None else F.col("_m._at") >= back
    return out.select(*events.columns, F.when(fits, F.col("_m._v")).alias(value), F.when(fits, F.col("_m._at")).alias(f"{value}_at"))


#: Items and queries of a block; one block of each meets in a task's group, STRIP queries at a time.
ITEM_BLOCK, QUERY_BLOCK, STRIP = 16_384, 1_024, 128


def _matrix(column: pa.ChunkedArray, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in double precision, padded with zeros, and their lengths. One that is null or holds a null is all zeros, its likeness is 0."""
    held = pa.concat_arrays(column.cast(pa.list_(pa.float64())).chunks)
    length = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    flat = held.flatten()
    inside = np.arange(max(width, int(length.max(initial=0)))) < length[:, None]
    out, lost = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    out[inside], lost[inside] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    out[lost.any(axis=1)] = 0
    return out, length


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows' products, added in the order in which T.dot adds, so that they are the same to the bit."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _of_block(q: pa.Table, v: pa.Table, k: int | None, least: float | None, slack: float, later_wins: bool) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and items and their cosines: at least the k best of each query, or all from least on. The product of matrices finds them, with slack."""
    items, li = _matrix(v["_v"])
    queries, lq = _matrix(q["_q"], items.shape[1])
    items = np.pad(items, ((0, 0), (0, queries.shape[1] - items.shape[1])))
    ni, nq = np.sqrt(_dots(items, items)), np.sqrt(_dots(queries, queries))
    unit = items / np.where(ni > 0, ni, 1)[:, None]
    place = np.zeros(len(items), np.int64)
    if not pa.types.is_nested(v["item_id"].type):
        place[pc.sort_indices(v["item_id"], sort_keys=[("", "descending" if later_wins else "ascending")]).to_numpy()] = np.arange(len(items))
    for at in range(0, len(queries), STRIP):
        part = slice(at, at + STRIP)
        about = np.nan_to_num((queries[part] / np.where(nq[part] > 0, nq[part], 1)[:, None]) @ unit.T, nan=np.inf)
        about[(lq[part][:, None] != li) & (nq[part][:, None] > 0) & (ni > 0)] = -2  # of unequal lengths: null, behind all others
        if k is None:
            from_ = least - slack
        else:
            n = min(k, len(items))
            from_ = np.partition(about, len(items) - n, axis=1)[:, len(items) - n][:, None] - slack
        a, b = np.nonzero(about >= from_ - 1e-9)
        a += at
        size = nq[a] * ni[b]
        score = np.where(size <= 0, 0.0, np.where(lq[a] != li[b], -np.inf, _dots(queries[a], items[b]) / np.where(size == 0, 1, size)))
        if k is not None:
            down = np.where(np.isnan(score), -np.inf, -score)
            order = np.lexsort((place[b], down, a))
            a, b, score, down = a[order], b[order], score[order], down[order]
            if not pa.types.is_nested(v["item_id"].type):  # of equal scores no more than k can be among the k best
                new = np.r_[True, (a[1:] != a[:-1]) | (down[1:] != down[:-1])]
                few = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k
                a, b, score, down = a[few], b[few], score[few], down[few]
            new = np.r_[True, a[1:] != a[:-1]]
            first = np.flatnonzero(new)
            last = np.minimum(first + k, np.r_[first[1:], len(a)]) - 1
            good = down <= down[last][np.cumsum(new) - 1] + slack
            a, b, score = a[good], b[good], score[good]
        yield a, b, score


def likeness(queries: DataFrame, items: DataFrame, k: int | None = None, least: float | None = None, slack: float = 0.0, on: tuple[str, ...] = (), later_wins: bool = True) -> DataFrame:
    """query_id, item_id, on and score, the cosine, of queries (query_id, _q, on) and items (item_id, _v, on): of each query the k best items, or the
    items from least on; slack keeps those that a rounding could lift. A few more of each query may come, the caller ranks them.

    Both sides are dealt to blocks by their ids and meet block by block, so neither is broadcast or gathered, and a task holds one block of each.
    """
    blocks = lambda df, size: max(1, math.ceil(df.count() / size))
    nq, ni = blocks(queries, QUERY_BLOCK), blocks(items, ITEM_BLOCK)
    spark = queries.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*on, "_bq", "_bi"]
    q = queries.select("query_id", "_q", *on, F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("_bq"), each(ni).alias("_bi")).repartition(parts, *keys)
    v = items.select("item_id", "_v", *on, F.pmod(F.xxhash64("item_id"), F.lit(ni)).cast("int").alias("_bi"), each(nq).alias("_bq")).repartition(parts, *keys)
    names = ["query_id", "item_id", *on, "score"]
    kinds = {**{f.name: f.dataType for f in v.schema}, "query_id": q.schema["query_id"].dataType, "score": DoubleType()}
    schema = StructType([StructField(n, kinds[n]) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_of_block(left, right, k, least, slack, later_wins)) if len(left) and len(right) else []
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([left["query_id"].take(pa.array(a)), right["item_id"].take(pa.array(b)), *[right[c].take(pa.array(b)) for c in on], pa.array(score, mask=np.isneginf(score))], names=names)

    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(run, schema)


def top_k(queries: DataFrame, items: DataFrame, k: int = 12, vector: str = "embedding", later_wins: bool = True, digits: int | None = None) -> DataFrame:
    """The k items of highest cosine for each query; equal scores prefer the higher index (or the lower).
    With digits, scores are rounded before they are ranked. Blocks keep their own k best of every query before anything is ranked.
    """
    slack = 0.0 if digits is None else 1.1 * 10.0**-digits
    scored = likeness(queries.select("query_id", F.col(vector).alias("_q")), items.select("item_id", F.col(vector).alias("_v")), k, slack=slack, later_wins=later_wins)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    second = F.col("item_id").desc() if later_wins else F.col("item_id").asc()
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), second)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def section_top_k(queries: DataFrame, items: DataFrame, k: int = 12, sections: int = 3) -> DataFrame:
    """two stages. A section is scored by the mean vector of its items; of the best sections, the first item of each and its
    k // sections best ones, each once, k + sections at most, in the order of sections."""
    mean = items.select("section", F.posexplode("embedding").alias("d", "x")).groupBy("section", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(F.col("section").alias("item_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("embedding"))
    best = written(top_k(queries, whole, sections, digits=6).select("query_id", F.col("item_id").alias("section"), F.col("rank").alias("place")), "best")
    asked = best.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    few = max(1, k // sections)
    inner = likeness(asked.select("query_id", "section", "_q"), items.select("section", "item_id", F.col("embedding").alias("_v")), few, slack=1.1e-6, on=("section",)).withColumn("score", F.round("score", 6))
    r = F.row_number().over(W.partitionBy("query_id", "section").orderBy(F.col("score").desc(), F.col("item_id").desc()))
    inner = inner.withColumn("r", r).filter(F.col("r") <= few).join(best, ["query_id", "section"])
    first = items.groupBy("section").agg(F.min_by(F.struct("item_id", "embedding"), "item_id").alias("f")).select("section", F.col("f.item_id").alias("opening"), F.col("f.embedding").alias("_v"))
    opening = asked.join(first, "section").select("query_id", "section", "place", F.col("opening").alias("item_id"), F.round(T.cosine(F.col("_q"), F.col("_v")), 6).alias("score"), F.lit(0).alias("r"))
    others = inner.join(first.select("section", F.col("opening").alias("item_id")), ["section", "item_id"], "left_anti")
    kept = opening.unionByName(others.select(*opening.columns))
    order = W.partitionBy("query_id").orderBy("place", "r")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + sections).select("query_id", "item_id", "section", "score", "rank")


def holding(docs: DataFrame, passages: DataFrame, text: str = "text", passage: str = "passage") -> DataFrame:
    """F01 by case: rows of docs with each passage they contain, by a run of letters and digits instead of a search for every passage in every text.

    A run inside of a passage, with other characters on both sides, is a whole run of each text that contains it. Each passage has its
    longest one; a text's runs that are among them name the passages to look for. Passages without such a run are looked for in all texts.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(passage, "^[A-Za-z0-9]+", ""), r"[A-Za-z0-9]+\z", "")
    longest = F.array_max(F.transform(runs(bare), lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))))["r"]
    asked = passages.withColumn("_run", longest)
    keyed, other = asked.filter("_run IS NOT NULL"), asked.filter("_run IS NULL").drop("_run")
    wanted = small(keyed.agg(F.array_sort(F.collect_set("_run")).alias("_runs")))
    met = docs.join(wanted).withColumn("_run", F.explode(F.array_intersect(runs(F.col(text)), F.col("_runs")))).drop("_runs")
    met = met.join(small(keyed), "_run").drop("_run").filter(F.contains(text, passage))
    return met if other.isEmpty() else met.unionByName(docs.join(small(other), F.contains(text, passage)))


def longest_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """the canonical name whose longest alias a name contains; ties go to the earlier alias."""
    met = names.join(small(aliases.withColumn("_pos", F.monotonically_increasing_id() if "pos" not in aliases.columns else F.col("pos"))), F.contains(F.lower("name"), F.lower("alias")), "left")
    best = F.max_by("canonical", F.struct(F.char_length("alias"), -F.col("_pos")))
    return met.groupBy("name").agg(best.alias("canonical"))


def lexical_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sum over shared terms of idf times the lesser count, idf = sqrt(N / (1 + df)); an equi join on terms.

    Terms that are asked for are dealt by their chunk, once for both idf and scores; counting them and adding the scores shuffles nothing more.
    """
    q = queries.select("query_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    held = F.broadcast if fits(q) else lambda df: df
    # stop words aren't asked for, so they go with all others
    asked = chunks.select("chunk_id", F.explode(T.terms(F.col("text"), ())).alias("term")).join(held(q.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    d = asked.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    total = chunks.agg(F.count("*").alias("n"))
    idf = d.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", F.sqrt(F.col("n") / (F.col("df") + 1)).alias("idf"))
    return d.join(held(q.join(idf, "term")), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.least("qf", "tf")).alias("score"))


#: Characters of a block of lexical_top(), and cells of the matrix of chunks and queries, or terms met, that a task holds at once.
BLOCK_CHARS, CELLS = 4_000_000, 4_000_000


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A column's values as numbers of its distinct ones."""
    held = pa.chunked_array(column.chunks, column.type).combine_chunks().dictionary_encode(null_encoding="encode")
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary


def _best_of_block(asked: pa.Table, weights: pa.Table, k: int, slack: float) -> pa.Table:
    """query_id, chunk_id and score: at least the k best chunks of a block for each query."""
    (c, chunks), (t, terms), (q, queries) = _numbered(asked["chunk_id"]), _numbered(weights["term"]), _numbered(weights["query_id"])
    place = np.zeros(len(chunks), np.int64)
    place[pc.sort_indices(chunks, sort_keys=[("", "descending")]).to_numpy()] = np.arange(len(chunks))
    by = np.argsort(t, kind="stable")
    q, qf, idf = q[by], weights["qf"].to_numpy()[by], weights["idf"].to_numpy()[by]
    size = np.bincount(t, minlength=len(terms))
    begin = np.cumsum(size) - size
    pair, tf = np.unique(c * len(terms) + pc.index_in(asked["term"], value_set=terms).to_numpy(), return_counts=True)
    c, t = np.divmod(pair, len(terms))
    met = int(size[t].sum())
    strip, out = max(1, min(CELLS // len(queries), CELLS * len(chunks) // max(1, met))), []
    for at in range(0, len(chunks), strip):
        part = slice(*np.searchsorted(c, [at, at + strip]))
        times = size[t[part]]
        w = np.repeat(begin[t[part]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        rows = min(strip, len(chunks) - at)
        cell = (np.repeat(c[part], times) - at) * len(queries) + q[w]
        score = np.bincount(cell, idf[w] * np.minimum(qf[w], np.repeat(tf[part], times)), rows * len(queries)).reshape(rows, -1)
        least = np.partition(score, rows - k, axis=0)[rows - k] - slack if rows > k else 0.0
        a, b = np.nonzero((score > 0) & (score >= least))
        score = score[a, b]
        order = np.lexsort((place[a + at], -score, b))
        a, b, score = a[order] + at, b[order], score[order]
        # of equal scores no more than k can be among the k best
        new = np.ones(len(a), bool)
        new[1:] = (b[1:] != b[:-1]) | (score[1:] != score[:-1])
        few = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k if len(a) else new
        out.append((a[few], b[few], score[few]))
    a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([queries.take(pa.array(b)), chunks.take(pa.array(a)), pa.array(score)], names=["query_id", "chunk_id", "score"])


def lexical_top(queries: DataFrame, chunks: DataFrame, k: int = 12, digits: int = 6) -> DataFrame:
    """lexical_scores() of the k best chunks of each query and a few more, which the caller rounds to digits and ranks; equal scores prefer the higher chunk_id.

    Asked terms are dealt to blocks of chunks by hash, once for both idf and scores; each block meets all queries' terms and gives its own
    best, so pairs of a query and a chunk are neither shuffled nor sorted. Ids are plain values.
    """
    q = queries.select("query_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    held = F.broadcast if fits(q) else lambda df: df
    n, chars = chunks.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    spark = queries.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = chunks.select("chunk_id", F.explode(T.terms(F.col("text"), ())).alias("term")).join(held(q.select("term").distinct()), "term", "left_semi")
    asked = asked.select("chunk_id", "term", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("_b")).repartition(parts, "_b")

    def counted(rows: pa.Table) -> pa.Table:
        each = rows.group_by(["chunk_id", "term"], use_threads=False).aggregate([])
        return each.group_by("term", use_threads=False).aggregate([([], "count_all")]).rename_columns(["term", "df"])

    df = asked.groupBy("_b").applyInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = q.join(held(df.select("term", F.sqrt(F.lit(float(n)) / (F.col("df") + 1)).alias("idf"))), "term")
    dealt = weights.select("query_id", "term", "qf", "idf", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).repartition(parts, "_b")
    kind = lambda frame, name: frame.schema[name].dataType
    schema = StructType([StructField("query_id", kind(queries, "query_id")), StructField("chunk_id", kind(chunks, "chunk_id")), StructField("score", DoubleType())])
    slack = 1.1 * 10.0**-digits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            return _best_of_block(left, right, k, slack)
        return pa.table([pa.array([], right.schema.field("query_id").type), pa.array([], left.schema.field("chunk_id").type), pa.array([], pa.float64())], names=["query_id", "chunk_id", "score"])

    return asked.groupBy("_b").cogroup(dealt.groupBy("_b")).applyInArrow(run, schema)


def fused(*ranked: DataFrame, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over rankings (query_id, item_id, rank from 1 by row_number; counted from 0)."""
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return every.groupBy("query_id", "item_id").agg(F.sum(1.0 / (constant + F.col("rank") - 1)).alias("score"))

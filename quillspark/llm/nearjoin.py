"""Jaccard join on word n-grams with Bayesian pruning (op 9).

Texts with equal sets of n-grams are one class from the start. MinHash bands bring the others together; the
candidates of a connected group are compared block by block: MinHash values are read a few at a time, and a
pair is dropped once its posterior probability of reaching the threshold is below a tolerance. What is left is
verified on the n-gram sets. Links are counted, never listed, so a large group costs blocks instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside, materialise, prepare, sorted_groups, texts
from quillspark.llm.components import components

#: Words in an n-gram and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values: bands of rows. A pair at the threshold shares no band with probability (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
#: Values read before the next pruning, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-7
#: Texts and n-grams in a block, about.
BLOCK_TEXTS, BLOCK_GRAMS = 400, 400_000

_HASHES = BANDS * ROWS
_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(0, 2**31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, _HASHES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 2**63, max(WORDS, ROWS) + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[-1]
    return h ^ (h >> np.uint64(29))


def gram_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words (parts between white space); a shorter text is one n-gram, a blank one has none."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = max(1, len(words) - n + 1)
    total = np.zeros(size, np.uint64)
    for k in range(min(n, len(words))):
        total += _mix(h[k : k + size]) * _ODD[k]
    return np.unique(_mix(total))


def sketch(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        np.minimum(out, (_TIMES[:, None] * part[None, :] + _PLUS[:, None]).min(axis=1), out=out)
    return out


def bands_of(values: np.ndarray) -> np.ndarray:
    table = values.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64) * _ODD[ROWS]
    for k in range(ROWS):
        total = _mix(total + table[:, k] * _ODD[k])
    return total.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After h values: the fewest matches at which P(similarity >= threshold) is tolerance or more, from an even prior.

    The posterior is Beta(m + 1, h - m + 1); its tail above t is the chance of at most m successes in h + 1 draws.
    """
    out = {}
    for h in range(STEP, _HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[h] = m
    return out


def compare(left: np.ndarray, right: np.ndarray, signatures: np.ndarray, sizes: np.ndarray, threshold: float, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of candidates that pruning leaves."""
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fits = small >= threshold * large
    left, right = left[fits], right[fits]
    matches = np.zeros(len(left), np.int32)
    for h in range(STEP, _HASHES + 1, STEP):
        matches += (signatures[left, h - STEP : h] == signatures[right, h - STEP : h]).sum(axis=1, dtype=np.int32)
        keep = matches >= limits[h]
        if not keep.all():
            left, right, matches = left[keep], right[keep], matches[keep]
        if not len(left):
            break
    return left, right


def verify(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold. Many pairs of few texts are counted by a matrix product over n-grams that two texts share."""
    sizes = np.array([len(x) for x in sets])
    if len(left) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    else:
        own = np.repeat(np.arange(len(sets)), sizes)
        grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        use = counts[inverse] > 1
        rows, cols = own[use], shared[inverse[use]]
        total = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, 2048):
            a, b = np.searchsorted(cols, [at, at + 2048])
            table = np.zeros((len(sets), 2048), np.float32)
            table[rows[a:b], cols[a:b] - at] = 1
            total += table @ table.T
        common = total[left, right].astype(np.int64)
    # common / union >= threshold, in whole numbers of a ten-thousandth
    return common * 10_000 >= round(threshold * 10_000) * (sizes[left] + sizes[right] - common)


def _compare_group(threshold: float, limits: dict[int, int]):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("u")
        first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        ids, copies = rows["u"].to_numpy(), rows["copies"].to_numpy()
        signatures = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), _HASHES)
        sizes, block = rows["n"].to_numpy(), rows["block"].to_numpy()
        if first == second:
            left, right = np.triu_indices(len(rows), 1)
        else:
            a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        left, right = compare(left, right, signatures, sizes, threshold, limits)
        if len(left):
            used, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
            sets = [gram_set(x) for x in rows["text"].iloc[used]]
            good = verify(inverse[: len(left)], inverse[len(left) :], sets, threshold)
            left, right = left[good], right[good]
        if not len(left):
            return pd.DataFrame({"u": ids[:0], "links": ids[:0], "root": ids[:0]})
        links = np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))
        label = ids.copy()
        while True:  # least id within the block pair
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            if (new == label).all():
                break
            label = new
        some = links > 0
        return pd.DataFrame({"u": ids[some], "links": links[some].astype(np.int64), "root": label[some]})

    return each


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __text_key (MD5 of the text) and __row_key (MD5 of doc_id and text: rows with an equal one are copies of one row)."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text).cast("binary"))
    return docs.withColumn("__text_key", F.unhex(text)).withColumn("__row_key", F.unhex(row))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, __text_key, __row_key, set_key (128 bits of the n-gram set), n, sig and bands of every text."""

    def each(batch: list[str]) -> list[tuple]:
        out = []
        for grams in map(gram_set, batch):
            key = xxhash.xxh3_128_digest(grams.tobytes())
            if len(grams):
                values = sketch(grams)
                out.append((key, len(grams), (values & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), bands_of(values).tolist()))
            else:
                out.append((key, 0, b"", []))
        return out

    return beside(keyed(texts(docs.select("doc_id", "text"))), ["doc_id", "__text_key", "__row_key"], "text", each, "set_key binary, n long, sig binary, bands array<long>")


def whole_texts(docs: DataFrame) -> DataFrame:
    """__row_key and text, each row once: copies of a row are put together before and after the one shuffle, by key."""
    return keyed(texts(docs.select("doc_id", "text"))).groupBy("__row_key").agg(F.first("text").alias("text"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, __row_key, class_id, n_links, n_copies and rep of every row.

    A link joins two rows whose sets of five-word n-grams have a Jaccard similarity of threshold or more; rows with
    equal sets are linked. class_id is the least doc_id that links lead to, n_links the number of other rows linked to
    this one, n_copies those of them with an equal set, rep whether the row is the least of its class by doc_id and text.
    Null and blank texts have no n-gram and are equal to each other only. Repeated rows are copies; a null doc_id is
    less than any other; ties in doc_id are ordered by the text's MD5; further columns are left out; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = materialise(sketched(docs), "sketches")
    sets = (
        rows.groupBy("set_key")
        .agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "__text_key", "__row_key")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("u", F.monotonically_increasing_id())
    )
    sets = materialise(sets, "sets")
    banded = sets.select("u", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("u").alias("m"), F.count("*").alias("c")).filter("c > 1")
    stars = banded.join(shared.select("band", "m"), "band").filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
    groups = materialise(components(stars), "candidates")

    # blocks: a group of m texts becomes about m / BLOCK_TEXTS blocks, every two of which meet once
    members = sets.select("u", "copies", "n", "sig", "least").join(groups, F.col("u") == F.col("v"))
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).alias("count"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("u"), F.col("count")))
    with_text = placed.withColumn("__row_key", F.col("least.__row_key")).join(whole_texts(docs), "__row_key").select("root", "count", "block", "u", "copies", "n", "sig", "text")
    met = with_text.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "u", "copies", "n", "sig", "text"
    )
    found = materialise(sorted_groups(met, ["root", "i", "j"], _compare_group(threshold, least_matches(threshold)), "u long, links long, root long"), "links")

    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("u").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("u"), "root")
    named = sets.select("u", "set_key", "copies", "least").join(links, "u", "left").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    classes = named.join(heads, "root").select("set_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    return rows.select("doc_id", "__row_key", "set_key").join(classes, "set_key").select(
        "doc_id",
        "__row_key",
        F.col("head.doc_id").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"),
        (F.col("__row_key") == F.col("head.__row_key")).alias("rep"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, with the columns of docs: the least by doc_id (null first), then by text.

    Of rows with the same doc_id and text, which one's further columns stay isn't fixed. Copies of a row are put
    together before they are shuffled, so a row that is a third of the table is no hot key.
    """
    prepare(docs.sparkSession)
    reps = near_duplicates(docs, threshold).filter("rep").select("__row_key").distinct()
    return keyed(docs).dropDuplicates(["__row_key"]).join(reps, "__row_key").select(*docs.columns)


#: DuckDB's way: every pair that shares an n-gram, then all that links lead to. Blank texts are equal to each other.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN ['  '] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON r.root = p.a)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.doc_id) AS n_links,
       (SELECT count(*) FROM p WHERE p.a = d.doc_id AND same) AS n_copies FROM documents d
"""

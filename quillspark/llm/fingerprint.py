"""Similarity digests from improbable features (op 6).

Every window of WINDOW bytes has an entropy; windows are ranked by how rare their entropy is in text. In each
run of RUN windows the rarest, leftmost one gets a vote; windows with enough votes are features. Features go
into a chain of Bloom filters, a new one after FILL features. Digests are compared filter by filter: the share of
common bits beyond what chance gives, the best partner of each filter, averaged over the shorter chain. One rule
holds at every length: a text of few runs asks for no more votes than it has runs, and one of fewer bytes than a
window is one window, filled up with zeros.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside, materialise, prepare, texts

WINDOW, RUN, VOTES = 16, 32, 8
#: Bits of a filter, hashes of a feature, features of a filter.
BITS, HASHES, FILL = 2048, 5, 160
#: Entropies in thousandths of log2(WINDOW) bits; those below WEAK (a few letters over and over) are features only for want of others.
LEVELS, WEAK = 1000, 100
#: The usual entropy of a window of text, in the same unit: the median over the windows of sample prose. Rarity is the distance from it.
USUAL = 788
#: Bytes that are worked on at once.
CHUNK = 2_000_000
#: Documents of one range of ids; ranges grow in number with the table.
RANGE_ROWS = 20_000

_COUNTS = np.arange(WINDOW + 1, dtype=np.float64)
#: What the n-th like byte in a window adds to sum(c log2 c), in 2 ** -20; whole numbers make sums exact.
_ADDED = np.zeros(WINDOW + 2, np.int64)
_ADDED[1 : WINDOW + 1] = np.round(np.diff(np.concatenate([[0.0], _COUNTS[1:] * np.log2(_COUNTS[1:])])) * 2**20).astype(np.int64)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(9)], np.uint64)


def ranks(data: np.ndarray) -> np.ndarray:
    """Of the window at each place: how usual its entropy is; low is rare, weak windows come last."""
    n = len(data)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for lag in range(1, WINDOW):
        if lag >= n:
            break
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    # sum(c log c) of the first window, then what leaves and what comes
    first = np.bincount(data[:WINDOW], minlength=256)
    begin = int(sum(int(_ADDED[1 : c + 1].sum()) for c in first if c))
    moved = _ADDED[behind[WINDOW:]] - _ADDED[ahead[: n - WINDOW]]
    total = np.concatenate([[0], np.cumsum(moved)]) + begin
    most = float(np.log2(WINDOW))
    entropy = most - total / (WINDOW * 2.0**20)
    level = np.clip((entropy * (LEVELS / most)).astype(np.int64), 0, LEVELS)
    usual = LEVELS - np.minimum(np.abs(level - USUAL), LEVELS - 1)
    return np.where(level < WEAK, LEVELS + 1, usual)


def _features(data: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Places of the features of each span (start, end) of data; a span has a window at least, and its choice depends on its own bytes only."""
    rank = ranks(data)
    n = len(rank)
    key = (rank << 40) | np.arange(n)
    least, width = key, 1
    while width < RUN and len(least) > width:  # RUN is a power of 2
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    winners = least & ((1 << 40) - 1)
    out = []
    for a, b in spans:
        windows = b - a - WINDOW + 1
        runs = windows - RUN + 1
        if runs < 1:  # all of its windows are one run
            out.append(np.array([a + int(key[a : a + windows].argmin())]))
            continue
        votes = np.bincount(winners[a : a + runs] - a, minlength=windows)
        enough = votes >= min(VOTES, runs)
        if not enough.any():
            enough = votes == votes.max()
        strong = enough & (rank[a : a + windows] <= LEVELS)
        out.append(np.flatnonzero(strong if strong.any() else enough) + a)
    return out


def _positions(words: np.ndarray) -> np.ndarray:
    """Bits of each feature: words holds its bytes as numbers of eight bytes."""
    with np.errstate(over="ignore"):
        mixed = (words * _ODD[None, : words.shape[1]]) ^ (words >> np.uint64(29))
        h = mixed.sum(axis=1, dtype=np.uint64)
        out = []
        for k in range(HASHES):
            h = (h ^ (h >> np.uint64(31))) * _ODD[8 - k % 3]
            h ^= h >> np.uint64(27)
            out.append((h >> np.uint64(k)) % np.uint64(BITS))
    return np.stack(out, axis=1).astype(np.int64)


def _chain(bits: np.ndarray) -> np.ndarray:
    table = np.zeros((-(-len(bits) // FILL), BITS), np.uint8)
    table[np.repeat(np.arange(len(bits)) // FILL, HASHES), bits.ravel()] = 1
    return np.packbits(table, axis=1)


def digests(items: list[bytes]) -> list[np.ndarray]:
    """A chain of filters (m x BITS / 8 bytes) for each text's bytes; empty ones have no filter."""
    out: list[np.ndarray] = [np.empty((0, BITS // 8), np.uint8)] * len(items)
    at = 0
    while at < len(items):
        stop, size = at, 0
        while stop < len(items) and (stop == at or size + len(items[stop]) <= CHUNK):
            size += len(items[stop])
            stop += 1
        held = [(k, items[k].ljust(WINDOW, b"\0")) for k in range(at, stop) if items[k]]
        if held:
            data = np.frombuffer(b"".join(x for _, x in held), np.uint8)
            ends = np.cumsum([len(x) for _, x in held])
            spans = [(int(e) - len(x), int(e)) for e, (_, x) in zip(ends, held, strict=True)]
            view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
            for (k, _), places in zip(held, _features(data, spans), strict=True):
                out[k] = _chain(_positions(np.ascontiguousarray(view[places]).view("<u8")))
        at = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Two empty digests are alike, an empty and another one aren't; equal digests are wholly alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    common = x @ y.T
    chance = np.outer(nx, ny) / BITS
    most = np.minimum(nx[:, None], ny[None, :])
    score = np.clip((common - chance) / np.maximum(most - chance, 1), 0, 1)
    # a last filter with few bits shares them with anything: filters weigh by their bits
    return float((score.max(axis=1) * nx).sum() / nx.sum())


def shown(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text: the general form, with no shuffle. Null counts as empty."""
    prepare(docs.sparkSession)
    return beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", lambda batch: [(shown(x),) for x in digests([t.encode("utf-8") for t in batch])], "fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _finish(pairs: list[tuple]) -> pd.DataFrame:
    """pairs: (doc_id, text, digest, next text, next digest)"""
    new = [edited(t, u).encode("utf-8") for _, t, _, u, _ in pairs]
    changed = digests(new)
    rows = [
        (i, len(t), hashlib.sha256(x).hexdigest(), shown(d), shown(c), likeness(d, c), likeness(d, e))
        for (i, t, d, _, e), x, c in zip(pairs, new, changed, strict=True)
    ]
    return pd.DataFrame(rows, columns=_NAMES)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order: finished ones, and the first and the last text, which need the range before or after it."""
    last, part = None, 0

    def edge(kind: str, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([(row[0], *[None] * 6, part, kind, row[1])], columns=[*_NAMES, "part", "kind", "text"])

    for batch in batches:
        if not len(batch):
            continue
        own = digests([x.encode("utf-8") for x in batch["text"]])
        rows = list(zip(batch["doc_id"], batch["text"], own, strict=True))
        if last is None:
            part = int(batch["part"].iloc[0])
            yield edge("first", rows[0])
        else:
            rows.insert(0, last)
        if len(rows) > 1:
            done = _finish([(*a, b[1], b[2]) for a, b in zip(rows, rows[1:])])
            yield done.assign(part=part, kind="done", text=None)
        last = rows[-1]
    if last is not None:
        yield edge("last", last)


def fingerprint_edits(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A text's
    edit takes its second half from the next document by doc_id (null ids come first, ties go by the text's hash),
    and the last is followed by the first. Null texts count as empty: no filter, alike only to other empty ones.
    Repeated rows follow each other; further columns are left out; an empty table gives no rows.

    Texts are shuffled once, to ranges of ids of about range_rows documents, more ranges for more documents; equal
    ids are split by hash and place, so one id may hold most rows. A task walks over its range and holds a batch. The
    first and the last text of each range are written beside the results and meet in a join on the ranges' numbers.
    """
    spark = prepare(docs.sparkSession)
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ranges = max(1, -(-rows.count() // range_rows))
    order = ["doc_id", "_hash", "_place"]
    placed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # ids go through pandas as text: a batch with a null would make floats of them
    walked = placed.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInPandas(_walk, f"{_RESULT}, part int, kind string, text string")
    walked = materialise(walked, "digests")

    # the ranges that hold rows, in order: one number each; the last one's next is the first
    held = sorted(r["part"] for r in walked.filter("kind = 'first'").select("part").collect())
    after = [(p, held[(k + 1) % len(held)]) for k, p in enumerate(held)]
    following = spark.createDataFrame(after, "part int, next int")
    firsts = walked.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = walked.filter("kind = 'last'").select("doc_id", "text", "part").join(following, "part").join(firsts, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = digests([x.encode("utf-8") for x in batch["text"]])
            then = digests([x.encode("utf-8") for x in batch["following"]])
            if len(batch):
                yield _finish(list(zip(batch["doc_id"], batch["text"], own, batch["following"], then, strict=True)))

    every = walked.filter("kind = 'done'").select(*_NAMES).unionByName(ends.mapInPandas(close, _RESULT))
    return every.withColumn("doc_id", F.col("doc_id").cast("long"))

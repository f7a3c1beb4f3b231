"""Periodic run detection (op 13): block matching with pyahocorasick over sequences of word numbers.

For each power of two b, a document's words are cut into aligned blocks of b. A run with a period from b to 2b - 1 that
goes round four times has such a block among the words of its first two periods, and that block comes again one period later. So the
blocks are searched across the document by an automaton, and an occurrence at a distance from b to 2b - 1 is a seed, which
is extended to both sides exactly, as long as words a period apart are equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words at least, and goes round so many times.
MIN_LENGTH, ROUNDS = 6, 4
#: Words that one automaton's search goes over at most, but for four times its blocks' length.
REACH = 1 << 16


def numbers(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers, in order of first occurrence."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def recurs(ids: np.ndarray) -> np.ndarray:
    """How far on the same word comes again; the length of the document and more where it doesn't."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), 2 * len(ids) + 2, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretch(ids: np.ndarray, a: int, q: int, step: int) -> int:
    """How many places from a on (or before a, for step -1) in a row hold the word that stands q later. Compares in growing pieces."""
    n, done, piece = len(ids) - q, 0, 32
    while True:
        low, high = (a + done, min(a + done + piece, n)) if step > 0 else (max(a - done - piece, 0), a - done)
        if low >= high:
            return done
        other = np.flatnonzero(ids[low:high] != ids[low + q : high + q])
        if len(other):
            return done + int(other[0] if step > 0 else high - low - 1 - other[-1])
        done, piece = done + high - low, min(2 * piece, 1 << 16)


def seeds(ids: np.ndarray, b: int, blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start of an aligned block, distance from b to 2b - 1 at which it comes again) for blocks, given by ascending starts.

    Blocks far from each other are searched by automata of their own, each over the words up to three blocks behind its blocks, so
    an automaton holds as many words as it searches and no more.
    """
    import ahocorasick

    gaps = np.flatnonzero((np.diff(blocks) > 3 * b) | (np.diff(blocks // max(REACH, 4 * b)) > 0)) + 1
    for group in np.split(blocks, gaps):
        first, last = int(group[0]), min(int(group[-1]) + 3 * b, len(ids))
        within = ids[first:last].tolist()
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        content: dict[int, int] = {}
        for a in group.tolist():
            key = tuple(within[a - first : a - first + b])
            content[a] = machine.get(key, a)
            machine.add_word(key, content[a])
        machine.make_automaton()
        for end, found in machine.iter(tuple(within)):
            p = first + end - b + 1
            a = (p - b) // b * b  # the one aligned start from b to 2b - 1 before p
            if content.get(a) == found:
                yield a, p - a


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches with smallest period q and length of max(min_length, rounds * q) or more; rounds is 4 or more.

    A block is searched only if each of its words comes again within 2b words, and if it isn't inside a run of smaller
    period that holds its seeds too; a stretch is extended once for each period.
    """
    n = len(ids)
    if n < max(min_length, rounds):
        return []
    ahead, held, b = recurs(ids), np.zeros(n, np.int64), 1
    found: dict[tuple[int, int], int] = {}
    while rounds * b <= n:
        starts = np.arange(0, n - b + 1, b)
        whole = len(starts) * b
        far = ahead[:whole].reshape(-1, b).max(1)
        # held: where the run of smaller period that covers a place ends; a block's seeds inside it are the same run again
        blocks = starts[(far < 2 * b) & (held[starts] < np.minimum(starts + 3 * b, n))]
        reached: dict[int, int] = {}
        for a, q in seeds(ids, b, blocks) if len(blocks) else ():
            if a < reached.get(q, 0):
                continue
            end = a + stretch(ids, a, q, 1)
            reached[q] = end
            start = a - stretch(ids, a, q, -1)
            length = end + q - start
            if length >= max(min_length, rounds * q):
                found[start, length] = min(q, found.get((start, length), q))
        for (start, length), q in found.items():
            if b <= q:
                held[start : start + length] = np.maximum(held[start : start + length], start + length)
        b *= 2
    return sorted((start, length, q) for (start, length), q in found.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = dropped(len(words), runs)
    return " ".join(words if not gone.any() else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])


def planted(words: list[str], h: int) -> list[str]:
    """The contract's words: in one document of ten (by h, the crc32 of its id; a null id has none) the end goes round and round."""
    n, g = len(words), h // 10
    if h < 0 or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The columns of docs, then runs (start, length, period; word numbers from 0) and collapsed, the text with each run's first period only.

    Words are joined by one blank. A null text has no runs and an empty collapsed text, as an empty one; very long texts are
    searched whole, in memory that grows with the text; repeated rows get the same; an empty table gives no rows. Columns of docs that are named
    runs or collapsed are replaced, all others pass through beside Python.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                words = WORD.findall(text or "")
                runs = find_runs(numbers(words))
                out.append(([{"start": s, "length": n, "period": q} for s, n, q in runs], collapse(words, runs)))
            yield pd.DataFrame(out, columns=["runs", "collapsed"])

    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]
    held = "_made"
    while held in rest:
        held += "_"
    return docs.select(*rest, of.asNondeterministic()(F.col("text").cast("string")).alias(held)).select(*rest, f"{held}.runs", f"{held}.collapsed")


def digest(words: list[str]) -> tuple:
    """The contract's columns for a document's words."""
    runs = find_runs(numbers(words))
    best = None
    for run in runs:  # exact: lengths over periods are compared by their products
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, q = best or (None, None, None)
    told = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), start, length, q, 1000 * length // q if q else None, sha256(told.encode()).hexdigest(), sha256(collapse(words, runs).encode()).hexdigest()


DIGEST = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's columns of every row, after the planted repeats; odd rows as in periodic_runs()."""
    prepare(docs.sparkSession)
    schema = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'bigint'}" for c in DIGEST)

    @F.pandas_udf(schema)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hashes in batches:
            rows = [digest(planted(WORD.findall(t or ""), int(h))) for t, h in zip(texts, hashes, strict=True)]
            yield pd.DataFrame(rows, columns=DIGEST).astype({c: "Int64" for c in DIGEST[:5]})

    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(-1).cast("long"))
    told = docs.select("doc_id", of.asNondeterministic()(F.col("text").cast("string"), h).alias("_made"))
    return told.select("doc_id", *[F.col(f"_made.{c}").alias(c) for c in DIGEST])

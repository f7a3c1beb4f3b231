"""Best-fit packing of token sequences, certified by lower bounds (op 3).

Each document is its ids and an end id. What is longer than a sequence is cut into whole sequences from the
end, so that only its first piece, the rest, needs a partner. The rests are dealt over partitions and packed
by best-fit decreasing. Dual feasible functions give every partition a number of bins that no packing of
its rests can beat; a partition that reaches it is certified, and gives up its emptiest bin only. A partition
with a gap gives up the documents of all its bins that aren't full. What was given up meets that of other
partitions, and best-fit decreasing runs again.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import beside, materialise, prepare, sorted_groups, texts

#: Rests that one group packs; a group's memory is about 200 bytes a rest.
GROUP_ROWS = 50_000


@lru_cache(maxsize=2)
def _library(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens=dict(special))


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: a first one of 1 to capacity tokens, then whole sequences."""
    first = (total - 1) % capacity + 1
    return [first, *[capacity] * ((total - first) // capacity)]


def tokenised(docs: DataFrame, capacity: int, end_id: int, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> DataFrame:
    """doc_id, total (ids with the end id) and the CRC-32 of each piece's ids."""

    def each(batch: list[str]) -> list[tuple[int, list[int]]]:
        coder, out = _library(ranks_path, pattern, special), []
        for text in batch:
            ids = coder.encode_to_numpy(text, allowed_special="all").astype("<u4")
            ids = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            own, at = [], 0
            for n in piece_lengths(len(ids) // 4, capacity):
                own.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                at += n
            out.append((len(ids) // 4, own))
        return out

    return beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", each, "total long, sums array<long>")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of several bounds by dual feasible functions; no packing of sizes has fewer bins.

    For each k, u_k(x) = x where x (k + 1) is whole, else floor((k + 1) x) / k; for each threshold e, sizes over
    1 - e count as 1, those under e as 0. Both never lower the number of bins that a set of sizes needs.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    large = np.cumsum(counts[::-1])[::-1]  # sizes of at least x
    weight = np.concatenate([[0], np.cumsum(counts * size)])
    for e in range(1, capacity // 2 + 1):
        over = int(large[capacity - e + 1])
        between = int(weight[capacity - e + 1] - weight[e])
        best = max(best, over + -(-between // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each size, and what the bins hold. Open bins are kept by free room; a bit set finds the tightest."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    some = 0
    for i in order.tolist():
        n = int(sizes[i])
        fit = some >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], places[i] = b, filled[b]
        filled[b] += n
        room -= n
        rooms[room].append(b)
        some |= 1 << room
    return bins, places, np.array(filled, np.int64)


def _pack_group(capacity: int, final: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        sizes = rows["size"].to_numpy(np.int64)
        bins, places, filled = best_fit_decreasing(sizes, capacity)
        gap = len(filled) - lower_bound(sizes, capacity)
        # a certified partition still gives up its emptiest bin: several such bins may share fewer sequences
        given = np.zeros(len(rows), bool) if final else (filled[bins] < capacity) & ((gap > 0) | (bins == filled.argmin()))
        return pd.DataFrame({"row": rows["row"].to_numpy(), "size": sizes, "grp": rows["grp"].to_numpy(), "bin": bins, "place": places, "gap": gap, "given": given})

    return pack


_PACKED = "row long, size long, grp long, bin long, place long, gap long, given boolean"


def pack_rests(rests: DataFrame, capacity: int, group_rows: int = GROUP_ROWS, rounds: int = 3) -> DataFrame:
    """Packs (row, size): row, bin and place; bin numbers are unique. Groups never hold much more than group_rows."""
    open_rows, done, base = rests, None, 0
    for turn in range(rounds):
        count = open_rows.count()
        groups = max(1, -(-count // group_rows))
        final = turn == rounds - 1 or groups == 1
        dealt = open_rows.select("row", "size", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).alias("grp"))
        packed = materialise(sorted_groups(dealt, ["grp"], _pack_group(capacity, final), _PACKED, min(groups, 2000)), f"packed{turn}")
        kept = packed.filter(~F.col("given")).select(
            "row", ((F.col("grp") + base) * (1 << 24) + F.col("bin")).alias("bin"), "place"
        )
        done = kept if done is None else done.unionByName(kept)
        base += groups
        open_rows = packed.filter("given").select("row", "size")
        if final or open_rows.isEmpty():
            break
    return done


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    ranks_path: str | None = None,
    pattern: str | None = None,
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Packs all documents into as few sequences of at most capacity tokens as the bounds can certify.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one piece, the end id. Every row of the input gets its own pieces, so repeated rows and
    ties in doc_id stay apart; an empty table gives no rows; further columns are left out. The ranks and the
    special strings are those of the tokenizers file; the ids are the same. Only lengths and checksums are
    shuffled, never texts; a group holds about group_rows documents at any size of the input.
    """
    prepare(docs.sparkSession)
    done = tokenised(docs, capacity, end_id, ranks_path or bpe.public_path("byte_bpe_50k.tiktoken"), pattern or bpe.public_pattern(), special)
    rows = materialise(done.withColumn("row", F.monotonically_increasing_id()), "tokens")
    first = (F.col("total") - 1) % capacity + 1
    packed = pack_rests(rows.select("row", first.alias("size")), capacity, group_rows)
    pieces = (
        rows.join(packed, "row", "left")
        .select("doc_id", "total", "row", "bin", "place", F.posexplode("sums").alias("piece", "ids_crc32"))
        .withColumn("first", first)
    )
    head = F.col("piece") == 0
    return pieces.select(
        "doc_id",
        "piece",
        F.when(head, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(head, F.col("first")).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        # whole sequences are numbered below zero
        F.when(head, F.col("bin")).otherwise(-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.when(head, F.col("place")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )

"""Byte-level BPE in linear time, with whole words kept between texts.

A piece is a match of the public pre-tokenizer pattern. Its encoding is found by walking from left to
right over the longest vocabulary matches (pyahocorasick over the bytes as Latin-1) and stepping back
wherever two neighbours could not stand side by side in a merged sequence. Two tokens can stand side by
side exactly if merging their joined bytes gives the two tokens again, which is remembered.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import ahocorasick
import regex

#: Entries of one memory; a full memory starts anew, so a worker's size is bounded.
MEMORY = 800_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: join the neighbours of least rank until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


class LinearBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.string = {i: b for b, i in ranks.items()}
        halves = {i: last_merge(b, ranks) for b, i in ranks.items()}
        usable = {b: i for b, i in ranks.items() if len(b) == 1 or halves[i]}
        self.halves = halves
        self.matcher = ahocorasick.Automaton()
        self.best: dict[str, int] = {}  # of each prefix of a usable token: the longest usable token it starts with
        for b, i in sorted(usable.items()):
            text = b.decode("latin-1")
            self.matcher.add_word(text, i)
            for n in range(1, len(text) + 1):
                if text[:n] not in self.best:
                    self.best[text[:n]] = usable.get(b[:n], self.best.get(text[: n - 1], -1))
        self.size = {i: len(b) for b, i in usable.items()}
        #: How far a longest match can reach.
        self.longest = max(self.size.values(), default=1)
        self.shorter = {i: self.best.get(b[:-1].decode("latin-1"), -1) for b, i in usable.items()}
        self.pairs: dict[int, bool] = {}
        self.left_edges: dict[int, list] = {}
        self.right_edges: dict[int, list] = {}

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of a token that lie at its left (0) or right (-1) end while it is merged: string, first and last time."""
        known = self.left_edges if side == 0 else self.right_edges
        if token not in known:
            out, until, part = [], 1 << 60, token
            while True:
                pair = self.halves[part]
                out.append((self.string[part], part if pair else -1, until))
                if not pair:
                    break
                until, part = part, pair[side]
            known[token] = out
        return known[token]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the joined strings of a and b gives a and b: no merge across the seam comes first."""
        for x, x_from, x_until in self.edge(a, -1):
            for y, y_from, y_until in self.edge(b, 0):
                rank = self.ranks.get(x + y)
                if rank is not None and x_from < rank < x_until and y_from < rank <= y_until:
                    return False
        return True

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, as exact merging gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        text, last = piece.decode("latin-1"), len(piece)
        pairs, size, best, prefix = self.pairs, self.size, self.best, self.matcher.longest_prefix
        closed, reach = bytearray(last + 1), self.longest
        path: list[int] = []
        before, at = -1, 0
        token = best[text[: prefix(text[:reach])]]
        while True:
            end = at + size[token]
            fits = not closed[end]
            if fits and before >= 0:
                seam = before << 32 | token
                fits = pairs.get(seam)
                if fits is None:
                    if len(pairs) >= MEMORY:
                        pairs.clear()
                    fits = pairs[seam] = self.neighbours(before, token)
            if fits:
                path.append(token)
                if end == last:
                    return path
                before, at = token, end
                ahead = text[at : at + reach]
                token = best[ahead[: prefix(ahead)]]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: no boundary of the true encoding is at this place
                closed[at] = 1
                token = path.pop()
                at -= size[token]
                token = self.shorter[token]
                before = path[-1] if path else -1


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens that merging joins last to make this vocabulary string; None for one byte, or where merging doesn't make it."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        least, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if least == 1 << 60:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Pieces:
    """The pattern's matches. Texts of common Latin characters take an equal pattern that the standard engine runs faster."""

    #: Within these ranges, letters, numbers and white space are as listed in LETTERS and NUMBERS.
    COMMON = "[\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027]*"
    LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
    KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str):
        self.every = regex.compile(pattern).findall
        self.common = re.compile(self.COMMON).fullmatch if pattern == self.KNOWN else lambda _: None
        letters, numbers = self.LETTERS, self.NUMBERS
        self.fast = re.compile(
            rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
        ).findall

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if self.common(text) else self.every(text)


class Memory(dict):
    """A dict that makes missing values and starts anew when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Whole texts to packed ids (little-endian, unsigned, 32 bits each), and back."""

    def __init__(self, ranks_path: str, pattern: str):
        self.bpe = LinearBpe(read_ranks(ranks_path))
        self.pieces = Pieces(pattern)
        self.known = Memory(self.packed)
        self.strings = [b""] * (max(self.bpe.string) + 1)
        for i, b in self.bpe.string.items():
            self.strings[i] = b
        self.names = list(map(str, range(len(self.strings))))

    def packed(self, piece: str) -> bytes:
        ids = self.bpe.encode(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


class Counter:
    """Counts tokens: a pre-token that is a string proved to stand alone counts as one, only the rest is merged.

    merged(piece) gives the number of tokens of such a rest; merged_length() is the plain way.
    """

    def __init__(self, alone: frozenset[str], pattern: str, special: tuple[str, ...], merged):
        self.alone, self.merged = alone, merged
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = Pieces(pattern)
        self.known = Memory(lambda piece: 1 if piece in alone else merged(piece))

    def plain(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return len(self.cut.findall(text)) + sum(map(self.plain, self.cut.split(text)))


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens merging leaves. Long pieces use a heap, so that time stays near the length."""
    if len(piece) <= 48:
        return len(merge(piece, ranks))
    import heapq

    size = len(piece)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    ends = list(range(1, size + 1))  # where the part that starts here ends; 0: joined to an earlier part
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = size
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else size
        if not ends[i] or j >= size or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        after[i] = after[j]
        if after[j] < size:
            before[after[j]] = i
        left -= 1
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < size and (r := ranks.get(piece[a : ends[b]])) is not None:
                heapq.heappush(heap, (r, a, ends[b]))
    return left


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(ranks_path, pattern)

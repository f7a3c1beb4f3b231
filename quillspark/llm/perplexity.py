"""Quality rules with an n-gram language model (op 5).

The model has two tiers. The lower one is a modified Kneser-Ney model of character n-grams: Spark counts them over
all texts, and the model is kept in sorted arrays of n-gram hashes. A character stands for its class there (a hash
is the n-gram's classes as digits of base 64), which is what lets it tell prose from junk in rare words; it has 64 **
ORDER n-grams at most, whatever the corpus. The upper tier has every word of the corpus and grows with it: Spark
counts the words, and a word's probability is its discounted count, interpolated with its spelling in the lower
tier. Word counts are never gathered: they stay dealt by hash, and every unit of texts gets those of its own words.

Documents outside of their language's band of perplexity, of characters or of words, are rejected.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare, texts

#: Symbols and n-gram length: 64 ** 4 n-grams, 16.8 million, bound the lower tier (12 bytes each) and what the driver gathers.
SYMBOLS, ORDER = 64, 4
#: Bands: so many robust deviations below and above the language's median, of bits a symbol and of bits a word (below it, in
#: a small corpus, stand copies of clean texts too, whose words vouch for each other). The deviation of a text is taken to
#: fall as 1 / sqrt(n) of its symbols or words, but no further than at so many of them: longer texts differ in their
#: vocabulary as much as those. The README has figures for all of them.
BAND, WORD_BELOW, WORD_ABOVE, STEADY_SYMBOLS, STEADY = 4.0, 8.0, 5.0, 8192, 1000
#: Characters of a unit: the texts that one request for word counts is made for. It bounds a task's memory.
UNIT_CHARS = 32_000_000
#: Base rules: fewest words, and the share of words in repeated 5-word windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: So many languages' bands are broadcast at most (under 1 MB); more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
#: Code points with a class of their own place in the table; those beyond share the class of their kind.
TABLE = 0x3000
WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
#: What the upper tier counts as a word.
TOKEN = re.compile(r"\w+").findall
SYMBOL = re.compile(r"[#*$%&|<>]").findall
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]").search


def symbol_of(code: int) -> int:
    """0: edge. 1 blank, 2 newline, 3 digit, 4-8 marks, 9-34 lower-case letters, 35-60 capitals, 61 letters without case, 62 other marks, 63 rest."""
    c = chr(code)
    if c == "\n":
        return 2
    if c.isspace():
        return 1
    kind = unicodedata.category(c)
    if kind[0] == "N":
        return 3
    if c in ".":
        return 4
    if c in ",;:":
        return 5
    if c in "!?":
        return 6
    if c in "'\"()-":
        return 7
    if c in "#*$%&|<>":
        return 8
    if kind in ("Ll", "Lu", "Lt"):
        base = unicodedata.normalize("NFKD", c)[0].lower()
        place = ord(base) - 97 if "a" <= base <= "z" else code % 26
        return (9 if kind == "Ll" else 35) + place
    return 61 if kind[0] in "LM" else 62 if kind[0] in "PS" else 63


_CLASSES: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.array([symbol_of(c) for c in range(TABLE)] + [61], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASSES[0][np.minimum(codes, TABLE)]


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, with edges around it."""
    return np.concatenate([np.zeros(ORDER - 1, np.uint8), _classes(text), np.zeros(1, np.uint8)])


def grams(text: str) -> np.ndarray:
    """The hash of the n-gram that ends at each symbol of the text and at its end."""
    return _rolled(symbols(text))


def _rolled(s: np.ndarray) -> np.ndarray:
    s = s.astype(np.int32)
    n = len(s) - ORDER + 1
    key = s[:n].copy()
    for k in range(1, ORDER):
        key *= SYMBOLS
        key += s[k : k + n]
    return key


def count_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their counts over all texts. Tasks count first, then Spark adds up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal keys, counts, held, size
            k, c = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([keys, k])
            order = np.argsort(both, kind="stable")
            both, sums = both[order], np.concatenate([counts, c])[order]
            new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            keys, counts, held, size = both[new], np.add.reduceat(sums, new), [], 0

        for batch in batches:
            for text in batch["text"]:
                if text:
                    held.append(grams(text))
                    size += len(held[-1])
                    if size > 4_000_000:
                        fold()
        if held:
            fold()
        for at in range(0, len(keys), 100_000):
            yield pd.DataFrame({"gram": keys[at : at + 100_000], "n": counts[at : at + 100_000]})

    total = texts(docs.select("text")).mapInPandas(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    total = total.sort_values("gram")
    return total["gram"].to_numpy(np.int32), total["n"].to_numpy(np.int64)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2) and D(3 or more) by the counts of counts, kept within (0, count)."""
    return discounts_of(*[int((counts == k).sum()) for k in (1, 2, 3, 4)])


def discounts_of(*having: int) -> np.ndarray:
    """The same from how many have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, x) for x in having)
    y = n1 / (n1 + 2 * n2)
    raw = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9])


class KneserNey:
    """logs[i] is log2 p of the n-gram hashed keys[i]; of others, back[context] + lower[rest]."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, back: np.ndarray, lower: np.ndarray):
        self.keys, self.logs, self.back, self.lower = keys, logs, back, lower
        # where each context's n-grams begin in the sorted array, and which symbols follow it: a place is found by counting bits
        context = keys // SYMBOLS
        self.starts = np.searchsorted(keys, np.arange(SYMBOLS ** (ORDER - 1), dtype=np.int64) * SYMBOLS)
        self.follow = np.zeros(SYMBOLS ** (ORDER - 1), np.uint64)
        np.bitwise_or.at(self.follow, context, np.uint64(1) << (keys % SYMBOLS).astype(np.uint64))

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """Interpolated: the longest n-grams by count, shorter ones by how many symbols stand before them."""
        levels = [(keys, counts)]
        for n in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] % SYMBOLS**n, return_counts=True))
        lower = np.full(1, 1 / SYMBOLS)  # of the empty n-gram's next symbol: uniform
        for n, (k, c) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            size = SYMBOLS ** (n - 1)
            context, cut = k // SYMBOLS, discounts(c)[np.minimum(c, 3)]
            total = np.bincount(context, c, size)
            held = np.bincount(context, cut, size)
            share = np.divide(held, total, out=np.ones(size), where=total > 0)
            below = lower if n == 1 else lower[k % SYMBOLS ** (n - 1)]
            p = (c - cut) / total[context] + share[context] * below
            if n == ORDER:
                return cls(k, np.log2(p).astype(np.float32), np.log2(share).astype(np.float32), np.log2(lower).astype(np.float32))
            every = np.arange(SYMBOLS**n)
            dense = share[every // SYMBOLS] * (lower if n == 1 else lower[every % size])
            dense[k] = p
            lower = dense
        raise ValueError("ORDER is 1 at least")

    def log2(self, key: np.ndarray) -> np.ndarray:
        context, symbol = key >> 6, (key & (SYMBOLS - 1)).astype(np.uint64)
        other = self.back[context] + self.lower[key & (SYMBOLS ** (ORDER - 1) - 1)]
        if not len(self.keys):
            return other
        follow = self.follow[context]
        at = self.starts[context] + np.bitwise_count(follow & ((np.uint64(1) << symbol) - np.uint64(1)))
        known = (follow >> symbol) & np.uint64(1) != 0
        return np.where(known, self.logs[np.minimum(at, len(self.keys) - 1)], other)

    def spelling(self, words: list[str]) -> np.ndarray:
        """Bits of each word's characters, its end included: bits(word) times their number, for many words at once."""
        if not words:
            return np.empty(0)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + ORDER)  # each word with ORDER - 1 edges before it and one after
        every = np.zeros(int(ends[-1]), np.uint8)
        begins = ends - sizes - 1
        joined = _classes("".join(words))
        every[np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(joined))] = joined
        logs = self.log2(_rolled(every))
        first = begins - (ORDER - 1)
        total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
        return total[first] - total[first + sizes + 1]

    def bits(self, text: str) -> float:
        """Mean bits a symbol, the end included: log2 of the perplexity."""
        return float(-self.log2(grams(text)).mean())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = WORD(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif NOT_BLANK(line):
            seen.add(line)
    n = len(words)
    covered = 0
    if n > 5:
        # windows whose mixed hashes all differ are all different; only others are compared as words
        hashed = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        mixed = np.zeros(n - 4, np.uint64)
        for k in range(5):
            mixed = (mixed ^ hashed[k : n - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        mixed.sort()
        if (mixed[1:] == mixed[:-1]).any():
            windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
            counts = Counter(windows)
            until = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    covered += i + 5 - max(i, until)
                    until = i + 5
    return n, sum(map(len, words)), len(SYMBOL(text)), repeated, covered


#: What a text is measured by, and its place in the unit of texts whose words are counted together. tokens: its words as
#: places in the unit's list of words. The first text of a unit holds that list: hashes, spelling bits and counts.
MEASURES = (
    "bits double, n_symbols_all long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "unit long, place int, tokens binary, spelling binary, hashes binary, counts binary"
)
_FIELDS = [x.split()[0] for x in MEASURES.split(", ")]
#: Bits of a word's hash that count: of a billion words, one in 280,000 shares its hash with another.
HASH_MASK = np.uint64(2**48 - 1)


class _Places(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _packed(ids: np.ndarray) -> bytes:
    """Sorted numbers as their differences, in two bytes where they fit, compressed. New words of a text have neighbouring numbers."""
    steps = np.diff(np.sort(ids), prepend=0)
    wide = len(steps) and steps.max() > 0xFFFF
    return (b"\x04" if wide else b"\x02") + zlib.compress(steps.astype("<u4" if wide else "<u2").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), "<u4" if raw[0] == 4 else "<u2").astype(np.int64))


def measure(docs: DataFrame, model: KneserNey):
    """A column with the base rules' numbers, the lower tier's bits and the words of a text column (null counts as empty)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.logs, model.back, model.lower))

    @F.pandas_udf(MEASURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = KneserNey(*shared.value)
        task, units, chars, places = TaskContext.get().partitionId(), 0, 0, _Places()
        held: list[list[tuple]] = []
        said: list[np.ndarray] = []

        def row(text: str) -> tuple:
            ids = np.array(list(map(places.__getitem__, TOKEN(text))), np.int32)
            said.append(ids)
            return (own.bits(text), len(text), *base_rules(text), task << 24 | units, len(said) - 1, _packed(ids), None, None, None)

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal units, chars
            words = list(places)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & HASH_MASK
            lists = (own.spelling(words).astype("<f4").tobytes(), hashes.tobytes(), np.bincount(np.concatenate(said), minlength=len(words)).astype("<u4").tobytes())
            held[0][0] = (*held[0][0][:-3], *lists)
            for rows in held:
                yield pd.DataFrame(rows, columns=_FIELDS)
            places.clear()
            held.clear()
            said.clear()
            units, chars = units + 1, 0

        for batch in batches:
            if not len(batch):
                yield pd.DataFrame(columns=_FIELDS)
                continue
            held.append([row(x) for x in batch])
            chars += int(batch.str.len().sum())
            if chars > UNIT_CHARS:
                yield from flush()
        if held:
            yield from flush()

    return of.asNondeterministic()(F.coalesce(F.col("text"), F.lit("")))


def unit_words(measured: DataFrame) -> DataFrame:
    """unit, place, h and n of every distinct word of every unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, h, n in zip(batch["unit"], batch["hashes"], batch["counts"], strict=True):
                told = pd.DataFrame({"h": np.frombuffer(h, np.int64), "n": np.frombuffer(n, "<u4").astype(np.int64)})
                told.insert(0, "place", np.arange(len(told), dtype=np.int32))
                told.insert(0, "unit", np.int64(unit))
                for at in range(0, len(told), 50_000):
                    yield told.iloc[at : at + 50_000]

    first = measured.filter("__m.hashes IS NOT NULL").select("__m.unit", "__m.hashes", "__m.counts")
    return first.mapInPandas(run, "unit long, place int, h long, n long")


def word_bits(measured: DataFrame) -> DataFrame:
    """unit, place, word_bits (mean bits a word, null without words) and n_tokens of every text.

    Counts meet by the word's hash, in one shuffle of each unit's distinct words; each unit gets the counts of those of its
    words back that the corpus has twice or more, and its texts are scored beside them. A count is taken without the
    occurrence that is scored, so a text's rare words don't vouch for themselves. No task holds more than one unit's
    words, and the driver gets six numbers.
    """
    from pyspark.sql.window import Window as W

    # about eight units' data in a task, at any size of the corpus
    units = measured.filter("__m.hashes IS NOT NULL").count()
    parts = max(1, -(-units // 8), min(units, int(measured.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    same = W.partitionBy("h")
    first = F.row_number().over(same.orderBy("unit")) == 1
    counted = materialise(unit_words(measured).repartition(parts, "h").select("unit", "place", F.sum("n").over(same).alias("c"), first.alias("first")), "words")
    having = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    sums = counted.filter("first").agg(F.sum("c").alias("total"), F.count("*").alias("words"), *having).first()
    total, n1, n2 = float(sums["total"] or 1), sums["n1"], sums["n2"]
    cut = discounts_of(n1, n2, sums["n3"], sums["n4"])
    free = (cut[1] * n1 + cut[2] * n2 + cut[3] * (sums["words"] - n1 - n2)) / total

    def logs_of(spelling: bytes, parts: list[np.ndarray]) -> np.ndarray:
        p = free * 2.0 ** -np.frombuffer(spelling, "<f4").astype(float)
        for places, c in parts:
            c = c - 1  # without the occurrence that is scored
            p[places] += np.maximum(c - cut[np.minimum(c, 3)], 0) / total
        return -np.log2(np.maximum(p, 1e-300))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        logs = np.empty(0)
        for batch in batches:
            kind, place, c = batch["kind"].to_numpy(), batch["place"].to_numpy(), batch["c"].to_numpy()
            edges = np.flatnonzero(np.diff(kind, prepend=kind[:1] if len(kind) else [0])) if len(kind) else []
            for a, b in zip([0, *edges], [*edges, len(kind)]):
                if b > a and kind[a] == 0:
                    parts.append((place[a:b], c[a:b].astype(np.int64)))
                elif b > a:
                    ids, bits = [], []
                    for tokens, spelling in zip(batch["tokens"].iloc[a:b], batch["spelling"].iloc[a:b], strict=True):
                        if spelling is not None:  # the first text of a unit; the counts came before it
                            logs, parts = logs_of(spelling, parts), []
                        own = _unpacked(tokens)
                        ids.append(len(own))
                        bits.append(float(logs[own].mean()) if len(own) else None)
                    yield pd.DataFrame({"unit": batch["unit"].iloc[a:b].to_numpy(), "place": place[a:b], "word_bits": pd.array(bits, "Float64"), "n_tokens": ids})

    none = F.lit(None).cast("binary")
    lists = counted.filter("c > 1").select("unit", F.lit(0).alias("kind"), "place", "c", none.alias("tokens"), none.alias("spelling"))
    told = measured.select("__m.unit", F.lit(1).alias("kind"), "__m.place", F.lit(0).cast("long").alias("c"), "__m.tokens", "__m.spelling")
    return lists.unionByName(told).repartition(parts, "unit").sortWithinPartitions("unit", "kind", "place").mapInPandas(run, "unit long, place int, word_bits double, n_tokens long")


def base_failed(m: str):
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MOST_REPEATED)


def scored(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns keep of docs and __m, as measure() gives it, written once; each row's scores by __m.unit and __m.place, with lang).

    Texts are read twice: for the counts of n-grams, and here. The second frame is small and written too.
    """
    model = KneserNey.fit(*count_grams(docs))
    more = [c for c in ("lang",) if c not in keep]
    measured = materialise(docs.select(*keep, *more, measure(docs, model).alias("__m")), "measured")
    found = word_bits(measured).select(F.col("unit").alias("__unit"), F.col("place").alias("__place"), F.col("word_bits").alias("__word_bits"), F.col("n_tokens").alias("__n_tokens"))
    slim = F.struct(*[F.col(f"__m.{x}").alias(x) for x in _FIELDS if x not in ("tokens", "hashes", "spelling", "counts")])
    rows = measured.select(*[c for c in (*keep, *more) if c in ("doc_id", "lang")], slim.alias("__m"))
    rows = rows.join(found, (F.col("__m.unit") == F.col("__unit")) & (F.col("__m.place") == F.col("__place"))).drop("__unit", "__place")
    return measured, materialise(rows, "scored")


def _roots():
    """What a text's deviations of bits a symbol and bits a word are multiplied with."""
    symbols_all, words = F.least(F.greatest(F.col("__m.n_symbols_all"), F.lit(1)), F.lit(STEADY_SYMBOLS)), F.least(F.greatest(F.col("__n_tokens"), F.lit(1)), F.lit(STEADY))
    return F.sqrt(symbols_all.cast("double")), F.sqrt(words.cast("double"))


def bands(rows: DataFrame) -> DataFrame:
    """Median and robust deviation (for one symbol, one word) of each language, over its documents that pass the base rules.

    A null language is one of its own. Partial sketches are merged, so a language may hold most of the rows.
    """
    by_symbol, by_word = _roots()
    passed = rows.filter(~base_failed("__m")).select(F.coalesce("lang", F.lit("")).alias("__lang"), F.col("__m.bits").alias("__bits"), "__word_bits", by_symbol.alias("__rs"), by_word.alias("__rw"))
    middle = passed.groupBy("__lang").agg(F.percentile_approx("__bits", 0.5, 10_000).alias("__middle"), F.percentile_approx("__word_bits", 0.5, 10_000).alias("__word_middle"))
    few = _few(middle)
    off = passed.join(F.broadcast(middle) if few else middle, "__lang")
    spread = lambda x, m, r: F.percentile_approx(F.abs(F.col(x) - F.col(m)) * F.col(r), 0.5, 10_000) * 1.4826
    return off.groupBy("__lang").agg(
        F.first("__middle").alias("__middle"), F.first("__word_middle").alias("__word_middle"),
        spread("__bits", "__middle", "__rs").alias("__width"), spread("__word_bits", "__word_middle", "__rw").alias("__word_width"),
    )


def _few(by_language: DataFrame) -> bool:
    return by_language.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds __failed and __kept, and the bands __low to __high and __word_low to __word_high, to scored rows with lang. limits is a written table."""
    joined = rows.withColumn("__lang", F.coalesce("lang", F.lit(""))).join(F.broadcast(limits) if _few(limits) else limits, "__lang", "left")
    by_symbol, by_word = _roots()
    edge = lambda middle, width, root, times: F.col(middle) + times * F.col(width) / root
    ends = {
        "__low": edge("__middle", "__width", by_symbol, -BAND), "__high": edge("__middle", "__width", by_symbol, BAND),
        "__word_low": edge("__word_middle", "__word_width", by_word, -WORD_BELOW), "__word_high": edge("__word_middle", "__word_width", by_word, WORD_ABOVE),
    }
    told = joined.withColumns(ends).withColumn("__failed", base_failed("__m"))
    inside = F.coalesce(F.col("__m.bits").between(F.col("__low"), F.col("__high")), F.lit(True)) & F.coalesce(F.col("__word_bits").between(F.col("__word_low"), F.col("__word_high")), F.lit(True))
    return told.withColumn("__kept", ~F.col("__failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base rules and the language model's verdict on every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, bits (log2 of
    the perplexity of a character) and its band low to high, word_bits (of a word; null without one) and its band word_low
    to word_high. Null and empty texts have no words and fail the base rules; a null language has its own band; repeated
    rows count as often as they stand there and get equal verdicts; further columns are left out; an empty table gives no
    rows. All texts are counted and scored. Counts of words grow with the corpus and stay dealt over it; the lower tier
    that is broadcast has 64 ** 4 n-grams at most.
    """
    prepare(docs.sparkSession)
    _, rows = scored(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"])
    out = judged(rows, materialise(bands(rows), "bands"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ends = ["__low", "__high", "__word_bits", "__word_low", "__word_high"]
    return out.select("doc_id", *[F.col(f"__m.{c}").alias(c) for c in names], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), "lang", F.col("__m.bits").alias("bits"), *[F.col(c).alias(c[2:]) for c in ends])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with their columns. Texts are scored once, and shuffled once to meet their verdicts."""
    prepare(docs.sparkSession)
    measured, rows = scored(docs, docs.columns)
    good = judged(rows, materialise(bands(rows), "bands")).filter("__kept").select(F.col("__m.unit").alias("__unit"), F.col("__m.place").alias("__place"))
    return measured.join(good, (F.col("__m.unit") == F.col("__unit")) & (F.col("__m.place") == F.col("__place")), "left_semi").select(*docs.columns)

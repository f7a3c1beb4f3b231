"""Spelling variant grouping (op 12): letter-parity bitmask bands.

A word's mask has a bit for each letter: whether it occurs an odd number of times. One edit touches at most two letters, so it
flips at most two bits, and of three bands of the mask one at least stays as it is. Words meet where a band is equal and
lengths fit; what meets is verified by the edit distance. A band that an edit doesn't touch keeps more than its bits: its letters
stay in order, and at their places where a letter was only replaced. These go into the key beside the bits, so that a band's
value that very many words share doesn't bring all of them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare

#: Fixed by the contract: letters of a run, code points of a word and occurrences of it at least.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is so many times as frequent as its variant at least.
TIMES = 5
#: One run in so many (by hash) loses a code point: the planted misspellings of the contract.
PLANTED = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word, dealt to three bands of 30 bits one after the other; a to z by how usual they are, so that bands are alike.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
BANDS = [LETTERS[k::3] for k in range(3)]
#: Where so many words share an untouched band, they are split again by three bands of the other letters.
CROWD = 64


def planted_runs(docs: DataFrame) -> DataFrame:
    """word of every run of every text, lower-cased in A to Z, with the contract's planted deletions; a null id is written as nothing."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run")
    ).select("i", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "i", "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % PLANTED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words of min_length code points or more and min_count occurrences or more, with n; counted in the tasks before they meet."""
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def kept(word: Column, letters: str, gap: str = "") -> Column:
    """The word with letters alone; others, those of no band too, vanish or leave gap at their place."""
    return F.regexp_replace(word, f"[^{letters}]", gap)


def parity(word: Column, letters: str) -> Column:
    """The bits of letters that occur an odd number of times in word."""
    chars = F.split(kept(word, letters), "")
    bit = lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(letters), c) - 1))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def banded(words: DataFrame) -> DataFrame:
    """word, its length and its mask as three bands of bits."""
    return words.select("*", F.char_length("word").alias("length"), *[parity(F.col("word"), b).alias(f"band{k}") for k, b in enumerate(BANDS)])


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Verified pairs (x, y) of what meets on keys."""
    met = a.withColumnRenamed("word", "x").join(b.withColumnRenamed("word", "y"), keys)
    return met.filter(F.levenshtein("x", "y", 1) == 1)


def _splits(letters: str) -> list[str]:
    return [letters[k::3] for k in range(3)]


def replaced(words: DataFrame) -> DataFrame:
    """Pairs (x < y) of words of one length that differ in one letter.

    Two letters are touched, so one band keeps its bits, its letters and their places. Where CROWD words or more share all that
    (words without a letter of the band, for instance), the letters of the other two bands are banded in their turn: the two touched
    letters are among them, so again one of three keeps its places, and nothing is lost.
    """
    keys = ["band", "bits", "places"]
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"band{k}").alias("bits"), kept(F.col("word"), b, ".").alias("places")) for k, b in enumerate(BANDS)]))
    one = materialise(words.select("word", rows), "bands")
    sizes = one.groupBy(*keys).agg(F.count("*").alias("m")).filter("m > 1")
    crowd = one.join(sizes, keys).select("word", *keys, (F.col("m") >= CROWD).alias("full"))
    crowd = materialise(crowd, "crowds")
    again = None
    for k, b in enumerate(BANDS):
        rest = "".join(c for c in LETTERS if c not in b)
        second = F.inline(F.array(*[F.struct(F.lit(j).alias("second"), kept(F.col("word"), b + s, ".").alias("more")) for j, s in enumerate(_splits(rest))]))
        part = crowd.filter(F.col("full") & (F.col("band") == k)).select("word", *keys, second)
        again = part if again is None else again.unionByName(part)
    thin = crowd.filter(~F.col("full")).select("word", *keys, F.lit(0).alias("second"), F.col("places").alias("more"))
    every = thin.unionByName(again)
    met = _meet(every, every, [*keys, "second", "more"]).filter(F.col("x") < F.col("y"))
    return met.select("x", "y")


def grown(words: DataFrame) -> DataFrame:
    """Pairs of words of which one has one letter more. One letter is touched, so two bands keep their bits and the order of their letters."""
    two = [(0, 1), (0, 2), (1, 2)]
    rows = F.inline(F.array(*[
        F.struct(F.lit(k).alias("bands"), F.col(f"band{a}").alias("bits"), F.col(f"band{b}").alias("more"), kept(F.col("word"), BANDS[a] + BANDS[b]).alias("letters"))
        for k, (a, b) in enumerate(two)
    ]))
    keys = ["bands", "bits", "more", "letters", "length"]
    short = words.select("word", "length", rows)
    long = words.select("word", (F.col("length") - 1).alias("length"), rows)
    return _meet(short, long, keys).select("x", "y")


def near_words(words: DataFrame) -> DataFrame:
    """x and y, in both directions, of all words that differ by exactly one inserted, deleted or replaced code point."""
    masks = materialise(banded(words.select("word")), "masks")
    one = materialise(replaced(masks).unionByName(grown(masks)).distinct(), "near")
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y")))


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words (word, n).

    A form is the near word of largest n (the first in code-point order of several), if it is times as frequent or more. As n
    grows along forms, they never come back, and a chain is as long as the logarithm of n at most; roots are found by following
    twice as many steps in each round. A word has a bounded number of near words, so no group is large.
    A word of null is left out; letters of no band are compared only when pairs are verified; repeated words are an error of the caller; an empty table gives
    no rows.
    """
    prepare(words.sparkSession)
    words = materialise(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words).join(words.select(F.col("word").alias("y"), F.col("n").alias("m")), "y")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("y").alias("y")))
    near = pairs.groupBy(F.col("x").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.m") >= F.lit(times) * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.y")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")
    )
    told = materialise(told, "forms")
    # only words with a form move; up is where a word has come to, and what has no row of its own there has arrived
    moving = told.filter("form is not null").select("word", F.col("form").alias("up"))
    while True:
        ahead = moving.select(F.col("word").alias("up"), F.col("up").alias("next"))
        moving = materialise(moving.join(ahead, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moving.filter("moved").limit(1).count():
            break
        moving = moving.drop("moved")
    return told.join(moving.select("word", F.col("up").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's groups over whole documents: group_variants() of vocabulary() of planted_runs().

    Null and empty texts have no words; repeated rows count each time; ties are broken by code point; very long texts are read
    whole; further columns don't matter. An empty table gives no rows.
    """
    return group_variants(vocabulary(planted_runs(docs)))

"""Similar sets of words by prefix filter, and the pairs that are judged for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.durable import written


def by_rarity(sets: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """keys and words of sets, words ordered from the rarest of all rows to the most frequent one; rows without a word go. keys tell the sets apart.

    Words are counted over all rows first, then met with their counts: a very frequent word is one row on the counted side.
    """
    spread = sets.select(*keys, F.explode(F.array_distinct(words)).alias("_w"))
    counts = spread.groupBy("_w").agg(F.count("*").alias("_n"))
    ranked = spread.join(counts, "_w").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "_w"))).alias("_s"))
    return ranked.select(*keys, F.transform("_s", lambda x: x["_w"]).alias("words"))


def prefix(words: Column, least: float) -> Column:
    """The rarest words of a set, of which a set that it has least of its words in common with holds at least one."""
    return F.slice(words, F.lit(1), F.size(words) - F.ceil(F.size(words) * F.lit(least) - 1e-9).cast("int") + 1)


def similar_sets(a: DataFrame, b: DataFrame, least: float, key: list[str]) -> DataFrame:
    """key, wa, wb of all distinct sets (key, words) of a and b whose overlap coefficient is least or more.

    words are in one order of rarity on both sides. The smaller set of a pair shares at least least of its words, so one of its rarest
    ones is among the larger's: the smaller side is joined by its prefix alone, and a pair counts at the first word of that. A frequent word
    joins only where a set has hardly another one. Equal sets are one row here, however many rows have them.
    """
    def met(small: DataFrame, large: DataFrame, strict: bool) -> DataFrame:
        x = small.select(*key, F.col("words").alias("ws"), F.explode(prefix(F.col("words"), least)).alias("_w"))
        y = large.select(*key, F.col("words").alias("wl"), F.explode("words").alias("_w"))
        fits = F.size("ws") < F.size("wl") if strict else F.size("ws") <= F.size("wl")
        first = F.get(F.array_intersect(prefix(F.col("ws"), least), F.col("wl")), F.lit(0)) == F.col("_w")
        return x.join(y, [*key, "_w"]).filter(fits & first).filter(T.overlap(F.col("ws"), F.col("wl")) >= least)

    a, b = a.select(*key, "words").distinct(), b.select(*key, "words").distinct()
    up = met(a, b, False).select(*key, F.col("ws").alias("wa"), F.col("wl").alias("wb"))
    return up.unionByName(met(b, a, True).select(*key, F.col("wl").alias("wa"), F.col("ws").alias("wb")))


def similar_pairs(rows: DataFrame, key: str = "group", least: float = 0.5) -> DataFrame:
    """key, a, b (a before b) and overlap of the rows (key, id, text) of a group whose concept words overlap by least or more."""
    sets = written(by_rarity(rows.select(key, "id", T.concepts(F.col("text")).alias("words")), [key, "id"]), "sets")
    near = similar_sets(sets, sets, least, [key])
    a, b = sets.select(key, F.col("id").alias("a"), F.col("words").alias("wa")), sets.select(key, F.col("id").alias("b"), F.col("words").alias("wb"))
    met = near.join(a, [key, "wa"]).join(b, [key, "wb"]).filter(F.col("a") < F.col("b"))
    return met.select(key, "a", "b", T.overlap(F.col("wa"), F.col("wb")).alias("overlap"))


def orphans(produced: DataFrame, consumed: DataFrame, least: float = 0.6, key: list[str] | None = None) -> DataFrame:
    """Outputs (id, text, or words where there is no text) that no input (text) overlaps, by key where there is one.

    Both sides' words are ordered by their frequency in both together; distinct sets meet by prefix.
    """
    key = key or []
    words = lambda df: F.array_sort(F.col("words") if "text" not in df.columns else T.concepts(F.col("text"))).alias("set")
    out, inputs = produced.select(*key, "id", words(produced)).filter(F.size("set") > 0), consumed.select(*key, words(consumed)).filter(F.size("set") > 0)
    # distinct sets of both sides, each told apart by itself
    each = out.select(*key, "set").distinct().withColumn("_out", F.lit(True)).unionByName(inputs.distinct().withColumn("_out", F.lit(False)))
    sets = written(by_rarity(each, [*key, "set", "_out"], "set"), "sets")
    met = similar_sets(sets.filter("_out"), sets.filter("NOT _out"), least, key).select(*key, F.array_sort("wa").alias("set")).distinct()
    return out.join(met, [*key, "set"], "left_anti").select(*key, "id")


#: Pairs of different owners that are judged at most.
MOST_PAIRS = 900


def owner_pairs(entries: DataFrame, most: int = MOST_PAIRS) -> tuple[DataFrame, int]:
    """entries (id, section, owner, capability, grp): pairs a, b of different sections and owners, and how many there are in all.

    All of them where they are at most most. Beyond, the pairs inside a concept group (grp) and those of equal capabilities, the first most of
    these in order of a and b: what is left out is said by the number. Pairs are counted from the sizes of sections and owners,
    and an entry that has no partner doesn't come to any join. The first pairs are those of the first entries, so entries with partners
    are met from the front, eight times as many each time, until they have most pairs.
    """
    who = F.array_join(F.array_sort(T.concepts(F.coalesce("owner", F.lit("")))), " ")
    what = F.array_join(F.array_sort(T.concepts(F.coalesce("capability", F.lit("")))), " ")
    told = written(entries.select("id", "section", "grp", who.alias("who"), what.alias("what")), "owners")
    n = told.count()
    half = lambda *by: int(told.groupBy(*by).agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0])
    every = n * (n - 1) // 2 - half("section") - half("who") + half("section", "who")
    a, b = (told.select(F.col("id").alias(x), F.col("section").alias(f"s{x}"), F.col("who").alias(f"w{x}"), "grp", "what") for x in ("a", "b"))
    differ = (F.col("a") < F.col("b")) & ~F.col("sa").eqNullSafe(F.col("sb")) & (F.col("wa") != F.col("wb"))
    if every <= most:
        sizes = told.join(told.groupBy("section").agg(F.count("*").alias("ns")), "section").join(told.groupBy("who").agg(F.count("*").alias("nw")), "who").join(told.groupBy("section", "who").agg(F.count("*").alias("nb")), ["section", "who"])
        some = sizes.filter(F.lit(n) > F.col("ns") + F.col("nw") - F.col("nb")).select("id")  # twice every rows at most
        left = a.drop("grp", "what").join(F.broadcast(some.withColumnRenamed("id", "a")), "a", "left_semi")
        right = b.drop("grp", "what").join(F.broadcast(some.withColumnRenamed("id", "b")), "b", "left_semi")
        return left.join(F.broadcast(right), differ).select("a", "b"), every
    def paired(kind: str) -> DataFrame:
        """Entries that have a partner, before or behind them, of equal kind."""
        rows = told.filter(F.col(kind).isNotNull() & (F.col(kind).cast("string") != "")) if kind == "what" else told.filter("grp IS NOT NULL")
        size = lambda name, *by: rows.groupBy(kind, *by).agg(F.count("*").alias(name)).select(F.col(kind).alias("_k"), *[F.col(c).alias(f"_{c}") for c in by], name)
        own = rows.groupBy(kind, "section", "who").agg(F.count("*").alias("nb"))
        at = lambda df, *by: F.col(kind).eqNullSafe(df["_k"]) & (F.col("section").eqNullSafe(df["_section"]) if "section" in by else F.lit(True)) & (F.col("who").eqNullSafe(df["_who"]) if "who" in by else F.lit(True))
        n1, n2, n3 = size("nk"), size("ns", "section"), size("nw", "who")
        told_ = own.join(n1, at(n1)).select(own["*"], "nk")
        told_ = told_.join(n2, at(n2, "section")).select(told_["*"], "ns")
        told_ = told_.join(n3, at(n3, "who")).select(told_["*"], "nw").filter(F.col("nk") > F.col("ns") + F.col("nw") - F.col("nb"))
        x, y = rows.alias("x"), told_.select(F.col(kind).alias("_k"), F.col("section").alias("_s"), F.col("who").alias("_w")).alias("y")
        return x.join(y, F.col(f"x.{kind}").eqNullSafe(F.col("_k")) & F.col("x.section").eqNullSafe(F.col("_s")) & F.col("x.who").eqNullSafe(F.col("_w")), "left_semi").select("id")

    able = written(paired("grp").unionByName(paired("what")).distinct(), "able")
    left, some = able.count(), max(1, most // 100)
    while True:
        first = F.broadcast(able.orderBy("id").limit(some)) if some < left else able
        front = a.join(first.withColumnRenamed("id", "a"), "a", "left_semi")
        front = F.broadcast(front) if some < left else front
        group = b.drop("what").join(front.drop("what"), "grp").filter(differ).select("a", "b")
        equal = b.drop("grp").join(front.drop("grp").filter("what <> ''"), "what").filter(differ).select("a", "b")
        out = written(group.unionByName(equal).distinct().orderBy("a", "b").limit(most), "pairs")
        if some >= left or out.count() >= most:
            return out.orderBy("a", "b"), every
        some *= 8

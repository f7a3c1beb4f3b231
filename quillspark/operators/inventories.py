"""Inventories item by item (D22, E17): what a section says of itself, and what of its lists can be read, over Variant values.

An inventory is JSON that a model's replies went into. One item that isn't as it should be doesn't make its section unread: it is set aside with
a reason, and what could be answered by it stays a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists that are read, with the keys of an item that is a mapping: needed, and text or nothing.
LISTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "capabilities": (("name",), ()),
    "evidence_claims": (("claim",), ("points_to",)),
    "authority": (("capability", "owner"), ("action",)),
    "defers_to": (("capability",), ("to",)),
    "consumes": (("name",), ()),
    "produces": (("name",), ()),
}
#: Lists of which an item may be bare text, its name.
NAMED = ("capabilities", "consumes", "produces")
#: What an item is taken as.
FIELDS = ("name", "claim", "points_to", "capability", "owner", "action", "polarity", "to", "quote")
#: Lists that only a reading by the whole schema fills.
WHOLE_SCHEMA = ("identifiers", "deferred", "evidence_claims", "consumes", "produces")


_KINDS = {"OBJECT": "mapping", "ARRAY": "list", "STRING": "text", "BOOLEAN": "truth", "BIGINT": "whole", "VOID": "null"}


def kind(v: Column) -> Column:
    """What a Variant is: mapping, list, text, whole, number, truth or null; nothing (a missing key) is null of SQL."""
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(v), "<", 1)), F.when(v.isNotNull(), "number"))


def part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def blank(x: Column) -> Column:
    """Whether text has nothing in it."""
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")) == "", F.lit(False))


def entries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slug, json) to sections (slug, runs, position from 1, of, entry as a Variant) and refused (slug, reason): what isn't an object of sections."""
    # what is parsed and looked at comes out of generators: a filter isn't taken below them, so no text is parsed more than once
    told = raw.select("slug", F.inline(F.array(F.struct(F.try_parse_json("json").alias("v")))))
    sections = part(F.col("v"), "sections")  # where there are some, nothing has to be known of the whole
    each = F.try_variant_get("v", "$.sections", "array<variant>")
    looked = F.struct(F.when(sections.isNotNull(), "mapping").otherwise(kind(F.col("v"))).alias("k"), F.when(each.isNotNull(), "list").otherwise(kind(sections)).alias("ks"), kind(part(F.col("v"), "runs")).alias("kr"))
    told = told.select("slug", "v", F.inline(F.array(looked)))
    reason = F.when(F.col("k").isNull(), "not JSON").when(F.col("k") != "mapping", F.concat(F.lit("a "), "k")).when(F.col("ks").isNull(), "no sections").when(F.col("ks") != "list", "sections aren't a list")
    told = told.withColumn("reason", reason)
    runs = F.when(F.col("kr") == "whole", F.try_variant_get("v", "$.runs", "int"))
    good = told.filter("reason IS NULL").select("slug", F.inline(F.array(F.struct(F.when(runs > 0, runs).alias("runs"), each.alias("each")))))
    out = good.select("slug", "runs", F.size("each").alias("of"), F.posexplode("each").alias("position", "entry"))
    return out.withColumn("position", F.col("position") + 1), told.filter("reason IS NOT NULL").select("slug", "reason")


def _with_kinds(rows: DataFrame, v: str, keys: tuple[str, ...], within: dict[str, Column] | None = None) -> DataFrame:
    """rows with the kinds of a Variant column and of what stands under keys, each worked out once: they come out of a generator. within: the rows
    in which a key is looked at."""
    at = lambda key: part(F.col(v), key) if within is None else F.when(within[key], part(F.col(v), key))
    whole = F.when(F.coalesce(*[at(key) for key in keys]).isNotNull(), "mapping").otherwise(kind(F.col(v)))  # what has a key is a mapping
    told = [whole.alias("k_"), *[kind(at(key)).alias(f"k_{key}") for key in keys]]
    return rows.select("*", F.inline(F.array(F.struct(*told))))


def _is(key: str, what: str) -> Column:
    return F.coalesce(F.col(f"k_{key}") == what, F.lit(False))


def _off(key: str, what: str) -> Column:
    """Whether something else stands under a key; a missing key is nothing else."""
    return F.coalesce(F.col(f"k_{key}") != what, F.lit(False))


def unreadable(e: Column) -> Column:
    """Why an entry isn't a section as it is written, or null: heading and locator are lines of text, counts of passes are whole numbers that
    agree, and each list is a list. Kinds are columns beside it."""
    why = F.when(_off("", "mapping"), F.concat(F.lit("it is a "), "k_"))
    for key in ("heading", "locator"):
        k = F.col(f"k_{key}")
        why = why.when(k.isNull(), f"it has no {key}").when(k != "text", F.concat(F.lit(f"its {key} is a "), k)).when(F.try_variant_get(e, f"$.{key}", "string").rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), f"its {key} has a line break")
    for key, what in (("passes", "whole"), ("full_passes", "whole"), ("degraded", "truth")):
        why = why.when(_off(key, what), F.concat(F.lit(f"its {key} is a "), f"k_{key}"))
    passes, full = F.try_variant_get(e, "$.passes", "long"), F.try_variant_get(e, "$.full_passes", "long")
    degraded = F.coalesce(F.try_variant_get(e, "$.degraded", "boolean"), F.lit(False))
    why = why.when(F.col("k_passes").isNull() != F.col("k_full_passes").isNull(), "one of its two counts of passes is missing").when(passes < 1, "no pass answered").when(full != passes - degraded.cast("long"), "its counts of passes don't agree")
    for key in LISTS:
        why = why.when(F.col(f"k_{key}").isNull(), f"it has no {key}").when(_off(key, "list"), F.concat(F.lit(f"its {key} is a "), f"k_{key}"))
    for key in ("identifiers", "deferred"):
        why = why.when(_off(key, "list"), F.concat(F.lit(f"its {key} is a "), f"k_{key}"))
    return why


def _holds(e: Column, key: str) -> Column:
    """Whether a list holds something: not only nulls and blank text."""
    items = F.try_variant_get(e, f"$.{key}", "array<variant>")
    return F.coalesce(F.exists(items, lambda i: ~((kind(i) == "null") | ((kind(i) == "text") & blank(F.try_variant_get(i, "$", "string"))))), F.lit(False))


#: What an entry says of itself.
ENTRY = ("heading", "locator", "passes", "full_passes", "degraded", "error", "skipped", "identifiers", "deferred", *LISTS)


def section_states(sections: DataFrame) -> DataFrame:
    """Sections of entries() with heading, locator, state and why: unread (with the reason), partial (by the fallback schema alone), short (fewer
    passes than asked) or read."""
    e = F.col("entry")
    own = lambda key: F.when(_is(key, "text"), F.try_variant_get(e, f"$.{key}", "string"))
    skip = F.coalesce(F.try_variant_get(e, "$.skipped", "boolean"), F.lit(False)) & _is("skipped", "truth")
    said = F.when(~blank(own("error")), F.regexp_replace(own("error"), r"\s+", " "))
    keyless = F.coalesce(*[F.col(f"k_{key}") for key in ENTRY]).isNull()
    why = (
        F.when(skip, F.coalesce(said, F.lit("skipped without a reason"))).when(F.col("k_error").isNotNull(), "extraction failed")
        .when(_is("", "null") | (keyless & (F.to_json(e) == "{}")), "nothing is there").otherwise(unreadable(e))
    )
    full, passes = F.try_variant_get(e, "$.full_passes", "long"), F.try_variant_get(e, "$.passes", "long")
    holds = _holds(e, WHOLE_SCHEMA[0])
    for key in WHOLE_SCHEMA[1:]:
        holds = holds | _holds(e, key)
    degraded = F.coalesce(F.try_variant_get(e, "$.degraded", "boolean"), F.lit(False))
    fields = F.struct(why.alias("why"), F.coalesce(own("heading"), F.lit("")).alias("heading"), F.coalesce(own("locator"), F.lit("")).alias("locator"), F.coalesce(full > 0, holds).alias("whole"), degraded.alias("fallback"))
    told = _with_kinds(sections, "entry", ENTRY).select(*sections.columns, F.inline(F.array(fields)))
    state = F.when(F.col("why").isNotNull(), "unread").when(F.col("fallback") & ~F.col("whole"), "partial").when(F.coalesce(passes, F.col("runs")) < F.col("runs"), "short").otherwise("read")
    return told.withColumn("state", state).drop("whole", "fallback")


def _wrong(key: str, i: Column) -> Column:
    """Why an item of a list isn't one, or null; kinds are columns beside it."""
    needed, optional = LISTS[key]
    own = lambda name: F.try_variant_get(i, f"$.{name}", "string")
    why = F.when(_is("", "text"), None) if key in NAMED else F.when(F.lit(False), None)
    why = why.when(_off("", "mapping"), F.concat(F.lit("is a "), "k_", F.lit(", not a mapping")))
    for name in needed:
        why = why.when(F.col(f"k_{name}").isNull(), f"has no {name}")
    for name in (*needed, *optional):
        off = _off(name, "text")
        if name in optional:  # null and empty lists or mappings are nothing
            off = off & ~_is(name, "null") & ~F.coalesce(F.to_json(part(i, name)).isin("[]", "{}"), F.lit(False))
        if name == "points_to":  # a list of places names them all
            places = F.try_variant_get(i, "$.points_to", "array<variant>")
            off = off & ~F.coalesce(F.forall(places, lambda p: kind(p) == "text"), F.lit(False))
        why = why.when(off, F.concat(F.lit("has a "), f"k_{name}", F.lit(f" for its {name}")))
        if name in needed:
            why = why.when(blank(own(name)), f"has nothing in its {name}")
    if key == "authority":
        why = why.when(_off("polarity", "null") & ~(_is("polarity", "text") & own("polarity").isin("owns", "excludes")), "has a polarity that isn't owns or excludes")
    return why


def _taken(key: str, i: Column) -> Column:
    """An item that can be read: text under the keys that its check looked at, and its quote."""
    own = lambda name: F.when(_is(name, "text"), F.try_variant_get(i, f"$.{name}", "string"))
    held = {n: own(n) for n in _keys(key)}
    if key in NAMED:
        held["name"] = F.when(_is("", "text"), F.try_variant_get(i, "$", "string")).otherwise(held["name"])
    if key == "evidence_claims":
        held["points_to"] = F.coalesce(held["points_to"], F.array_join(F.try_variant_get(i, "$.points_to", "array<string>"), " and "))
    return F.struct(*[held.get(n, F.lit(None).cast("string")).alias(n) for n in FIELDS])


def _keys(key: str) -> tuple[str, ...]:
    return (*LISTS[key][0], *LISTS[key][1], "quote", *(("polarity",) if key == "authority" else ()))


def inventory_items(sections: DataFrame) -> DataFrame:
    """Slug, position, heading, locator, list, item (its place from 1), why and the taken fields of every item of every section that was read.

    Items with a why are set aside, and their fields are null. Nulls and blank text in a list are no items. A list's
    items come out one by one, so no section is taken apart as a whole; all lists come out of one reading of the sections.
    """
    lists = F.array(*[F.struct(F.lit(key).alias("list"), F.try_variant_get(F.col("entry"), f"$.{key}", "array<variant>").alias("each")) for key in LISTS])
    own = sections.filter("state <> 'unread'").select("slug", "position", "heading", "locator", F.inline(lists))
    each = own.select("slug", "position", "heading", "locator", "list", F.posexplode("each").alias("item", "i"))
    i, keys = F.col("i"), tuple(dict.fromkeys(k for key in LISTS for k in _keys(key)))
    told = _with_kinds(each, "i", keys, {k: F.col("list").isin(*[key for key in LISTS if k in _keys(key)]) for k in keys})
    real = told.filter(~_is("", "null") & ~(_is("", "text") & blank(F.try_variant_get(i, "$", "string"))))
    of = lambda what: F.coalesce(*[F.when(F.col("list") == key, what(key, i)) for key in LISTS])
    told = real.select("slug", "position", "heading", "locator", "list", (F.col("item") + 1).alias("item"), F.inline(F.array(F.struct(of(_wrong).alias("why"), of(_taken).alias("t")))))
    return told.select("slug", "position", "heading", "locator", "list", "item", "why", *[F.when(F.col("why").isNull(), F.col(f"t.{n}")).alias(n) for n in FIELDS])


def blurred(items: DataFrame) -> DataFrame:
    """slug, position, list and aside of the sections that hold items which were set aside: an absence that one of them could answer is a question."""
    return items.filter("why IS NOT NULL").groupBy("slug", "position", "list").agg(F.count("*").alias("aside"))

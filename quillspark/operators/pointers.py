"""Pointers and the places they name (D24, D25, J25, J26): a grammar over typed tokens, folded inside the engine.

A pointer ("Sections 5, 6, and 7", "Appendix IV", "Table 4 of Section 2 onwards") is cut into tokens of a dozen kinds, and a fold over
them keeps what the grammar needs: the kind of place spoken of, where a range runs from, and whose number comes next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.durable import written

# How places are written.
NUMBER = r"\d+(?:\.\d+)*"
SIGN = "§"
#: Hyphen, non-breaking hyphen, figure dash, en dash, em dash, minus sign.
DASH = "‐‑‒–—−-"
ELLIPSIS = "…"
YEAR = r"^(?:19|20)\d\d$"
PART = r"(?<![\w-])(?i:(?:sub-?)?sections?\b|sect?\b\.?|clauses?\b|chapters?\b|chap\.|ch\.)"
#: The kinds of tokens in the order they are tried, and how each is written.
TOKENS = {
    "ident": r"\b[A-Z]{1,6}(?:[-_][A-Z]{1,6})*[-_]?\d+\b",
    "lettered": r"\b[A-Z]\.\d+(?:\.\d+)*",
    "section": rf"{PART}|{SIGN}+",
    "appendix": r"(?<![\w-])(?i:appendix|appendices)\b",
    "annex": r"(?<![\w-])(?i:annex|annexes)\b",
    "other": r"(?<![\w-])(?i:tables?\b|figures?\b|figs?\b\.?|pages?\b|pp?\.|paragraphs?\b|paras?\b\.?|par\.)",
    "count": r"(?<![\w-])(?i:lines?\b|rows?\b|items?\b|steps?\b|versions?\b|revisions?\b|issues?\b|rev\.|v\.)",
    "between": r"\b(?i:between)\b",
    "range": rf"\b(?i:up\s+to|through\s+to|to|through|thru|until|till)\b|[{ELLIPSIS}{DASH}]|\.{{2,}}",
    "open": r"\b(?i:onwards?|et\s+seq|ff|following|subsequent|passim|elsewhere|throughout|various|several|etc)\b",
    "number": rf"{NUMBER}[A-Za-z]?(?!\w)",
    "letter": r"\b(?:[IVX]{2,5}|[A-Z])\b|(?<=(?i:appendix)\s)[a-z]\b|(?<=(?i:annex)\s)[a-z]\b",
    "word": r"\w+",
}
LOCATION = rf"(?U)(?:{PART}|{SIGN}|(?<![\w-])(?i:appendix|appendices|annex|annexes)\b)"
OWN = r"(?i)\b(?:this|the\s+(?:same|above|following|preceding))\s+(?:sub-?)?(?:section|clause|chapter|appendix|annex|paragraph|table|figure|passage|page)\b|\bhere(?:in)?\b"
#: What may stand between the places of a pointer that names nothing else.
JOINT = r"""[\s,;&/()\[\].:'"]*"""
#: A heading's own number, and the marks in front of it.
LETTERED = rf"(?i:(appendix|annex))\s+((?i:[a-z])(?![A-Za-z])|[IVX]{{2,5}}(?![A-Za-z])|{NUMBER})"
NUMBERED = rf"(?:(?i:section|clause|chapter)\s+)?({NUMBER})"
FRONT = r"^(?:<[^>]*>|[\W_])+"
#: A marked heading's number ends where one of these follows.
AFTER_NUMBER = r"^[ \t.:)\]*_`<‐‑‒–—−-]"
# End of the fixed values.

ANY = "(?U)" + "|".join(f"({p})" for p in TOKENS.values())
PLACE_WORDS = ("section", "appendix", "annex")
#: Members that a range is written out to, past its first.
MOST_RUN = 200

KEY = "struct<kind: string, number: string>"
STATE = f"struct<carrier: string, last: string, start: string, owed: int, between: boolean, named: boolean, other: boolean, more: boolean, high: boolean, keys: array<{KEY}>>"


#: Around a token, and between the kinds that it could be, while a pointer is cut: marks that no text keeps.
_BEGIN, _BETWEEN, _END = "\x01", "\x02", "\x03"


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(target: Column) -> Column:
    """The tokens of a pointer, found in one pass: an array of (kind, text, name, year); name is how a number or a letter is compared."""
    plain = F.translate(target, _BEGIN + _BETWEEN + _END, "   ")
    marked = F.regexp_replace(plain, ANY, _BEGIN + _BETWEEN.join(f"${k}" for k in range(1, len(TOKENS) + 1)) + _END)
    each = F.regexp_extract_all(marked, F.lit(f"(?s){_BEGIN}([^{_END}]*){_END}"), F.lit(1))
    kinds = F.array(*[F.lit(k) for k in TOKENS])

    def told(token: Column) -> Column:
        at = F.array_position(F.transform(F.split(token, _BETWEEN), lambda x: x != ""), True).cast("int")
        return _let(F.struct(F.element_at(kinds, at).alias("kind"), F.element_at(F.split(token, _BETWEEN), at).alias("text")), lambda t: F.struct(
            t["kind"].alias("kind"), t["text"].alias("text"),
            F.when(t["kind"] == "number", T.plain_number(F.lower(t["text"]))).when(t["kind"] == "letter", F.lower(t["text"])).alias("name"), t["text"].rlike(YEAR).alias("year"),
        ))

    return F.transform(each, told)


def roman(name: Column) -> Column:
    """The number that a small Roman numeral of x, v and i stands for, or 0 for what isn't one written in the usual way."""
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    low = F.lower(name)
    tens, rest = F.regexp_extract(low, "^(x*)", 1), F.regexp_extract(low, "^x*(.*)$", 1)
    value = 10 * F.char_length(tens) + F.array_position(F.array(*[F.lit(x) for x in ones]), rest).cast("int") - 1
    return F.coalesce(F.when(low.rlike("^x*(?:ix|iv|v?i{0,3})$") & (low != ""), value), F.lit(0))


def numeral(n: Column) -> Column:
    """J25 the other way."""
    ones = F.array(*[F.lit(x) for x in ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]])
    return F.concat(F.repeat(F.lit("x"), F.floor(n / 10).cast("int")), F.element_at(ones, (n % 10 + 1).cast("int")))


def _letters(a: Column, b: Column) -> Column:
    return F.transform(F.sequence(F.ascii(a), F.greatest(F.ascii(a), F.ascii(b))), lambda n: F.char(n))


def run_of(first: Column, last: Column) -> Column:
    """What a range names, or nothing where that can't be told.

    Numbers run in their last part: 5.2 to 5.4; ends of different parents are taken as the parents, 3.1 to 4.2 as 3 and 4. 4a to 4c
    runs in its letter. Letters run as letters, and as Roman numerals where both ends are: i to v is both. Numbers of five digits
    and more, ranges backwards or past MOST_RUN can't be told.
    """
    none = F.array().cast("array<string>")
    word = first.rlike("^[A-Za-z]") | last.rlike("^[A-Za-z]")
    one = (F.char_length(first) == 1) & (F.char_length(last) == 1) & (first < last)
    low, high = roman(first), roman(last)
    spelled = F.concat(
        F.when(one, _letters(first, last)).otherwise(none),
        F.when((low > 0) & (low < high), F.transform(F.sequence(low, F.greatest(low, high)), numeral)).otherwise(none),
    )
    up, up2 = F.regexp_extract(first, r"^(.*)\.[^.]*$", 1), F.regexp_extract(last, r"^(.*)\.[^.]*$", 1)
    deep = (F.size(F.split(first, r"\.")) == F.size(F.split(last, r"\."))) & (up == up2)
    stem = F.when(deep & (up != ""), F.concat(up, F.lit("."))).otherwise("")
    a = F.when(deep, F.substring_index(first, ".", -1)).otherwise(F.substring_index(first, ".", 1))
    b = F.when(deep, F.substring_index(last, ".", -1)).otherwise(F.substring_index(last, ".", 1))
    tail = r"^(\d+)([a-z])$"
    n, x, y = F.regexp_extract(a, tail, 1), F.regexp_extract(a, tail, 2), F.regexp_extract(b, tail, 2)
    inner = (x != "") & (y != "") & (n == F.regexp_extract(b, tail, 1)) & (x < y)
    digits = a.rlike(r"^\d{1,4}$") & b.rlike(r"^\d{1,4}$")
    i, j = F.expr("cast(null as int)"), F.expr("cast(null as int)")
    i, j = F.when(digits, a.try_cast("int")), F.when(digits, b.try_cast("int"))
    fits = digits & (i <= j) & (j <= i + MOST_RUN)
    return (
        F.when(word, F.array_distinct(spelled))
        .when(inner, F.transform(_letters(x, y), lambda c: F.concat(stem, n, c)))
        .when(fits, F.transform(F.sequence(i, F.greatest(i, j)), lambda k: F.concat(stem, k.cast("string"))))
        .otherwise(none)
    )


def _step(s: Column, t: Column) -> Column:
    """One token further: a range that ends in it is written out first."""
    k = t["kind"]
    known = (k == "number") & s["carrier"].isNotNull() & ~((s["carrier"] == "section") & t["year"] & ~s["named"] & ~s["high"]) | (k == "letter") & F.coalesce(s["carrier"].isin("appendix", "annex"), F.lit(False))
    name = F.when(known, t["name"])
    own = F.struct(name.alias("name"), F.when(s["start"].isNotNull() & known, run_of(s["start"], t["name"])).alias("run"))
    return _let(own, lambda n: _after(s, t, n["name"], n["run"]))


def _after(s: Column, t: Column, name: Column, run: Column) -> Column:
    """What each field of the state is after a token. name: the place's number that it gives, or null; run: what its range names, or null."""
    k, text = t["kind"], t["text"]
    null, none = F.lit(None).cast("string"), F.array().cast(f"array<{KEY}>")
    key = lambda kind, number: F.struct(kind.alias("kind"), number.alias("number"))
    # the number of a table or a step, and the ranges of such numbers, name no place
    theirs = (s["owed"] == 1) & (k == "number")
    on = (s["owed"] == 2) & (k == "range")
    place, thing = k.isin(*PLACE_WORDS), k.isin("other", "count")
    to = (k == "range") | (s["between"] & s["last"].isNotNull() & (F.lower(text) == "and"))
    # the first end of a range stands among its members
    open_end = run.isNotNull() & (F.size(s["keys"]) > 0) & F.coalesce(F.get(s["keys"], F.size(s["keys"]) - 1) == key(s["carrier"], s["start"]), F.lit(False))
    before = F.when(open_end, F.slice(s["keys"], F.lit(1), F.greatest(F.size(s["keys"]) - 1, F.lit(0)))).otherwise(s["keys"])
    new = F.when(run.isNull(), F.array(name)).when(F.size(run) > 0, run).otherwise(F.array(s["start"], name))
    keys = (
        F.when(theirs | on, s["keys"]).when(name.isNotNull(), F.concat(before, F.transform(new, lambda n: key(s["carrier"], n))))
        .when(k == "lettered", F.concat(s["keys"], F.array(key(F.lit("appendix"), F.lower(F.substring(text, 1, 1)))))).otherwise(s["keys"])
    )
    still = theirs | on | (k == "between")
    last = F.when(still, s["last"]).when(name.isNotNull(), name).otherwise(null)
    start = F.when(still | (place & F.coalesce(k == s["carrier"], F.lit(False))), s["start"]).when(to, F.coalesce(s["last"], s["start"])).otherwise(null)
    return F.struct(
        F.when(place, k).otherwise(s["carrier"]).alias("carrier"),
        last.alias("last"),
        start.alias("start"),
        F.when(theirs, 2).when(on | thing, 1).otherwise(0).cast("int").alias("owed"),
        F.when(on, s["between"]).when(k == "between", True).when(to, False).otherwise(s["between"]).alias("between"),
        place.alias("named"),
        (s["other"] | (k == "other")).alias("other"),
        (s["more"] | (k == "open") | (F.coalesce(F.size(run), F.lit(1)) == 0) & ~theirs).alias("more"),
        # a list that counts in four digits goes on through "and", "or" and ranges; any other word ends it
        F.when(theirs, False).when(name.isNotNull(), F.coalesce((s["carrier"] == "section") & t["name"].rlike(r"^\d{4}$"), F.lit(False)))
        .when(to | k.isin("between", "range") | F.lower(text).isin("and", "or"), s["high"]).otherwise(False).alias("high"),
        F.coalesce(keys, none).alias("keys"),
    ).cast(STATE)


def pointed(target: Column) -> Column:
    """What a pointer names: keys, distinct (kind, number) in order; other, whether it names a table, figure, page or paragraph; more,
    whether it names more than it lists.

    Once a pointer has said "Section", every number after it is a section's, but the one straight after a word for another
    kind of thing. A year is a section's number only straight after the word, or in a list or range behind a section's number of four
    digits. Null points nowhere.
    """
    told = tokens(F.coalesce(target, F.lit("")))
    first = F.when(F.exists(told, lambda t: t["kind"] == "section"), "section")
    none = F.lit(None).cast("string")
    begin = F.struct(
        first.cast("string").alias("carrier"), none.alias("last"), none.alias("start"), F.lit(0).alias("owed"), F.lit(False).alias("between"), F.lit(False).alias("named"),
        F.lit(False).alias("other"), F.lit(False).alias("more"), F.lit(False).alias("high"), F.array().cast(f"array<{KEY}>").alias("keys"),
    ).cast(STATE)
    return F.aggregate(told, begin, _step, lambda s: F.struct(F.array_distinct(s["keys"]).alias("keys"), s["other"].alias("other"), s["more"].alias("more")))


#: Kinds that a bare pointer hasn't, and what stands for a token of another kind or for "and" and "or" once a text is marked.
NOT_BARE = ("ident", "other", "count", "open")
PASSES = f"{_BEGIN}{_BETWEEN}(?i:and|or)?{_END}"


def bare(target: Column) -> Column:
    """Whether a pointer is its places and nothing else: place words, numbers, letters, ranges, "and", "or" and marks between them.

    Two passes over the text: of a token only what may forbid it is kept, then tokens that pass go, and marks have to be left.
    """
    text, kinds = F.coalesce(target, F.lit("")), list(TOKENS)
    kept = "".join(f"${kinds.index(k) + 1}" for k in NOT_BARE)
    marked = F.regexp_replace(F.translate(text, _BEGIN + _BETWEEN + _END, "   "), ANY, f"{_BEGIN}{kept}{_BETWEEN}${kinds.index('word') + 1}{_END}")
    return ~text.rlike(f"[{_BEGIN}-{_END}]") & F.regexp_replace(marked, PASSES, "").rlike(f"^{JOINT}$")


def leading(text: Column) -> Column:
    """The place that a line opens with, as (kind, number, rest), or null. One letter behind a number belongs to it where it stands alone; a year is no number."""
    at = lambda pattern, k: F.regexp_extract(text, f"(?s)^{pattern}(.*)$", k)
    spelled = F.struct(F.lower(at(LETTERED, 1)).alias("kind"), T.plain_number(F.lower(at(LETTERED, 2))).alias("number"), at(LETTERED, 3).alias("rest"))
    number, rest = at(NUMBERED, 1), at(NUMBERED, 2)
    letter = F.regexp_extract(rest, r"^([a-z](?=[\s.:)]|$)|[A-Z](?=[.:)]|$))", 1)
    numbered = F.struct(F.lit("section").alias("kind"), T.plain_number(F.lower(F.concat(number, letter))).alias("number"), F.substring(rest, F.char_length(letter) + 1, F.char_length(rest)).alias("rest"))
    return F.when(at(LETTERED, 1) != "", spelled).when((number != "") & ((letter != "") | ~number.rlike(YEAR)), numbered)


def heading_place(text: Column, strict: bool = False) -> Column:
    """The place (kind, number) that a heading says it is, or null; marks in front don't count. strict: for marked headings, whose
    number has to end where a number ends ("3D flood twin design" is a title)."""
    found = leading(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){FRONT}", ""))
    place = F.struct(found["kind"].alias("kind"), found["number"].alias("number"))
    ends = (found["rest"] == "") | found["rest"].rlike(AFTER_NUMBER)
    return F.when(found.isNotNull() & (ends if strict else F.lit(True)), place)


def same(key: Column, other: Column) -> Column:
    """Whether two places (kind, number) are one; an appendix numbered II is Appendix 2, and one lettered I may be Appendix 1."""
    a, b = key["number"], other["number"]
    as_number = lambda x, y: x.rlike(r"^\d{1,4}$") & (roman(y) == F.when(x.rlike(r"^\d{1,4}$"), x.try_cast("int")))
    return (key["kind"] == other["kind"]) & ((a == b) | ((key["kind"] != "section") & F.coalesce(as_number(a, b) | as_number(b, a), F.lit(False))))


def under(key: Column, other: Column) -> Column:
    """Whether other is key or one of its sub-sections."""
    return same(key, other) | ((key["kind"] == "section") & (other["kind"] == "section") & F.startswith(other["number"], F.concat(key["number"], F.lit("."))))


def with_places(rows: DataFrame, target: str = "target") -> DataFrame:
    """rows with keys, other and more of pointed(). They come out of a generator, so that no later filter or projection folds a pointer twice.

    A pointer is folded once, however many rows have it. The distinct ones are written, so that a pointer of very many rows is dealt to several tasks where it
    meets them (a skewed join); rows are merged, never sent through the driver.
    """
    asked = rows.select(F.coalesce(target, F.lit("")).alias("_target")).distinct()
    told = written(asked.select("_target", F.inline(F.array(pointed(F.col("_target"))))), "pointers")
    return rows.withColumn("_target", F.coalesce(target, F.lit(""))).join(told.hint("merge"), "_target").drop("_target")


def places(rows: DataFrame, target: str = "target") -> DataFrame:
    """D24 as rows: id, kind, number."""
    return with_places(rows.select("id", target), target).select("id", F.inline("keys"))


def section_signs(cell: Column) -> Column:
    """The section numbers of a matrix cell: those behind a section sign."""
    return F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"§\s*(\d+(?:\.\d+)*)"), F.lit(1))


def sections_named(cell: Column) -> Column:
    """Every section that a note points at, distinct: numbers behind a sign or the word, then dotted ones."""
    text = F.coalesce(cell, F.lit(""))
    spoken = F.regexp_extract_all(text, F.lit(r"(?i)(?:§|\bsection\s+|\bsec\.?\s+)(\d+(?:\.\d+)*)"), F.lit(1))
    return F.array_distinct(F.concat(spoken, F.regexp_extract_all(text, F.lit(r"\b(\d+\.\d+(?:\.\d+)*)\b"), F.lit(1))))

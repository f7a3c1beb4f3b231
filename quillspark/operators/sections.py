"""Places of a document, what stands in them, and what an inventory or a letter says of them (2.A, 2.C, 2.D, 2.K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.operators import pointers

HEADING = r"^\s*(#|\d+(\.\d+)*[.\s]|Appendix|Annex)"


# Containment (D13, D14, D17); pointers.under() and same() say when a place is in another


def located(places: DataFrame, heads: DataFrame) -> DataFrame:
    """The headings (slug, kind, number, line, end) that a place (id, slug, kind, number) names: its own and its sub-sections'.

    Headings are met by each of their number's beginnings, and an appendix by its number in letters and in figures, so places and
    headings join by equality.
    """
    parts = F.split("number", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    figures = F.when(F.col("number").rlike(r"^\d{1,2}$"), pointers.numeral(F.col("number").try_cast("int"))).when(pointers.roman(F.col("number")) > 0, pointers.roman(F.col("number")).cast("string"))
    names = F.when(F.col("kind") == "section", ups).otherwise(F.array_compact(F.array("number", figures)))
    told = heads.select("slug", "kind", F.col("number").alias("found"), "line", "end", F.explode(names).alias("number"))
    return places.join(told, ["slug", "kind", "number"]).select("id", "slug", "kind", "number", "found", "line", "end").distinct()


def unlisted(lines: DataFrame) -> DataFrame:
    """(slug, line_no, text, marked): lines that open with a section's number, aren't headings (marked) and aren't items of a list:
    of the lines that aren't blank or indented, neither the one before nor the one after opens with a number too. The first of each number."""
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?\s+\S", 1)
    w = W.partitionBy("slug").orderBy("line_no")
    flush = lines.filter((F.trim("text") != "") & ~F.col("text").rlike(r"^\s")).withColumn("key", F.when(~F.col("marked") & (number != ""), T.plain_number(number)))
    alone = flush.withColumn("before", F.lag("key").over(w)).withColumn("after", F.lead("key").over(w)).filter("key IS NOT NULL AND before IS NULL AND after IS NULL")
    return alone.groupBy("slug", "key").agg(F.min("line_no").alias("line_no"))


def section_contexts(chunks: DataFrame, most: int = 1400) -> DataFrame:
    """(slug, heading, start, text): chunks of one top number are a section; its text in order, most characters at most, and how many chunks it has."""
    number = F.regexp_extract("heading", r"^(\d+)", 1)
    section = F.when(number != "", number).otherwise(F.col("heading"))
    told = chunks.withColumn("section", section).groupBy("slug", "section").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("own"), F.min("start").alias("start"))
    return told.select("slug", "section", "start", F.size("own").alias("chunks"), F.substring(F.array_join(F.transform("own", lambda x: x["text"]), "\n"), 1, most).alias("context"))


# Quantities and definitions

# What names a quantity, and words that aren't notation.
QUANTITY = r"\b(?:factor|threshold|coefficient|parameter|constant|weight|rate|budget|horizon|window|denominator|exponent)\s+([A-Za-zα-ω][A-Za-z0-9_α-ω]{0,14})\b"
SYMBOLIC = r"(?<![A-Za-zα-ω0-9_])([α-ω][A-Za-z0-9_]{0,12})\b"
UNDERSCORE = r"\b([a-zA-Z]{1,4}_[a-zA-Z][a-zA-Z0-9_]{0,14})\b"
NOT_NOTATION = "in is of to at on or an a it be by as we no so if up the and for".split()


def quantities(lines: DataFrame) -> DataFrame:
    """Every use of a quantity's symbol: slug, line_no, name. A symbol stands behind a noun for quantities, begins with a Greek
    letter, or has an underscore on a line that calculates; it looks like notation: one or two characters, an underscore, a digit or a Greek letter."""
    found = F.concat(
        F.regexp_extract_all("text", F.lit(QUANTITY), F.lit(1)), F.regexp_extract_all("text", F.lit(SYMBOLIC), F.lit(1)),
        F.when(F.col("text").rlike(T.MATHY), F.regexp_extract_all("text", F.lit(UNDERSCORE), F.lit(1))).otherwise(F.array().cast("array<string>")),
    )
    used = lines.select("slug", "line_no", F.explode(found).alias("name"))
    return used.filter(~F.lower("name").isin(*NOT_NOTATION) & ((F.char_length("name") <= 2) | F.col("name").rlike(r"[_0-9α-ω]")))


def unpinned(lines: DataFrame, window: int = 1) -> DataFrame:
    """Quantities of a document that no line within window of any use gives a value, an owner or a register entry: slug, name, uses, first_line.

    Uses meet the lines around them by equality: each use is put on the lines of its window.
    """
    used = quantities(lines)
    settled = lines.filter(F.col("text").rlike(T.ASSIGNED) | F.col("text").rlike(T.DISCLOSED) | F.col("text").rlike(T.OWNED)).select("slug", "line_no")
    near = used.select("slug", "name", F.explode(F.sequence(F.col("line_no") - window, F.col("line_no") + window)).alias("line_no")).distinct()
    pinned = near.join(settled, ["slug", "line_no"], "left_semi").select("slug", "name").distinct()
    return used.groupBy("slug", "name").agg(F.count("*").alias("uses"), F.min("line_no").alias("first_line")).join(pinned, ["slug", "name"], "left_anti")


def in_glossary(longest: int = 400) -> Column:
    """Whether a line (slug, line_no, text) stands under a heading that says glossary, definitions or terminology, before the next heading and longest lines on."""
    w = W.partitionBy("slug").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(HEADING), F.struct(F.col("line_no").alias("at"), F.col("text").rlike(r"(?i)\bglossary\b|\bdefinitions\b|\bterminology\b").alias("is")))
    h = F.last(mark, ignorenulls=True).over(w)
    return F.coalesce(h["is"] & (F.col("line_no") > h["at"]) & (F.col("line_no") < h["at"] + longest), F.lit(False))


def glossary_lines(lines: DataFrame, longest: int = 400) -> DataFrame:
    """Lines under a heading that says glossary, definitions or terminology, up to the next heading and longest lines on."""
    return lines.withColumn("_in", in_glossary(longest)).filter("_in").select("slug", "line_no", "text")


# Integrity


def roles(corpus: DataFrame) -> DataFrame:
    """(slug, role): what is wrong with a corpus, as rows: a role outside of the closed set, or another number of anchors than one."""
    known = ("anchor", "requirements", "draft", "reference")
    bad = corpus.filter(~F.coalesce(F.col("role").isin(*known), F.lit(False))).select("slug", F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("none"))).alias("fault"))
    anchors = corpus.agg(F.count_if(F.col("role") == "anchor").alias("n")).filter("n <> 1").select(F.lit(None).cast(corpus.schema["slug"].dataType).alias("slug"), F.format_string("%d anchors", "n").alias("fault"))
    return bad.unionByName(anchors)


def moved_headings(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document, the first inventory entry (slug, position, heading, first, last) that isn't where it says, as position and fault; no row where all are.

    An entry that repeats the heading before it is a later piece of that section and isn't looked at, nor is one behind an entry
    without a heading or a place. A document none of whose entries starts on a heading is tied to nothing: position is null.
    """
    w = W.partitionBy("slug").orderBy("position")
    size = lines.groupBy("slug").agg(F.max("line_no").alias("size"))
    at = lines.select("slug", F.col("line_no").alias("first"), F.regexp_replace(F.regexp_replace("text", r"^\s*#*\s*", ""), r"\s+$", "").alias("said"))
    seen = F.col("heading").isNotNull() & F.col("first").isNotNull()
    told = entries.withColumn("seen", seen).withColumn("before", F.lag("heading").over(w)).withColumn("blind", ~F.coalesce(F.lag("seen").over(w), F.lit(True)))
    met = told.join(size, "slug", "left").join(at, ["slug", "first"], "left")
    outside = F.col("seen") & ~F.coalesce((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("size")), F.lit(False))
    checked = F.col("seen") & (F.col("heading") != "(front matter)") & ~F.coalesce(F.col("heading") == F.col("before"), F.lit(False))
    tied = checked & F.coalesce(F.col("said") == F.col("heading"), F.lit(False))
    fault = F.when(outside, "outside of the text").when(checked & ~tied & ~F.col("blind"), "not the heading there")
    each = met.withColumn("fault", fault).groupBy("slug").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("position", "fault"))).alias("f"), F.bool_or(tied).alias("tied"))
    return each.filter(F.col("f").isNotNull() | ~F.col("tied")).select("slug", "f.position", F.coalesce("f.fault", F.lit("nothing ties it to the text")).alias("fault"))


def consulted(inventories: DataFrame, docs: DataFrame, moved: DataFrame) -> DataFrame:
    """Whether a document's text may be asked beside its inventory (slug, text_sha256): by its hash, or, where the inventory has none, by moved_headings()."""
    hashed = docs.select("slug", F.sha2("text", 256).alias("_h"))
    joined = inventories.join(hashed, "slug", "left").join(moved.select("slug", F.col("fault").alias("_f")), "slug", "left")
    why = (
        F.when(F.col("_h").isNull(), "no text").when(F.col("text_sha256").isNotNull() & (F.col("text_sha256") != F.col("_h")), "another text")
        .when(F.col("text_sha256").isNull() & F.col("_f").isNotNull(), F.col("_f"))
    )
    return joined.select("slug", why.isNull().alias("consulted"), why.alias("why"))


def dangling(lines: DataFrame, of: DataFrame) -> DataFrame:
    """C11: citations (§ and a number) of lines that no heading of the cited document (lines of) bears: slug, line_no, reference."""
    have = of.select(F.regexp_extract("text", r"^#{2,4}\s+(?:§?\s*)?([0-9]+(?:\.[0-9]+)*[a-z]?|[A-Z])\b", 1).alias("reference")).filter("reference <> ''").distinct()
    cited = lines.select("slug", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"§\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[A-Z])\b"), F.lit(1)))).alias("reference"))
    return cited.join(have, "reference", "left_anti").select("slug", "line_no", "reference")


def freeze(found: DataFrame, frozen: DataFrame | None, pins: DataFrame | None = None, refreeze: bool = False) -> tuple[DataFrame, DataFrame]:
    """(manifest, report) of documents (slug, source_sha256, text): what is already frozen keeps its entry unless refreeze.

    frozen: the manifest before. A source that doesn't begin with its pin (slug, pin), or drift on a plain run, is in the report, and
    the caller writes the manifest only where the report has no such row. On a refreeze the report has what became void: hashes and line counts.
    """
    now = found.select("slug", "source_sha256", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n")).alias("text_lines"))
    if pins is not None:
        now = now.join(pins.select("slug", "pin"), "slug", "left")
    else:
        now = now.withColumn("pin", F.lit(None).cast("string"))
    wrong = F.when(F.col("pin").isNotNull() & ~F.startswith("source_sha256", "pin"), "source hash mismatch")
    if frozen is None:
        return now.drop("pin"), now.withColumn("state", wrong).filter("state IS NOT NULL").select("slug", "state", F.lit("").alias("detail"))
    old = frozen.select("slug", F.col("source_sha256").alias("s0"), F.col("text_sha256").alias("t0"), F.col("text_lines").alias("n0"))
    both = now.join(old, "slug", "left")
    shift = F.concat(F.substring("t0", 1, 12), F.lit(" -> "), F.substring("text_sha256", 1, 12), F.format_string(", %d lines -> %d", "n0", "text_lines"), F.when(F.col("n0") != F.col("text_lines"), "  (EVERY LOCATOR SHIFTS)").otherwise(""))
    if refreeze:
        state = F.coalesce(wrong, F.when(F.col("t0").isNotNull() & (F.col("t0") != F.col("text_sha256")), "locators void"))
    else:
        state = F.coalesce(wrong, F.when(F.col("s0") != F.col("source_sha256"), "source changed").when(F.col("t0") != F.col("text_sha256"), "text edited"))
    told = both.withColumn("state", state)
    kept = told if refreeze else told.withColumn("source_sha256", F.coalesce("s0", "source_sha256")).withColumn("text_sha256", F.coalesce("t0", "text_sha256")).withColumn("text_lines", F.coalesce("n0", "text_lines"))
    report = told.filter("state IS NOT NULL").select("slug", "state", F.when(F.col("state") == "locators void", shift).otherwise("").alias("detail"))
    return kept.select("slug", "source_sha256", "text_sha256", "text_lines"), report


# Owners and self-claims


def section_owners(sections: DataFrame) -> DataFrame:
    """(slug, position, heading): the component that each top section is about: the first heading that bears its number."""
    number = F.regexp_extract(F.trim("heading"), r"^(\d+)\.\s+(\S.*)$", 1)
    named = sections.select("slug", "position", number.alias("number"), F.trim(F.regexp_extract(F.trim("heading"), r"^(\d+)\.\s+(\S.*)$", 2)).alias("owner")).filter("number <> ''")
    return named.groupBy("slug", "number").agg(F.min_by("owner", "position").alias("owner"))


def deferral_sources(deferrals: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, slug, heading) with the owner of the section that a deferral stands in."""
    return deferrals.withColumn("number", F.regexp_extract(F.trim("heading"), r"^(\d+)", 1)).join(owners, ["slug", "number"], "left").select("id", "slug", F.col("owner").alias("source"))


# Words that say nothing of what a claim claims.
BOILERPLATE = "requirement requirements addressed covered satisfied section sections appendix annex described detailed provided given listed shown documented stated above below this through across".split()


def claim_words(x) -> Column:
    """Content words of a claim: four characters or more, without boilerplate and identifiers."""
    found = F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9-]{3,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~F.lower(w).isin(*BOILERPLATE) & ~w.rlike(r"^[A-Z]{1,4}[-_]?\d{1,4}$"))
    return F.array_distinct(F.transform(kept, F.lower))


def self_claims(claims: DataFrame, heads: DataFrame, held: DataFrame, read: DataFrame, least: float = 0.34) -> DataFrame:
    """What a document says of itself: (id, slug, claim, target) against its headings and what was read under them.

    heads: (slug, kind, number, line, end). held: (slug, first, last, capability), what the inventory has on which lines, and blurred, whether
    some of it couldn't be read. read: (slug, complete), whether every section was read, and marked, whether the document marks its
    headings. claims may have line, where the claim is made: then "this section" beside another place is the innermost
    heading there, a different place each time. blurred, marked and line may be left out.

    A claim is checked where its target names a place and it has two words of content; each is checked once for one set of
    places. state: one of eight reasons why it wasn't checked, or held, or the finding. doubt says what stands between a finding and
    asserting it; a finding is doubtful where there is any.
    """
    def with_default(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df if name in df.columns else df.withColumn(name, value)

    claims = with_default(claims, "line", F.lit(None).cast("int"))
    held, read = with_default(held, "blurred", F.lit(False)), with_default(read, "marked", F.lit(True))
    target = F.trim(F.coalesce("target", F.lit("")))
    told = pointers.with_places(claims.withColumn("words", claim_words(F.col("claim"))).withColumn("own", target.rlike(pointers.OWN)).withColumn("bare", pointers.bare(target)))
    told = told.withColumn("keys", F.array_sort("keys"))
    # what a finding is: this claim, these places, and for "this section" the passage it is said in
    mark = F.to_json(F.struct(F.array_sort("words").alias("w"), "keys", F.when(F.col("own"), F.coalesce("line", F.lit(-1))).alias("at")))
    told = told.withColumn("_mark", F.when((F.size("keys") > 0) & (F.size("words") >= 2), mark))
    first = F.row_number().over(W.partitionBy("slug", "_mark").orderBy("id"))
    why = (
        F.when(F.col("claim").isNull(), "not a claim").when(target == "", "no pointer").when((F.size("keys") > 0) & (F.size("words") < 2), "too little said")
        .when((F.size("keys") > 0) & (first > 1), "said before").when(F.size("keys") > 0, F.lit(None)).when(F.col("own"), "its own section")
        .when(F.col("other"), "a table or a page").when(target.rlike(pointers.LOCATION), "no number").otherwise("no place")
    )
    told = told.withColumn("why", why)
    asked = told.filter("why IS NULL")
    at = located(asked.select("id", "slug", F.inline("keys")), heads)
    named = at.groupBy("id").agg(F.bool_or(F.col("found") == F.col("number")).alias("headed"), F.lit(True).alias("there"))
    # lines and sections meet in pieces of 256 lines, so that no document is compared whole
    cut = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / 256), F.floor(F.col(b) / 256))))
    said_at = asked.filter("own AND line IS NOT NULL").select("id", "slug", F.col("line").alias("said"), F.floor(F.col("line") / 256).alias("_b"))
    inside = said_at.join(cut(heads.select("slug", "line", "end"), "line", "end"), ["slug", "_b"]).filter("line <= said AND said <= end")
    passage = inside.groupBy("id", "slug").agg(F.max(F.struct("line", "end")).alias("h")).select("id", "slug", "h.line", "h.end")
    found = at.select("id", "slug", "line", "end").unionByName(passage).distinct()
    met = cut(found, "line", "end").join(cut(held, "first", "last"), ["slug", "_b"]).filter("first <= end AND line <= last")
    words = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set(T.concepts(F.col("capability"))))).alias("present"), F.bool_or("blurred").alias("blurred"))
    each = told.join(named, "id", "left").join(words, "id", "left").join(read, "slug", "left")
    said = T.concepts(F.col("claim"))
    whole = F.coalesce("complete", F.lit(False))
    state = (
        F.when(F.col("why").isNotNull(), F.concat(F.lit("not checked: "), "why")).when(F.col("present").isNull() & F.col("there").isNull(), F.when(whole, "no such section").otherwise("not among what was read"))
        .when(F.col("present").isNull(), "in the document, not in the inventory").when(T.overlap(said, F.col("present")) >= least, "held")
        .otherwise(F.when(whole, "not held there").otherwise("not held in what was read"))
    )
    doubt = F.concat_ws(
        "; ", F.when(~whole, "sections are unread"), F.when(~F.coalesce("marked", F.lit(False)), "headings aren't marked"), F.when(F.col("more"), "more places are named than listed"),
        F.when(~F.col("more") & ~F.col("bare"), "the pointer says more than its places"), F.when(F.col("there") & ~F.col("headed"), "found by sub-sections alone"),
        F.when(F.col("blurred"), "a capability there wasn't read"), F.when(F.col("state") == "in the document, not in the inventory", "the inventory has nothing there"),
    )
    finding = ~F.col("state").startswith("not checked") & (F.col("state") != "held")
    out = each.withColumn("state", state).withColumn("doubt", F.when(finding, doubt).otherwise(""))
    return out.select("id", "slug", "state", (F.col("doubt") != "").alias("doubtful"), "doubt")


# Letters and labels


# How a letter numbers, closes, cites a comment, reissues it, and limits that.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: A list number stands before two blanks or alone; a page's "18. Please" in running text doesn't.
LIST_NUMBER = r"^\s{0,12}(\d{1,3})\.(?:\s{2,}|\s*$)"
CLOSING = r"We remind you that|Refer to Rules 460 and 461|Please contact\b|Sincerely,|We urge all persons"
_NUM = rf"(?:\d{{1,3}}(?![\d%]|,\d{{3}}|\.\d)|(?:{'|'.join(reversed(T.NUMBER_WORDS))})\b)"
CITED = rf"(?i)\b(?:prior comments?|responses? to comments?)\s+(?:(?:nos?\.?|numbers?)\s+)?({_NUM}(?:(?:\s*,\s*(?:(?:and|or)\s+)?|\s+(?:and|or|through)\s+|\s*&\s*|\s*[-–]\s*){_NUM})*)"
#: Behind a citation: another letter, by its date.
OF_LETTER = rf"(?:\s*,?\s*(?:of|in|from)\s+(?:our|the)\s+(?:(?:prior\s+|previous\s+)?(?:comment\s+)?letter\s+(?:dated|of)\s+)?((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}))?"
REISSUED = r"(?i)\bre-?s?issu\w*|\breiterat\w*"
BY_US = r"(?i)\bwe\b[^.]*?\b(?:re-?s?issu(?:e|ing)|reiterat(?:e|ing))\b|\bcomments?\b"
IN_PART = r"(?i)\bin part\b|\bpartially\b|\bwith respect to\b|\bto the extent\b|\bportions?\b|\bbullets?\b|\bremaining\b|\b(?:first|second|third|last|final) (?:sentence|paragraph)\b"
IN_FULL = r"(?i)\bin full\b|\bin (?:its|their) entirety\b"
TITLES = r"\b(Mr|Ms|Mrs|Messrs|Dr)\.\s+"
SENTENCE_END = r'(?<=[.?!])\s+(?=[A-Z"“(])'
# End of the fixed values.


def letter_outline(lines: DataFrame) -> DataFrame:
    """Numbered comments of letters (slug, line_no, text), in sequence: slug, number, first, body. Page headers (a page number under a date) go.

    A comment opens on the line that begins with the next number; a letter without number 1, or where the number after a missing one
    stands, gives no row. The next number is what the largest count so far leaves open, so candidates are the lines whose number is
    one more than the candidates before them: found by keeping, of each number, the first line behind its predecessor's.
    """
    number = F.regexp_extract("text", LIST_NUMBER, 1)
    w = W.partitionBy("slug").orderBy("line_no")
    page = F.col("text").rlike(r"^\s*Page \d+\s*$")
    dated = F.col("text").rlike(r"^\s*[A-Z][a-z]+ \d{1,2}, \d{4}\s*$")
    clean = lines.withColumn("_p", page & F.lag(dated, 1, False).over(w)).withColumn("_q", dated & F.lead(page, 1, False).over(w)).filter("NOT _p AND NOT _q").drop("_p", "_q")
    marks = clean.withColumn("n", F.when(number != "", number.cast("int")))
    # the number that is open at each line: a fold over a letter's numbered lines, which are few
    own = marks.filter("n IS NOT NULL").groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("line_no", "n"))).alias("m"))
    start = F.struct(F.lit(0).alias("last"), F.expr("cast(array() as array<struct<number: int, first: int>>)").alias("got"), F.lit(False).alias("skipped"))
    step = lambda s, x: F.when(x["n"] == s["last"] + 1, F.struct(x["n"].alias("last"), F.concat(s["got"], F.array(F.struct(x["n"].alias("number"), x["line_no"].alias("first")))).alias("got"), F.lit(False).alias("skipped"))).otherwise(F.struct(s["last"].alias("last"), s["got"].alias("got"), (s["skipped"] | (x["n"] == s["last"] + 2)).alias("skipped")))
    read = own.withColumn("s", F.aggregate("m", start, step)).filter("NOT s.skipped AND size(s.got) > 0").select("slug", F.inline("s.got"))
    joined = clean.join(read.select("slug", F.col("first").alias("line_no"), "number"), ["slug", "line_no"], "left")
    within = joined.withColumn("number", F.last("number", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("number IS NOT NULL")
    body = within.groupBy("slug", "number").agg(F.min("line_no").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("body"))
    text = T.fold(F.regexp_replace("body", r"^\s*\d{1,3}\.\s*", ""))
    # the closing paragraph isn't the last comment's, if nothing is cited or reissued behind its opening
    last = F.col("number") == F.max("number").over(W.partitionBy("slug"))
    before, behind = F.regexp_extract(text, f"(?s)^(.*?)(?:{CLOSING}).*$", 1), F.regexp_extract(text, f"(?s)^.*?((?:{CLOSING}).*)$", 1)
    closed = last & (behind != "") & ~behind.rlike(CITED) & ~behind.rlike(REISSUED)
    return body.select("slug", "number", "first", F.when(closed, F.rtrim(before)).otherwise(text).alias("body"))


def rulings(comments: DataFrame) -> DataFrame:
    """(slug, number, body) of second-round comments: for each prior comment cited, addressed, partial or not_addressed.

    A cited comment is addressed until a sentence of the same comment reissues it: the ones it cites, or, where it cites none and it is
    the writer that reissues a comment, all that are cited around it. A comment of another letter, told apart by its date where
    comments have first, the date of the letter that this one answers, is none of them, and a sentence that cites only such
    reissues nothing. The harshest ruling over a letter stays, with the comment that has it. "Mr. Wong" ends no sentence.
    """
    whole = F.regexp_replace("body", TITLES, "$1.\x01")
    first = F.col("first").cast("date") if "first" in comments.columns else F.lit(None).cast("date")
    sentence = comments.select("slug", "number", first.alias("first"), F.posexplode(F.split(whole, SENTENCE_END)).alias("k", "said"))
    sentence = sentence.withColumn("said", F.translate("said", "\x01", " "))
    found = F.arrays_zip(F.regexp_extract_all("said", F.lit(CITED + OF_LETTER), F.lit(1)).alias("numbers"), F.regexp_extract_all("said", F.lit(CITED + OF_LETTER), F.lit(2)).alias("letter"))
    other = lambda x: (x["letter"] != "") & ~F.coalesce(F.try_to_date(F.regexp_replace(F.regexp_replace(x["letter"], ",", ""), r"\s+", " "), "MMMM d yyyy") == F.col("first"), F.col("first").isNull())
    told = sentence.withColumn("found", found).select("slug", "number", "k", "said", F.array_distinct(F.flatten(F.transform(F.filter("found", lambda x: ~other(x)), lambda x: T.comment_numbers(x["numbers"])))).alias("cites"), F.exists("found", other).alias("elsewhere"))
    here = F.size("cites") > 0
    again = F.col("said").rlike(REISSUED) & (here | (~F.col("elsewhere") & F.col("said").rlike(BY_US)))
    told = told.withColumn("level", F.when(again, F.when(F.col("said").rlike(IN_PART) & ~F.col("said").rlike(IN_FULL), 1).otherwise(2)).otherwise(0))
    around = told.groupBy("slug", "number").agg(F.array_distinct(F.flatten(F.collect_list("cites"))).alias("all"))
    both = told.join(around, ["slug", "number"])
    hit = F.when((F.col("level") > 0) & ~here, F.col("all")).otherwise(F.col("cites"))
    each = both.select("slug", "number", "level", F.explode(hit).alias("prior"))
    worst = each.groupBy("slug", "prior").agg(F.max(F.struct("level", -F.col("number"))).alias("w"))
    level = F.col("w.level")
    return worst.select("slug", "prior", F.when(level == 2, "not_addressed").when(level == 1, "partial").otherwise("addressed").alias("verdict"))


def latest_claim(letters: DataFrame) -> DataFrame:
    """(id, ours, date, text): each addressee's last word, without our own letters and empty ones."""
    theirs = letters.filter(~F.col("ours") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return theirs.groupBy("id").agg(F.max_by("text", F.struct("date", "text")).alias("claim"), F.max("date").alias("date"))


def next_reply(letters: DataFrame, replies: DataFrame) -> DataFrame:
    """(company, id, date) with the first reply (company, reply, date) on or after it, before the company's next letter."""
    w = W.partitionBy("company").orderBy("date", "kind", "id")
    both = letters.select("company", "date", F.lit(0).alias("kind"), "id").unionByName(replies.select("company", "date", F.lit(1).alias("kind"), F.col("reply").alias("id")))
    told = both.withColumn("after", F.lead(F.struct("kind", "id")).over(w)).filter("kind = 0")
    return told.select("company", "id", F.when(F.col("after.kind") == 1, F.col("after.id")).alias("reply"))


def spread_pick(docs: DataFrame, count: int, least: int = 8000) -> DataFrame:
    """Count documents (id, size) evenly over the sizes of least or more, or over all where none has it."""
    from quillspark.operators.aggregates import ranked

    usable = docs.filter(F.col("size") >= least)
    usable = docs if usable.isEmpty() else usable
    n = usable.count()
    step = max(1, n // count)
    places = sorted({min(k * step, n - 1) + 1 for k in range(count)})  # count numbers at most
    return ranked(usable, [F.col("size"), F.col("id")], "place").filter(F.col("place").isin(*places))


def without_section(lines: DataFrame, heading: str) -> DataFrame:
    """A revision without a marked section: from its heading to the next of its depth or a higher one."""
    depth = F.char_length(F.regexp_extract("text", r"^(#+)\s", 1))
    here = F.trim("text") == heading
    level = len(heading) - len(heading.lstrip("#"))
    w = W.partitionBy("slug").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(here, True).when((depth > 0) & (depth <= level), False)
    return lines.withColumn("_g", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))).filter("NOT _g").drop("_g")


def without_table(lines: DataFrame, heading: str, instead: str) -> DataFrame:
    """A revision in which the table that follows a heading and one blank line is one line of other text."""
    w = W.partitionBy("slug").orderBy("line_no")
    row = F.col("text").startswith("|")
    opens = row & (F.lag("text", 1).over(w) == "") & (F.rtrim(F.lag("text", 2).over(w)) == heading)
    # a run of rows belongs to the opening that it begins with; any other line closes it
    told = lines.withColumn("_o", opens).withColumn("_t", F.last(F.when(F.col("_o"), True).when(~row, False), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    gone = row & F.coalesce("_t", F.lit(False))
    return told.filter(~gone | F.coalesce("_o", F.lit(False))).withColumn("text", F.when(F.coalesce("_o", F.lit(False)), instead).otherwise(F.col("text"))).drop("_o", "_t")


def renamed(lines: DataFrame, renames: dict[str, str]) -> DataFrame:
    """A revision with headings renamed."""
    text = F.col("text")
    for old, new in renames.items():
        text = F.when(F.col("text").startswith("#"), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    return lines.withColumn("text", text)


def joined_texts(lines: DataFrame) -> DataFrame:
    """Documents put together again from their lines."""
    own = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("slug").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))


def register_rows(lines: DataFrame) -> DataFrame:
    """Rows of a register written as Markdown: (slug, line_no, id, cells) of table lines that begin with an id."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.filter(F.col("text").rlike(r"^\s*\|\s*[A-Z]{1,3}-?\d+\s*\|")).select("slug", "line_no", F.get(cells, F.lit(0)).alias("id"), F.slice(cells, 2, F.size(cells)).alias("cells"))


def deny_phrases(rows: DataFrame) -> DataFrame:
    """A denylist (phrase) by the length of its phrases: n, digest."""
    words = F.filter(F.split(T.loose(F.col("phrase")), " "), lambda w: w != "")
    return rows.select(F.size(words).alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest")).filter("n > 0").distinct()


def place_key(x, strict: bool = False) -> Column:
    """The place (kind, number) that a heading says it is, or null."""
    return pointers.heading_place(x, strict)

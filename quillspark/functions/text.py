"""Scalar text functions as columns: folding, tokens, similarity, numbering, locators and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that retrieval and concept comparison leave out.
RETRIEVAL_STOP = """a an the and or of to in for on with by is are be been shall must should may not that this these
those it its as at from any all each every per which where when who whom whose if then than such other same both
either""".split()
CONCEPT_STOP = """the a an and or of to in for on with by is are be been shall must should may not that this these
those it its as at from any all each every per which where when who whom whose""".split()
SUBJECT_NOISE = "the a an this that its their system platform component service module layer document".split()

# Identifier families and predicates on lines.
IDENTIFIERS = (r"\b[A-Z]{2,4}-G-?\d{1,3}\b", r"\bIF-[A-Z]{2,5}-\d{1,3}\b", r"\bND-\d{1,3}\b", r"\b(?:CF|PG)-\d{1,3}\b")
ASSIGNED = r"(?i)=\s*[-+]?\d|\bset to\b|\bdefaults? to\b|\bis\s+[-+]?\d|\bvalue of\b|\bequals\b"
OWNED = r"(?i)\bowner\b|\blead\b|\bowned by\b|\bresponsible\b"
MATHY = r"(?i)[=*^]|\u00b7|\bsum\b|\bsigmoid\b|\bsqrt\b|\blog\b|\bmin\b|\bmax\b|\bexp\b|lVert|\([ijklmnt],"
DISCLOSED = r"\b(?:ND-\d{1,3}|[A-Z]{2,5}-G-?\d{1,3}|[A-Z]{2,4}-\d{1,3})\b"
UNIVERSAL = r"(?i)\b(?:every|each|all|any|no)\s+\w+"
CLAIMED = r"(?i)\b(adjust|updat|amend|revis|add|added|includ|insert|remov|delet|rewrit|rewrote|clarif|defin|correct|expand|renam|reorganis|reorganiz|restructur|incorporat|address|resolv|chang|modif)\w*"
DEFERRED = r"(?i)\b(will|shall|intend|plan|to be|going to|next|future|pending|plann)\w*\b"
POINTER = r"(?i)\b(?:is|are|was|were|shall\s+be|will\s+be|been)?\s*(?:assessed|recorded|documented|described|provided|defined|specified|listed|detailed|addressed|covered|contained|captured|set\s+out|stated)\s+(?:in|under|at|within)\s+(?:the\s+)?(?:section|appendix|annex|table|figure|chapter|clause|paragraph|register|\u00a7)\b"
CROSS_REFERENCE = r"(?i)\b(?:see|refer\s+to|as\s+per|per)\s+(?:the\s+)?(?:section|appendix|annex|table|figure|clause|§)\b"
DONE_WORDS = ("completed", "complete", "done", "closed", "resolved")
OPEN_WORDS = ("new", "", "block identified", "blocked")


def fold(x) -> Column:
    """White space made single and trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fold_lower(x) -> Column:
    """Fold and lower case."""
    return F.lower(fold(x))


def loose(x) -> Column:
    """Everything but letters and digits is a blank."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def bare_title(x) -> Column:
    """A title without digits at its end, other marks as blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, r"\d+$", "")), "[^a-z0-9 ]", " "))


def one_line(x) -> Column:
    """Control characters are blanks."""
    return F.regexp_replace(x, r"\p{Cntrl}", " ")


def shortened(x, most: int = 32) -> Column:
    """A value as a reason shows it."""
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def searchable(x, words: int = 9) -> Column:
    """The first words of a folded text, without marks at its ends."""
    return F.regexp_replace(F.array_join(F.slice(F.split(fold(x), " "), 1, words), " "), "^[ ,;:.]+|[ ,;:.]+$", "")


def first_long_line(x, least: int = 25) -> Column:
    """The first line of at least so many characters."""
    return F.get(F.filter(F.split(x, "\n"), lambda y: F.char_length(F.trim(y)) >= least), F.lit(0))


def without_brackets(x) -> Column:
    """Bracketed parts at the end are cut off."""
    return F.trim(F.regexp_replace(x, r"(\s*[(\[][^()\[\]]*[)\]])+\s*$", ""))


def escaped(x) -> Column:
    """The three characters that markup reserves."""
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def words_of(x, pattern: str, stop=()) -> Column:
    """Matches of a pattern in the lower-cased text, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def terms(x, stop=tuple(RETRIEVAL_STOP)) -> Column:
    """Retrieval terms, a multiset."""
    return words_of(x, r"[a-z][a-z0-9\-]{2,}", stop)


def concepts(x) -> Column:
    """Concept words, a set."""
    return F.array_distinct(words_of(x, "[a-z0-9]{3,}", CONCEPT_STOP))


def content_words(x, least: int = 4) -> Column:
    """Letters only, of at least so many."""
    return F.array_distinct(words_of(x, f"[a-z]{{{least},}}", RETRIEVAL_STOP))


def grams(words: Column, n: int) -> Column:
    """N neighbouring words, joined by a blank. Shifted copies are zipped, so words are read n times, not once a gram."""
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), count), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """J20, I04."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def share_of(a: Column, b: Column) -> Column:
    """The share of a that is in b."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def column_number(letters: Column) -> Column:
    """A is 1, AA is 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """J23 the other way, for up to three letters."""
    n = number.cast("int")
    third, second, first = F.floor((n - 703) / 676), F.floor((n - 27) / 26), (n - 1) % 26
    letter = lambda v: F.char(v.cast("int") + 65)
    return F.concat(F.when(n > 702, letter(third % 26)).otherwise(""), F.when(n > 26, letter(second % 26)).otherwise(""), letter(first))


def plain_number(x) -> Column:
    """03.1 is 3.1 and 3.0 is 3."""
    parts = F.transform(F.split(x, r"\."), lambda p: F.when(F.regexp_replace(p, "^0+", "") == "", "0").otherwise(F.regexp_replace(p, "^0+", "")))
    return F.regexp_replace(F.array_join(parts, "."), r"(\.0)+$", "")


def iso_date(x) -> Column:
    """J29: "March 13, 2024" as a date."""
    return F.try_to_date(x, "MMMM d, yyyy") if hasattr(F, "try_to_date") else F.to_date(x, "MMMM d, yyyy")


def locator(x) -> Column:
    """Slug:a-b as a struct of slug, first and last; a single line is a range of one."""
    first = F.regexp_extract(x, r"^(.*):(\d+)(?:-(\d+))?$", 2)
    last = F.regexp_extract(x, r"^(.*):(\d+)(?:-(\d+))?$", 3)
    return F.struct(
        F.nullif(F.regexp_extract(x, r"^(.*):(\d+)(?:-(\d+))?$", 1), F.lit("")).alias("slug"),
        F.nullif(first, F.lit("")).cast("int").alias("first"),
        F.coalesce(F.nullif(last, F.lit("")), F.nullif(first, F.lit(""))).cast("int").alias("last"),
    )


def citation(x, lines: Column, widest: int = 60) -> Column:
    """E14: 'ok' or why a citation of line numbers isn't one."""
    pattern = r"^\s*(\d+)\s*(?:[-:–—]\s*(\d+))?\s*$"
    first = F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).cast("int")
    last = F.coalesce(F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")).cast("int"), first)
    return (
        F.when(first.isNull(), "not a range").when((first < 1) | (last > lines) | (last < first), "outside").when(last - first >= widest, "too wide").otherwise("ok")
    )


def rate(hit: Column, total: Column) -> Column:
    """hit/total as a percentage to one place."""
    return F.when(total == 0, F.lit("n/a")).otherwise(F.concat(F.round(hit * 100.0 / total, 1).cast("string"), F.lit("%")))


def occurrences(text: Column, word) -> Column:
    """Non-overlapping occurrences of a string."""
    word = F.lit(word) if isinstance(word, str) else word
    return ((F.char_length(text) - F.char_length(F.replace(text, word, F.lit("")))) / F.char_length(word)).cast("long")


def adjudication(state: Column, status: Column) -> Column:
    """What a claimed status is worth against what the text shows; null without a comment."""
    said = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    settled, moved = state.isin("UNCHANGED", "STILL ABSENT"), state.isin("CHANGED", "ADDED", "REMOVED")
    return (
        F.when(said.isin(*DONE_WORDS) & settled, "DISPUTED")
        .when(said.isin(*DONE_WORDS) & moved, "SUPPORTED")
        .when((said == "in progress") & settled, "NO MOVEMENT")
        .when(said.isin(*OPEN_WORDS) & moved, "UNCLAIMED CHANGE")
    )


def is_claim(x) -> Column:
    """Says that a change was made, and doesn't put it off."""
    return x.rlike(CLAIMED) & ~x.rlike(DEFERRED)


def points_elsewhere(x) -> Column:
    """A pointer or a cross-reference, which is no evidence for what it says."""
    return x.rlike(POINTER) | x.rlike(CROSS_REFERENCE)


def quoted(x, most: int | None = None) -> Column:
    """A cited passage as it is shown, and whether it is a block: two table rows or more stay rows, prose is reflowed."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda y: F.trim(y)), lambda y: y != "")
    rows = F.filter(lines, lambda y: occurrences(y, "|") >= 2)
    shown = rows if most is None else F.when(F.size(rows) > most, F.concat(F.slice(rows, 1, most), F.array(F.format_string("| … %d further row(s) |", F.size(lines) - most)))).otherwise(rows)
    block = F.size(rows) >= 2
    return F.struct(F.when(block, F.array_join(shown, "\n")).otherwise(fold(x)).alias("shown"), block.alias("block"))


# Numbers that letters write as words.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def comment_numbers(x, widest: int = 30) -> Column:
    """The numbers in "3, 4 and 7", "5 through 8" or "five and seven"; a range is written out where it rises by widest at most."""
    tokens = F.regexp_extract_all(F.lower(x), F.lit(rf"\d+|through|[-–]|\b(?:{'|'.join(reversed(NUMBER_WORDS))})\b"), F.lit(0))
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    value = lambda t: F.when(t.rlike(r"^\d+$"), t.cast("int")).otherwise(F.array_position(words, t).cast("int"))
    # each number with the token before it and the number before that
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.when(i > 0, F.get(tokens, i - 1)).alias("p"), F.when(i > 1, value(F.get(tokens, i - 2))).alias("q")))
    numbers = F.filter(placed, lambda r: ~r["t"].isin("through", "-", "–"))
    spans = lambda r: r["p"].isin("through", "-", "–") & (r["q"] < value(r["t"])) & (value(r["t"]) <= r["q"] + widest)
    return F.flatten(F.transform(numbers, lambda r: F.when(F.coalesce(spans(r), F.lit(False)), F.sequence(r["q"] + 1, F.greatest(value(r["t"]), r["q"] + 1))).otherwise(F.array(value(r["t"])))))


def title_slug(x, most: int = 44) -> Column:
    """Letters and digits in lower case, everything else one hyphen, of most characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", ""), 1, most)


def candidates_file(x) -> Column:
    """The candidates file that belongs to a coverage file."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^.*/", ""), "^(?:cov|coverage)-", ""), r"\.[^.]*$", "")
    return F.when(stem == "", "candidates.csv").otherwise(F.concat(F.lit("candidates-"), stem, F.lit(".csv")))


def comparison_text(*parts) -> Column:
    """A row's text for comparison: its parts that say something, folded."""
    return fold(F.concat_ws(" ", *parts))


def strict(x) -> Column:
    """Partly is not done."""
    return F.when(x == "partial", "not_addressed").otherwise(x)


# What each closure state says in a cell.
PHRASES = {
    "UNCHANGED": "Not addressed. Text carrying this comment is identical in %2$s",
    "STILL ABSENT": "Not addressed. Absent from both %1$s and %2$s",
    "REMOVED": "Text present in %1$s is absent from %2$s — confirm fix vs regression",
    "ADDED": "Now present in %2$s, absent from %1$s",
    "CHANGED": "Text changed between %1$s and %2$s — review against the comment",
    "TOO BROAD": "Not assessed: search terms match too much of the document",
    "ABSENT": "Not assessed: search terms match nothing in either revision",
    "NO TERMS": "Not assessed: no distinctive search term for this comment",
}


def evidence_cell(state, detail, old_slug: str, new_slug: str, old_lines, new_lines, most: int = 3) -> Column:
    """One cell: the state, then the first lines to look at, of the new revision where it has any; old_lines and new_lines are arrays."""
    said = state
    for k, v in PHRASES.items():
        said = F.when(state == k, F.format_string(v + "%3$s", F.lit(old_slug), F.lit(new_slug), F.lit(""))).otherwise(said)
    here = F.size(new_lines) > 0
    cited, which = F.when(here, new_lines).otherwise(old_lines), F.when(here, F.lit(new_slug)).otherwise(F.lit(old_slug))
    shown = F.array_join(F.transform(F.slice(cited, 1, most), lambda n: F.concat(F.lit("line "), n.cast("string"))), ", ")
    more = F.when(F.size(cited) > most, F.format_string(", +%d more", F.size(cited) - most)).otherwise("")
    where = F.when((F.size(cited) > 0) & (state != "NO TERMS"), F.concat(F.lit(" ("), which, F.lit(": "), shown, more, F.lit(")"))).otherwise("")
    moved = F.when((state == "CHANGED") & (detail != ""), F.concat(F.lit(" ["), detail, F.lit(" lines]"))).otherwise("")
    return F.concat(said, where, F.coalesce(moved, F.lit("")))


def how_many(runs) -> Column:
    """How many lines the runs [(first, last)] come to."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)


def run_text(runs) -> Column:
    """Runs as a reader is told them: 3, 7-9."""
    return F.array_join(F.transform(runs, lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))), ", ")


def where_left_out(runs, most: int = 3) -> Column:
    """The first runs, and how many lines the others come to."""
    rest = how_many(F.slice(runs, most + 1, F.greatest(F.size(runs) - most, F.lit(0))))
    return F.concat(run_text(F.slice(runs, 1, most)), F.when(rest > 0, F.concat(F.lit(", and "), rest.cast("string"), F.lit(" more"))).otherwise(""))


def line_question(runs, what: str) -> Column:
    """What lines in no section leave open; empty where there are none."""
    return F.when(F.size(runs) > 0, F.concat(F.lit(f"a line that is in no section {what}: "), where_left_out(runs, 3))).otherwise("")


def open_question(sections, what: str, most: int = 3) -> Column:
    """What sections that weren't read (heading, locator) leave open, by the first most of their names; empty where there are none."""
    names = F.array_join(F.transform(F.slice(sections, 1, most), lambda s: named_section(s["heading"], s["locator"])), "; ")
    more = F.when(F.size(sections) > most, F.format_string("; and %d more", F.size(sections) - most)).otherwise("")
    return F.when(F.size(sections) > 0, F.concat(F.lit(f"{what}: "), names, more)).otherwise("")


def spelled(place) -> Column:
    """A place (kind, number) as a reader says it: 3.1, Appendix B."""
    return F.when(place["kind"] == "section", place["number"]).otherwise(F.concat(F.initcap(place["kind"]), F.lit(" "), F.upper(place["number"])))


def numbers_sections(name, names) -> Column:
    """Whether headings' numbers (an array) show a document numbering its sections as a pointer does: two that follow each other, or for 3.7 a 3 or another 3.x."""
    tops = F.transform(F.filter(names, lambda n: n.rlike(r"^\d{1,4}$")), lambda n: n.cast("int"))
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    beside = F.exists(names, lambda n: (n == stem) | F.startswith(n, F.concat(stem, F.lit("."))))
    return F.exists(tops, lambda n: F.array_contains(tops, n + 1)) | ((stem != "") & beside)


def named_section(heading, locator) -> Column:
    """A section as a reader can find it."""
    h, at = F.coalesce(one_line(heading), F.lit("")), F.coalesce(one_line(locator), F.lit(""))
    return F.when((h != "") & (at != ""), F.concat(h, F.lit(" ("), at, F.lit(")"))).when(h != "", h).when(at != "", F.concat(F.lit("the section at "), at, F.lit(", which has no heading"))).otherwise("a section without a name")


def in_doubt(*questions) -> Column:
    """Open questions as one line, empty where there is none."""
    return F.concat_ws("; ", *[F.nullif(q, F.lit("")) for q in questions])


def printable(raw) -> Column:
    """Bytes as text: what isn't whole UTF-8, an unpaired surrogate for one, becomes the replacement mark."""
    return F.make_valid_utf8(raw.cast("string"))


def offline_vector(x) -> Column:
    """32 numbers from the SHA-256 of a text, of length 1. The hash and the length are bound, so a text is hashed once and not for each number."""
    bound = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    raw = lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)
    size = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + v * v))
    return bound(F.sha2(x, 256), lambda h: bound(raw(h), lambda r: bound(size(r), lambda n: F.transform(r, lambda v: v / n))))


def cache_key(*parts) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)

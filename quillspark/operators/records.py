"""Filters, orders, matches and statements over review rows (2.E to 2.I, the parts that aren't aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.operators.joins import contains_join, likeness


def of_scope(rows: DataFrame, scope: str) -> DataFrame:
    """The rows of a scope; where there are none, an error that names the scopes seen."""
    found = rows.filter(F.col("scope") == scope)
    if found.isEmpty():
        seen = sorted(r["scope"] or "unscoped" for r in rows.select("scope").distinct().limit(100).collect())
        raise ValueError(f"no rows of scope {scope!r}; seen: {', '.join(seen)}")
    return found


def permissive(modality: Column) -> Column:
    """An obligation that allows and doesn't ask: it isn't judged."""
    return F.upper(F.trim(modality)).startswith("MAY")


def in_values(rows: DataFrame, **wanted: tuple) -> DataFrame:
    """Rows whose columns have one of the named values: in_values(rows, state=("CHANGED",), severity=("D5", "D6"))."""
    for name, values in wanted.items():
        rows = rows.filter(F.col(name).isin(*values))
    return rows


def survivors_of(rows: DataFrame, checked: DataFrame, key: str = "id") -> DataFrame:
    """Rows that verification left standing: confirmed or contested."""
    return rows.join(checked.filter(F.col("status").isin("confirmed", "contested")).select(key).distinct(), key, "left_semi")


def line_flags(lines: DataFrame) -> DataFrame:
    """What a line does: gives a value, discloses a gap, names an owner, calculates, speaks of all."""
    flags = {"assigned": T.ASSIGNED, "disclosed": T.DISCLOSED, "owned": T.OWNED, "mathy": T.MATHY, "universal": T.UNIVERSAL}
    return lines.select("slug", "line_no", *[F.col("text").rlike(p).alias(n) for n, p in flags.items()])


def at_least(rows: DataFrame, keys: list[str], least: int, most: int | None = None) -> DataFrame:
    """Groups of least rows or more, and of most at most; n is their size."""
    sized = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return sized if most is None else sized.filter(F.col("n") <= most)


def limited(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows are to be read; the others stay, as not read."""
    from quillspark.operators.aggregates import ranked

    return ranked(rows, order, "position").withColumn("state", F.when(F.col("position") <= n, "to read").otherwise("not read"))


def substantive(x) -> Column:
    """A heading that names a real part of a document."""
    return F.col(x).rlike(r"(?i)^\d+(\.\d+)?\s+\S|^Appendix\s+[A-Z]\b") if isinstance(x, str) else x.rlike(r"(?i)^\d+(\.\d+)?\s+\S|^Appendix\s+[A-Z]\b")


# Joins (F06, F09, F11, F12, F20, F24, F25, F27, F28)


def with_claims(rows: DataFrame, claims: DataFrame, key: str = "id") -> DataFrame:
    """every row with the register's status and note, and whether the register has it."""
    told = claims.select(key, "status", "note", F.lit(True).alias("_met")).dropDuplicates([key])
    return rows.join(told, key, "left").withColumn("matched", F.coalesce("_met", F.lit(False))).drop("_met")


def corroborating(findings: DataFrame, coverage: DataFrame, shortfall: tuple[str, ...] = ("unmet", "partial")) -> DataFrame:
    """(id, term) with the coverage rows (key, text, verdict) below the top of the scale that have one of its terms, each once."""
    short = coverage.filter(F.lower("verdict").isin(*shortfall))
    return contains_join(short, findings.select("id", "term")).select("id", "key", "verdict").distinct()


def novel(clusters: DataFrame, terms: DataFrame) -> DataFrame:
    """clusters (cluster, text) whose text has no open finding's term."""
    known = contains_join(clusters, terms.select("term").distinct()).select("cluster").distinct()
    return clusters.join(known, "cluster", "left_anti")


def register_hits(findings: DataFrame, rows: DataFrame, least: float = 0.62, digits: int = 6) -> DataFrame:
    """every row (row, embedding) near a finding (id, embedding) by cosine; several rows of one finding are all kept, best first.

    Both sides meet block by block (joins.likeness); neither is broadcast.
    """
    met = likeness(findings.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q")), rows.select(F.col("row").alias("item_id"), F.col("embedding").alias("_v")), least=least, slack=1.1 * 10.0**-digits)
    near = met.select(F.col("query_id").alias("id"), F.col("item_id").alias("row"), F.round("score", digits).alias("score")).filter(F.col("score") >= least)
    return near.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "row")))


#: Claims of one document that are compared at a time.
BLOCK = 512


def object_pairs(claims: DataFrame, least: float = 0.52, most: int = 4, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(slug, id, position, start, embedding of the object): each claim with the most later claims of its document whose objects are
    nearest, least or more, the earlier one on a tie. Claims that start on one line don't pair, and two starts pair once: at their first claim.

    A document's claims meet block by block; a task keeps the most nearest ones of each claim, and only these are ranked.
    """
    import numpy as np
    import pandas as pd

    from quillspark.operators.graph import met_blocks, units

    kinds = {f.name: f.dataType.simpleString() for f in claims.schema}
    met = met_blocks(claims.filter(F.col(vector).isNotNull()).select("slug", "id", "position", "start", vector), "slug", F.xxhash64("position", "id"), block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "id"], kind="stable").reset_index(drop=True)
        unit, starts, mine = units(pdf[vector].tolist()), pdf["start"].to_numpy(), (pdf["_own"] == pdf["_a"]).to_numpy()
        alone = mine.all()
        at = np.arange(len(pdf))
        left, right = [], []
        for i in range(len(pdf)):
            own = np.round(unit[i + 1 :] @ unit[i], 6)
            fits = (own >= least) & (starts[i + 1 :] != starts[i])
            later = at[i + 1 :][fits if alone else fits & (mine[i + 1 :] != mine[i])]
            best = later[np.argsort(-own[later - i - 1], kind="stable")][:most]
            left += [i] * len(best)
            right += [(j, float(own[j - i - 1])) for j in best.tolist()]
        j, score = [x for x, _ in right], [x for _, x in right]
        column = lambda c, k: pd.Series([pdf[c].iloc[x] for x in k], dtype=object)
        told = {f"{c}{n}": column(c, k) for n, k in (("a", left), ("b", j)) for c in ("id", "position", "start")}
        return pd.DataFrame({"slug": column("slug", left), **told, "score": pd.Series(score, dtype=float)})

    schema = ", ".join([f"slug {kinds['slug']}", *[f"{c}{n} {kinds[c]}" for n in "ab" for c in ("id", "position", "start")], "score double"])
    near = met.groupBy("slug", "_a", "_b").applyInPandas(run, schema)
    mine = W.partitionBy("slug", "positiona", "ida").orderBy(F.col("score").desc(), "positionb", "idb")
    kept = near.withColumn("_r", F.row_number().over(mine)).filter(F.col("_r") <= most)
    first = kept.groupBy("slug", F.least("starta", "startb").alias("_s"), F.greatest("starta", "startb").alias("_t")).agg(F.min(F.struct("positiona", "ida", "_r", "idb", "score")).alias("f"))
    return first.select("slug", F.col("f.ida").alias("a"), F.col("f.idb").alias("b"), F.col("f.score").alias("score"))


def joined_retrievers(*sources: DataFrame) -> DataFrame:
    """(query_id, start, end, rank) of several retrievers, each place once, in the order of the sources and of their ranks."""
    every = None
    for n, source in enumerate(sources):
        told = source.select("query_id", "start", "end", "rank", F.lit(n).alias("source"))
        every = told if every is None else every.unionByName(told)
    first = every.groupBy("query_id", "start", "end").agg(F.min(F.struct("source", "rank")).alias("f"))
    order = W.partitionBy("query_id").orderBy("f.source", "f.rank", "start", "end")
    return first.select("query_id", "start", "end", F.col("f.source").alias("source"), F.row_number().over(order).alias("rank"))


def quote_locators(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, quote) with the first of its supplied passages (id, position, chunk_id, text) that has it, folded and without regard to case."""
    folded = passages.select("id", "position", "chunk_id", T.fold_lower(F.col("text")).alias("_p"))
    met = quotes.join(folded, "id").filter((T.fold_lower(F.col("quote")) != "") & F.contains("_p", T.fold_lower(F.col("quote"))))
    first = met.groupBy("id").agg(F.min_by("chunk_id", F.struct("position", "chunk_id")).alias("chunk_id"))
    return quotes.join(first, "id", "left").select("id", "chunk_id")


def requirement_verdicts(obligations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """obligations (id, ref) and their verdicts (id, position, verdict): the worst verdict of each requirement."""
    from quillspark.functions.scale import worst

    return obligations.select("id", "ref").join(verdicts, "id", "left").groupBy("ref").agg(worst(F.col("verdict"), F.col("position")).alias("verdict"))


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either side, and where it is."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_b").isNull(), "only a").when(F.col("_a").isNull(), "only b").otherwise("both")
    return left.join(right, key, "full_outer").select(key, where.alias("where"))


def lost(old: DataFrame, new: DataFrame, key: str = "identifier") -> DataFrame:
    """Identifiers of the old revision that the new one hasn't, with how often they were used."""
    return old.groupBy(key).agg(F.count("*").alias("uses")).join(new.select(key).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Distinct values at the place where each comes first."""
    return rows.groupBy(*keys).agg(F.min(position).alias(position))


# Orders (H04 to H08, H12, H17)


def finding_order(x: str = "id") -> list[Column]:
    """Class, first letter, number: D2 before D10."""
    number = F.coalesce(F.nullif(F.regexp_replace(x, r"\D", ""), F.lit("")).cast("long"), F.lit(0))
    return [F.col("class"), F.substring(x, 1, 1), number]


def reading_rank(x: Column, scale) -> Column:
    """Worst first, what couldn't be checked before the best, what doesn't apply last."""
    order = [*scale.values[:-1], scale.off[0], scale.values[-1], *scale.off[1:]]
    out = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(order):
        out = out.when(x == v, F.lit(i))
    return out.otherwise(F.lit(9))


def bundled(coverage: DataFrame, terms: DataFrame, clusters: DataFrame, scale, most_terms: int = 40) -> DataFrame:
    """Clusters by strength, coverage rows by verdict, then the most used terms: (class, id, status, statement, place).

    coverage: (id, verdict, text). terms: (term, uses, position). clusters: (rank, strength, members, text).
    """
    from quillspark.operators.aggregates import ranked

    a = clusters.select(F.lit(-1).alias("k1"), (-F.col("strength")).alias("k2"), F.concat(F.lit("cluster-"), F.col("rank").cast("string")).alias("id"), F.lit("convergent cluster").alias("class"), F.concat(F.col("members").cast("string"), F.lit(" obligations, strength "), F.round("strength", 2).cast("string")).alias("status"), F.col("text").alias("statement"))
    b = coverage.select(reading_rank(F.col("verdict"), scale).alias("k1"), F.lit(0.0).alias("k2"), F.col("id").cast("string").alias("id"), F.lit("coverage").alias("class"), F.col("verdict").alias("status"), F.col("text").alias("statement"))
    kept = ranked(terms, [F.col("uses").desc(), F.col("position")], "_r").filter(F.col("_r") <= most_terms)
    c = kept.select(F.lit(4).alias("k1"), (-F.col("uses")).cast("double").alias("k2"), F.lit("").alias("id"), F.lit("undefined term").alias("class"), F.concat(F.lit("used "), F.col("uses").cast("string"), F.lit("x")).alias("status"), F.col("term").alias("statement"))
    every = a.unionByName(b).unionByName(c)
    return ranked(every, [F.col("k1"), F.col("k2"), F.col("class"), F.col("id"), F.col("statement")], "place").select("place", "class", "id", "status", "statement")


def move_order(moves: DataFrame) -> DataFrame:
    """What moved farthest first, then by key."""
    from quillspark.operators.aggregates import ranked

    return ranked(moves.filter("change = 'moved'"), [F.col("distance").desc(), F.col("obligation")], "place")


def conflict_order(pairs: DataFrame, key: str = "id") -> DataFrame:
    """Rows that a human should read first, by how the judges differ."""
    from quillspark.operators.aggregates import ranked

    rank = F.array_position(F.array(*[F.lit(x) for x in ("DISAGREE", "UNRANKABLE", "ONE JUDGE ONLY", "ADJACENT")]), F.col("agreement"))
    told = pairs.withColumn("_o", rank).filter("_o > 0")
    return ranked(told, [F.col("_o"), F.col(key)], "place").drop("_o")


def neighbours(rows: DataFrame, key: str = "slug", order: str = "line_no", value: str = "text") -> DataFrame:
    """Each row with the value before and after it."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def reranked(ranking: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The first depth items of each query (query_id, item_id, rank) by a second score, where there is one; the others keep their order behind them."""
    both = ranking.join(scores.select("query_id", "item_id", F.col("score").alias("_s")), ["query_id", "item_id"], "left")
    head = (F.col("rank") <= depth) & F.col("_s").isNotNull()
    order = W.partitionBy("query_id").orderBy((F.col("rank") > depth).cast("int"), F.when(head, -F.col("_s")).otherwise(F.lit(float("inf"))), "rank")
    return both.select("query_id", "item_id", F.row_number().over(order).alias("rank"))


# Statements and counts


def found_by_class(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, class) and hits (id, row): found, total and share of each class."""
    hit = hits.select("id").distinct().withColumn("_h", F.lit(1))
    each = findings.join(hit, "id", "left").groupBy("class").agg(F.count("_h").alias("found"), F.count("*").alias("total"))
    return each.withColumn("share", F.col("found") / F.col("total"))


def corroborated_share(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """How many of the flagged rows (row) support a finding."""
    return rows.select("row").distinct().join(hits.select("row").distinct().withColumn("_h", F.lit(1)), "row", "left").agg(F.count("_h").alias("supporting"), F.count("*").alias("flagged"))


def paired_rates(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(id, verdict, target) against (run, id, verdict): hits among the target class and among failures, and overall; partial counts as not addressed."""
    strict = lambda c: F.when(F.col(c) == "partial", "not_addressed").otherwise(F.col(c))
    both = got.select("run", "id", strict("verdict").alias("said")).join(truth.select("id", F.col("verdict").alias("true"), "target"), "id")
    fail = F.col("true") == "not_addressed"
    return both.groupBy("run").agg(
        F.count_if(F.col("target") & (F.col("said") == "addressed")).alias("target_hits"), F.count_if("target").alias("targets"),
        F.count_if(fail & (F.col("said") == "not_addressed")).alias("failure_hits"), F.count_if(fail).alias("failures"),
        F.count_if(F.col("said") == F.col("true")).alias("right"), F.count("*").alias("covered"),
    )


def answers(sections: DataFrame, runs: int) -> DataFrame:
    """Sections (slug, position, heading, locator, passes, why) that were asked runs times: of, answered, what wasn't read and what is short.

    why: the reason that a section was never asked, null where it was.
    """
    passes = F.coalesce("passes", F.lit(0))
    missing = F.when(F.col("why").isNotNull() | (passes == 0), F.struct("position", "heading", "locator", F.coalesce(F.col("why"), F.lit("extraction failed")).alias("why")))
    short = F.when(F.col("why").isNull() & (passes > 0) & (passes < runs), F.struct("position", "heading", "locator", passes.alias("passes")))
    each = sections.groupBy("slug").agg(
        F.count("*").alias("of"), F.count_if(F.col("why").isNull() & (passes > 0)).alias("answered"), F.lit(runs).alias("runs"),
        F.sort_array(F.collect_list(missing)).alias("not_read"), F.sort_array(F.collect_list(short)).alias("short"),
    )
    return each


def reading_statement(read: DataFrame, most: int = 12) -> DataFrame:
    """Of answers(): one line of how much was read, and the first most sections that weren't, with how many more."""
    n, of = F.size("not_read"), F.col("of")
    said = (
        F.when(of == 0, "nothing was read: no line of the document holds text").when(F.col("answered") == 0, F.format_string("nothing was read: 0 of %d sections answered", of))
        .when(n > 0, F.format_string("%d of %d sections not read", n, of)).otherwise(F.format_string("all %d sections read", of))
    )
    place = F.transform(F.slice("not_read", 1, most), lambda x: F.concat(F.coalesce(x["heading"], F.lit("no heading")), F.lit(" ("), x["locator"], F.lit(") ["), x["why"], F.lit("]")))
    return read.select("slug", said.alias("statement"), place.alias("listed"), F.greatest(n - most, F.lit(0)).alias("more"), F.size("short").alias("short"))


def terms_note(read: DataFrame) -> DataFrame:
    """What qualifies a bundle: its terms don't come from every section, from none, or it isn't known; empty where all were read. of and answered may be null."""
    said = (
        F.when(F.col("of").isNull(), "NOT KNOWN: the file does not say how many sections were asked")
        .when(F.col("answered") == 0, F.format_string("NOTHING WAS READ: 0 of %d sections", F.col("of")))
        .when(F.col("answered") < F.col("of"), F.format_string("NOT THE WHOLE DOCUMENT: %d of %d sections", F.col("answered"), F.col("of"))).otherwise("")
    )
    return read.select("slug", said.alias("note"))


def rests_on(index: DataFrame) -> DataFrame:
    """(slug, of, answered, short, pairs, unjudged), each null where the index doesn't say: what a claim score doesn't rest on."""
    gaps = F.array_compact(
        F.array(
            F.when(F.col("of").isNull(), "sections not recorded").when(F.col("answered") == 0, "nothing was read").when(F.col("answered") < F.col("of"), F.format_string("%d of %d sections not read", F.col("of") - F.col("answered"), F.col("of"))),
            F.when(F.col("short") > 0, F.format_string("%d sections with fewer passes", F.col("short"))),
            F.when(F.col("unjudged").isNull(), "pairs not recorded").when(F.col("unjudged") > 0, F.format_string("%d of %d pairs not judged", F.col("unjudged"), F.col("pairs"))),
        )
    )
    return index.select("slug", gaps.alias("gaps"), (F.size(gaps) == 0).alias("whole"))


def reuse_ratio(timed: DataFrame, *keys: str) -> DataFrame:
    """(position, seconds): the first call against the upper median of the others."""
    from quillspark.operators.cells import upper_median

    first = timed.groupBy(*keys).agg(F.min_by("seconds", "position").alias("first"), F.min("position").alias("_p"))
    rest = upper_median(timed.join(first.select(*keys, "_p"), list(keys)).filter(F.col("position") > F.col("_p")), "seconds", *keys)
    return first.drop("_p").join(rest, list(keys), "left").withColumn("ratio", F.when(F.col("median") > 0, F.col("first") / F.col("median")))


def planted_notes(obligations: DataFrame, planted: DataFrame) -> DataFrame:
    """(id, ref) with the note of the first planted item (grp, position, ref, note) behind its requirement."""
    first = planted.groupBy("ref").agg(F.min_by("note", F.struct("grp", "position")).alias("note"))
    return obligations.join(first, "ref", "left").select("id", "ref", "note")


# Shapes of inventory items and replies


def line_numbers_ok(json: Column) -> Column:
    """A list of whole numbers above 0 and nothing else."""
    return F.coalesce(json.rlike(r"^\s*\[\s*(?:[1-9]\d*(?:\s*,\s*[1-9]\d*)*)?\s*\]\s*$"), F.lit(False))


def passes_asked(json: Column) -> Column:
    """The positive whole number under runs, else null."""
    said = F.get_json_object(json, "$.runs")
    return F.when(said.rlike(r"^[1-9]\d{0,8}$") & ~json.rlike(r'"runs"\s*:\s*"'), said.cast("int"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def item_fault(json: Column, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Why an item isn't an object with text under each needed key, and text or nothing under each optional one; empty where it is."""
    v = F.try_parse_json(json)
    out = F.when(v.isNull() | ~_kind(v).startswith("OBJECT"), F.lit("is not a mapping"))
    for k in (*needed, *optional):
        held = F.try_variant_get(v, f"$.{k}", "variant")
        if k in needed:
            out = out.when(held.isNull(), F.lit(f"has no '{k}'"))
            out = out.when(_kind(held) != "STRING", F.lit(f"has no text for its '{k}'")).when(F.trim(F.try_variant_get(v, f"$.{k}", "string")) == "", F.lit(f"has nothing in its '{k}'"))
        else:
            out = out.when(held.isNotNull() & ~_kind(held).isin("STRING", "VOID", "ARRAY<VOID>", "OBJECT<>"), F.lit(f"has no text for its '{k}'"))
    return out.otherwise(F.lit(""))


def pointer_text(json: Column) -> Column:
    """A pointer as text; a list of texts is joined by ' and '."""
    many = F.from_json(json, "array<string>")
    return F.when(json.rlike(r"^\s*\["), F.array_join(many, " and ")).otherwise(F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x"))


def terms_of(files: DataFrame) -> DataFrame:
    """Terms files (slug, json), a bare list of terms or an object of them: slug, kind, terms and how many sections answered. Anything else is refused, in its kind."""
    item = "array<struct<term: string, uses: int>>"
    listed, held = F.from_json("json", item), F.from_json("json", f"struct<terms: {item}, sections: struct<of: int, answered: int>>")
    bare = F.col("json").rlike(r"^\s*\[")
    kind = F.when(bare & listed.isNotNull(), "list").when(~bare & held["terms"].isNotNull(), "object").otherwise("refused")
    return files.select("slug", kind.alias("kind"), F.when(bare, listed).otherwise(held["terms"]).alias("terms"), F.when(~bare, held["sections"]["of"]).alias("of"), F.when(~bare, held["sections"]["answered"]).alias("answered"))


def parsed_reply(raw: Column, scale) -> Column:
    """Verdict, rationale, cites and whether JSON failed; a broken reply is read by its parts, an unknown verdict is the scale's unknown."""
    whole = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(whole, "verdict string, rationale string, cites array<string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = (whole != "") & parsed["_bad"].isNull()
    verdict = F.when(good, parsed["verdict"]).otherwise(F.regexp_extract(raw, r'"verdict"\s*:\s*"(\w+)"', 1))
    said = F.regexp_extract(raw, r'(?s)"rationale"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    broken = F.substring(F.when(said != "", said).otherwise(raw), 1, 1500)
    return F.struct(
        scale.coerce(F.coalesce(verdict, F.lit(""))).alias("verdict"), F.trim(F.coalesce(F.when(good, F.coalesce(parsed["rationale"], F.lit(""))).otherwise(broken), F.lit(""))).alias("rationale"),
        F.when(good, F.coalesce(parsed["cites"], F.array().cast("array<string>"))).otherwise(F.regexp_extract_all(raw, F.lit(r'"(\d+\s*-\s*\d+)"'), F.lit(1))).alias("cites"), (~good).alias("unparsed"),
    )


def answers_ok(json: Column) -> Column:
    """A record of answers(): whole numbers of 0 or more under of, answered and runs, lists of objects under not_read and short, and the counts add up."""
    whole = lambda k: F.coalesce(F.get_json_object(json, f"$.{k}").rlike(r"^\d{1,9}$") & ~json.rlike(rf'"{k}"\s*:\s*"'), F.lit(False))
    number = lambda k: F.get_json_object(json, f"$.{k}").cast("int")
    objects = lambda k: F.coalesce(F.get_json_object(json, f"$.{k}").rlike(r"^\s*\[\s*(\{|\])"), F.lit(False))
    missing = F.coalesce(F.json_array_length(F.get_json_object(json, "$.not_read")), F.lit(-1))
    return whole("of") & whole("answered") & whole("runs") & objects("not_read") & objects("short") & F.coalesce(number("answered") + missing == number("of"), F.lit(False))


def empty_place(x: Column) -> Column:
    """No item at all: null, or text with nothing in it."""
    return x.isNull() | (F.regexp_replace(x, r"(?U)\s", "") == "")


def fully_read(full_passes: Column, *unasked: Column) -> Column:
    """Whether a pass read a section with the whole schema: it says so, or, where it doesn't say, a list that only such a pass asks for holds something."""
    held = F.lit(False)
    for x in unasked:
        held = held | (F.coalesce(F.size(x), F.lit(0)) > 0)
    return F.coalesce(full_passes > 0, held)


def add_document(corpus: DataFrame, slug: str, path: str, role: str = "reference") -> DataFrame:
    """A corpus with one document more; a slug that it has already is refused."""
    if not corpus.filter(F.col("slug") == slug).isEmpty():
        raise ValueError(f"the corpus has a document {slug!r}")
    new = corpus.sparkSession.createDataFrame([(slug, path, role)], "slug string, path string, role string")
    return corpus.unionByName(new, allowMissingColumns=True)

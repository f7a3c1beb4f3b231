"""Rows of a matrix judged by what changed in the sections that they name (O11, K17): references followed, equal sections settled without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph, lines, pointers, synthesis
from quillspark.operators.durable import written
from quillspark.provider import ModelProvider, ask_all

JUDGE = "Judge whether the change settles the comment. Reply with JSON: verdict (addressed, partial, not_addressed, unclear), rationale, quote."
REPLY = "struct<verdict: string, rationale: string, quote: string>"
VERDICTS = ("addressed", "partial", "not_addressed", "unclear")


def section_texts(own: DataFrame, spans: DataFrame, width: int = 256) -> DataFrame:
    """line_no, end and body, the texts of the lines (line_no, text) behind a heading to its end, of sections (line_no, end) in order. Lines and sections meet in
    pieces of width lines."""
    each = spans.select("line_no", "end").distinct()
    cut = each.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line_no") / width), F.floor(F.greatest("line_no", "end") / width))))
    placed = own.select(F.col("line_no").alias("_l"), "text", F.floor(F.col("line_no") / width).alias("_b"))
    met = cut.join(placed, "_b").filter((F.col("_l") > F.col("line_no")) & (F.col("_l") <= F.col("end")))
    texts = met.groupBy("line_no", "end").agg(F.transform(F.sort_array(F.collect_list(F.struct("_l", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("body"))
    return each.join(texts, ["line_no", "end"], "left").select("line_no", "end", F.coalesce("body", F.array().cast("array<string>")).alias("body"))


def section_pairs(refs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Ref, before, now and moved of every section that is named (ref) by the old revision's numbers, once: before and now are its lines in both
    revisions (line_no, text), now null where its title is gone, and moved the number that it has now where that is another one.

    A title is followed, not its number, which may belong to another section by now.
    """
    tag = lambda df: df.select(F.lit(0).alias("slug"), "line_no", "text")
    h0, h1 = (written(lines.headings(tag(x)).select("number", "title", "line_no", "end"), "headings") for x in (old, new))
    numbers = refs.select(F.col("ref").alias("id"), F.col("ref").alias("number")).distinct()
    first = synthesis.pick_sections(numbers, h0).select(F.col("id").alias("ref"), F.col("number").alias("old_number"), T.bare_title(F.col("title")).alias("key"), F.col("line_no").alias("l0"), F.col("end").alias("e0"))
    where = synthesis.follow_sections(h0, h1).filter("new_number IS NOT NULL").select("old_number", "key", "new_number")
    there = synthesis.pick_sections(where.select(F.col("new_number").alias("id"), F.col("new_number").alias("number")).distinct(), h1).filter("how = 'exact'").select(F.col("id").alias("new_number"), F.col("line_no").alias("l1"), F.col("end").alias("e1"))
    both = written(first.join(where, ["old_number", "key"], "left").join(there, "new_number", "left"), "sections")
    name = lambda df, n: df.select(F.col("line_no").alias(f"l{n}"), F.col("end").alias(f"e{n}"), F.col("body").alias(f"b{n}"))
    t0 = name(section_texts(old, both.select(F.col("l0").alias("line_no"), F.col("e0").alias("end"))), 0)
    t1 = name(section_texts(new, both.filter("l1 IS NOT NULL").select(F.col("l1").alias("line_no"), F.col("e1").alias("end"))), 1)
    told = both.join(t0, ["l0", "e0"]).join(t1, ["l1", "e1"], "left")
    moved = F.when(F.col("new_number") != F.col("old_number"), F.col("new_number"))
    return told.select("ref", F.col("b0").alias("before"), F.when(F.col("l1").isNotNull(), F.col("b1")).alias("now"), moved.alias("moved"))


def followed(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Id, ref, before, now and moved of section_pairs() for every section that a row (id, refs) names."""
    wanted = rows.select("id", F.explode(F.array_distinct("refs")).alias("ref"))
    return wanted.join(section_pairs(wanted.select("ref"), old, new), "ref", "left").select("id", "ref", "before", "now", "moved")


def adjudicate(rows: DataFrame, old: DataFrame, new: DataFrame, provider: ModelProvider, most: int = 12_000, **options) -> DataFrame:
    """Id, verdict, rationale, quote and basis of matrix rows (id, section, comment) over two revisions (line_no, text) of a document.

    A row whose sections are the same to the byte is not addressed (UNCHANGED), and no model is asked. Others are judged by the diff of their
    sections (DIFF), and where that leaves it unclear by the whole sections as they are now (ESCALATED). Rows that name no section, and those
    whose sections can't be found any more, are judged by the diff of the document (WIDE, WIDE+UNLOCATABLE). What goes into a prompt is most
    characters at most, and says so. A row without a comment is SKIPPED, a failed call is unclear (ERROR).

    A section is compared and diffed once, whatever the number of rows that name it, and a comment on one list of sections is asked of once: rows
    meet the answers, never the texts.
    """
    told = rows.select("id", "comment", pointers.section_signs(F.col("section")).alias("refs"))
    told = told.withColumn("at", F.array_join("refs", " "))  # numbers have no space
    asked = told.filter(F.trim(F.coalesce("comment", F.lit(""))) != "")
    lists = written(asked.filter(F.size("refs") > 0).select("at", "refs").distinct(), "lists").select("at", F.explode(F.array_distinct("refs")).alias("ref"))
    pairs = written(section_pairs(lists.select("ref"), old, new).filter("now IS NOT NULL").withColumn("same", F.col("before") == F.col("now")), "sections")
    # a piece's characters past those that a prompt holds change neither its beginning nor that it is cut
    piece = lambda c: F.substring(c, 1, most + 1)
    diff = graph.diffs(pairs.filter("NOT same").select(F.col("ref").alias("id"), F.col("before").alias("old"), F.col("now").alias("new"))).select(F.col("id").alias("ref"), piece(F.col("diff")).alias("diff"))
    pieces = pairs.select("ref", "moved", "same", piece(F.array_join("now", "\n")).alias("now")).join(diff, "ref", "left").withColumn("diff", F.coalesce("diff", F.lit("")))
    pieces = written(pieces, "pieces")
    cut = lambda c: F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n[cut]"))).otherwise(c)
    joined = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "\n\n")
    where = F.array_join(F.transform("p", lambda x: F.concat(F.lit("§"), x["ref"], F.coalesce(F.concat(F.lit(" is now §"), x["moved"]), F.lit("")))), ", ")
    shown = lists.join(pieces, "ref").groupBy("at").agg(F.every("same").alias("same"), F.sort_array(F.collect_list(F.struct("ref", "moved", "diff", "now"))).alias("p"))
    shown = written(shown.select("at", "same", where.alias("where"), cut(F.concat(F.lit("WHAT CHANGED\n"), joined("diff"))).alias("by_diff"), cut(F.concat(F.lit("THE SECTIONS AS THEY STAND NOW\n"), joined("now"))).alias("whole")), "shown")
    each = written(asked.join(shown.select("at", "same", "where"), "at", "left"), "rows")
    equal = each.filter("same").select("id", F.lit("not_addressed").alias("verdict"), F.concat(F.lit("nothing has changed in "), "where").alias("rationale"), F.lit("").alias("quote"), F.lit("UNCHANGED").alias("basis"))

    def judged(of: DataFrame, basis: str) -> DataFrame:
        """of: (at, comment, shown), each once."""
        one = F.struct("at", "comment")
        prompts = of.select(one.alias("id"), F.lit(JUDGE).alias("system"), F.concat(F.lit("COMMENT\n"), "comment", F.lit("\n\n"), "shown").alias("user"))
        got = ask_all(prompts, provider, **options).select("id.at", "id.comment", F.from_json("answer", REPLY).alias("r"), F.col("error").alias("call"))
        fine = F.coalesce(F.col("r.verdict").isin(*VERDICTS), F.lit(False))
        return got.select(
            "at", "comment", F.when(fine, F.col("r.verdict")).otherwise("unclear").alias("verdict"), F.when(fine, F.coalesce("r.rationale", F.lit(""))).otherwise(F.coalesce(F.concat(F.lit("the call failed: "), "call"), F.lit("the reply could not be read"))).alias("rationale"),
            F.when(fine, F.coalesce("r.quote", F.lit(""))).otherwise("").alias("quote"), F.when(fine, F.lit(basis)).otherwise("ERROR").alias("basis"),
        )

    changed = each.filter("NOT same").select("id", "at", "comment")
    by_diff = written(judged(changed.select("at", "comment").distinct().join(shown.select("at", F.col("by_diff").alias("shown")), "at"), "DIFF"), "by-diff")
    open_ = by_diff.filter("verdict = 'unclear' AND basis = 'DIFF'").select("at", "comment")
    again = written(judged(open_.join(shown.select("at", F.col("whole").alias("shown")), "at"), "ESCALATED").filter("basis = 'ESCALATED'"), "escalated")
    settled = written(by_diff.join(again.select("at", "comment"), ["at", "comment"], "left_anti").unionByName(again), "settled")
    settled = changed.join(settled, ["at", "comment"]).select(*equal.columns)
    # the document's one diff stands for rows that can't be placed
    side = lambda df, n: df.select("line_no", "text", F.lit(n).alias("side"))
    of = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("line_no", "text")))), lambda x: x["text"])
    whole = side(old, 0).unionByName(side(new, 1)).groupBy(F.lit(0).alias("id")).agg(of(0).alias("old"), of(1).alias("new"))
    all_of = graph.diffs(whole).select(cut(F.concat(F.lit("WHAT CHANGED IN THE DOCUMENT\n"), piece(F.col("diff")))).alias("shown"))
    wide = each.filter("same IS NULL").select("id", "comment", F.when(F.size("refs") > 0, "WIDE+UNLOCATABLE").otherwise("WIDE").alias("b"))
    by_all = written(judged(wide.select(F.lit("").alias("at"), "comment").distinct().join(F.broadcast(all_of)), "WIDE").drop("at"), "by-all")
    by_all = wide.join(by_all, "comment").withColumn("basis", F.when(F.col("basis") == "WIDE", F.col("b")).otherwise(F.col("basis"))).select(*equal.columns)
    skipped = told.join(asked.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("verdict"), F.lit("no comment text").alias("rationale"), F.lit("").alias("quote"), F.lit("SKIPPED").alias("basis"))
    return equal.unionByName(settled).unionByName(by_all).unionByName(skipped)

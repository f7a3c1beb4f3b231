"""Candidates under attack, and terms from nomination to report (O11, N07, N08, N11): compositions over retrieval, questions and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import aggregates, lines, synthesis
from quillspark.operators.durable import written
from quillspark.plans.review import retrieved
from quillspark.provider import ModelProvider, ask_all

#: Three ways to attack a finding; the first two ask whether it is true, the third whether it is worth raising.
LENSES = {
    "search": "Search the passages for text that discharges the obligation completely. Reply with JSON: refuted, evidence (verbatim), gap_addressed, reason.",
    "rebuttal": "You wrote the document. Rebut the finding with evidence from the passages. Reply with JSON: refuted, evidence (verbatim), gap_addressed, reason.",
    "materiality": "Is the finding immaterial: a matter of wording, a repetition, nothing that changes a decision? Reply with JSON: refuted, evidence, reason.",
}
REPLY = "struct<refuted: boolean, evidence: string, gap_addressed: string, reason: string>"


def fault(lens: Column, reply: Column, passages: Column) -> Column:
    """What is wrong with a lens's reply, or null. What refutes the truth of a finding is a verbatim quote of content; what calls it immaterial is an argument."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    claims = (lens != "materiality") & reply["refuted"]
    return (
        F.when(reply["refuted"].isNull(), "refuted must be true or false").when(blank(reply["reason"]), "reason must not be empty")
        .when(claims & blank(reply["evidence"]), "a refutation must quote the evidence")
        .when(claims & ~F.contains(T.fold_lower(passages), T.fold_lower(reply["evidence"])), "evidence must be copied verbatim from the passages")
        .when(claims & T.points_elsewhere(reply["evidence"]), "a cross-reference is no evidence")
        .when(claims & blank(reply["gap_addressed"]), "gap_addressed must restate the gap")
    )


def supplied(asked: DataFrame, chunks: DataFrame, k: int = 12, embed: Callable[[Column], Column] = T.offline_vector) -> DataFrame:
    """id and passages: the k nearest passages of each question (id, text), then those of k // 2 by shared terms that aren't among them."""
    first = retrieved(asked, chunks, "dense", k, embed=embed).withColumn("source", F.lit(0))
    second = retrieved(asked, chunks, "lexical", max(1, k // 2)).withColumn("source", F.lit(1))
    both = first.unionByName(second).groupBy("query_id", "chunk_id").agg(F.min(F.struct("source", "rank")).alias("at"))
    shown = both.join(chunks.select("chunk_id", F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("]\n"), "text").alias("p")), "chunk_id")
    order = F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk_id", "p"))), lambda x: x["p"])
    return shown.groupBy(F.col("query_id").alias("id")).agg(F.array_join(order, "\n\n").alias("passages"))


def verify(candidates: DataFrame, chunks: DataFrame, provider: ModelProvider, k: int = 12, embed: Callable[[Column], Column] = T.offline_vector, **options) -> DataFrame:
    """Findings (id, requirement, verdict, reason) attacked through three lenses over their passages (chunk_id, text): id, status, refutations, universal,
    lens_failures, immaterial, search_evidence, rebuttal and materiality.

    A faulty reply is asked for once more with the fault named; one that stays faulty, or a call that fails, is a failed lens and never
    reads as "did not refute": the finding is contested then. Both truth lenses refute a finding together, but none that says every.
    Every finding is kept. Options go to ask_all().
    """
    asked = candidates.select("id", F.col("requirement").alias("text"))
    told = candidates.join(supplied(asked, chunks, k, embed), "id", "left").withColumn("passages", F.coalesce("passages", F.lit("")))
    lens = F.explode(F.array(*[F.struct(F.lit(n).alias("lens"), F.lit(s).alias("system")) for n, s in LENSES.items()])).alias("l")
    body = F.concat_ws("\n\n", F.concat(F.lit("OBLIGATION\n"), "requirement"), F.concat(F.lit("FINDING "), "verdict", F.lit("\n"), F.coalesce("reason", F.lit(""))), F.concat(F.lit("PASSAGES\n"), "passages"))
    prompts = written(told.select("*", lens).select("id", "requirement", "passages", "l.lens", "l.system", body.alias("user")), "prompts")

    def answers(of: DataFrame) -> DataFrame:
        said = ask_all(of.select(F.struct("id", "lens").alias("id"), "system", "user"), provider, **options)
        got = said.select("id.id", "id.lens", F.from_json("answer", REPLY).alias("reply"), F.col("error").alias("call"))
        return of.join(got, ["id", "lens"]).withColumn("fault", F.coalesce("call", fault(F.col("lens"), F.col("reply"), F.col("passages"))))

    once = written(answers(prompts), "answers")
    again = once.filter("fault IS NOT NULL AND call IS NULL").select("id", "requirement", "passages", "lens", "system", F.concat("user", F.lit("\n\nThe last answer was refused: "), "fault").alias("user"))
    twice = written(answers(again), "answers")
    settled = once.join(again.select("id", "lens"), ["id", "lens"], "left_anti").unionByName(twice)
    bad = F.col("fault").isNotNull()
    each = written(settled.select("id", "requirement", "lens", bad.alias("failed"), (~bad & F.coalesce("reply.refuted", F.lit(False))).alias("refuted"), "reply.evidence", "reply.reason"), "lenses")
    votes = aggregates.verification(each.select("id", "requirement", "lens", "refuted", "failed"))
    of = lambda name, value: F.max(F.when(F.col("lens") == name, value))
    truth = F.col("lens").isin("search", "rebuttal")
    seen = each.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(truth & F.col("failed"), F.col("lens")))), ",").alias("lens_failures"), of("materiality", F.col("refuted")).alias("immaterial"),
        of("search", F.col("evidence")).alias("search_evidence"), of("rebuttal", F.col("reason")).alias("rebuttal"), of("materiality", F.col("reason")).alias("materiality"),
    )
    return votes.join(seen, "id").select("id", "status", "refutations", "universal", "lens_failures", "immaterial", "search_evidence", "rebuttal", "materiality")


TERMS = "Name terms that this section uses without explaining them. Reply with JSON: terms, a list of term and quote."
NOMINATIONS = "struct<terms: array<struct<term: string, quote: string>>>"


def nominate(docs: DataFrame, provider: ModelProvider, rule: lines.Cut = lines.SECTIONS, **options) -> tuple[DataFrame, DataFrame]:
    """Terms that sections of documents (slug, text) nominate: slug, start, term, quote; and slug, of and answered of the sections that were asked.

    A section that didn't answer isn't one without terms: the second table says how many did."""
    sections = lines.cut_documents(docs, rule).select("slug", "start", "heading", "text")
    prompts = sections.select(F.struct("slug", "start").alias("id"), F.lit(TERMS).alias("system"), F.concat_ws("\n\n", "heading", "text").alias("user"))
    said = written(ask_all(prompts, provider, **options).select("id.slug", "id.start", F.from_json("answer", NOMINATIONS).alias("r")), "nominations")
    read = said.groupBy("slug").agg(F.count("*").alias("of"), F.count("r.terms").alias("answered"))
    return said.select("slug", "start", F.inline("r.terms")).select("slug", "start", F.trim("term").alias("term"), F.trim("quote").alias("quote")).filter("term <> ''"), read


def undefined_terms(docs: DataFrame, nominations: DataFrame, least: int = 2) -> DataFrame:
    """Slug, term, uses, quote and start of nominated terms (slug, start, term, quote) that a document (slug, text) uses least times or more and never defines.

    The document decides: a nomination without a quote that stands in it is dropped, and whatever explains the term anywhere clears it.
    Of several nominations of one term, written alike but for case, the one with most uses stays, the first of these.
    """
    asked = nominations.select("slug", "start", "term", "quote", F.lower("term").alias("low"), T.fold_lower(F.col("quote")).alias("_q")).filter("_q <> ''").distinct()
    asked = asked.groupBy("slug").agg(F.collect_list(F.struct("start", "term", "quote", "low", "_q")).alias("asked"))
    # a document's text meets the list of its nominations, so it is dealt and folded once; only numbers leave the row
    text = docs.select("slug", "text").join(asked, "slug").select("slug", "asked", F.inline(F.array(F.struct(F.lower("text").alias("_low"), T.fold_lower(F.col("text")).alias("_folded")))))
    held = F.filter("asked", lambda a: F.contains("_folded", a["_q"]))
    told = F.transform(held, lambda a: F.struct(*[a[c].alias(c) for c in ("start", "term", "quote", "low")], T.occurrences(F.col("_low"), a["low"]).alias("uses")))
    used = text.select("slug", F.inline(F.array(F.struct(told.alias("told"))))).select("slug", F.inline("told"))
    used = written(used.filter(F.col("uses") >= least), "used")
    left = synthesis.definitions(used.select("slug", "term").distinct(), lines.to_lines(docs)).filter("defined IS NULL").select("slug", "term")
    best = used.join(left, ["slug", "term"]).groupBy("slug", "low").agg(F.max_by(F.struct("term", "uses", "quote", "start"), F.struct("uses", -F.col("start"), "term")).alias("b"))
    return best.select("slug", "b.*")

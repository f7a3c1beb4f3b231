"""The report over a register, and the way from register to matrix and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import aggregates, closure, joins, records
from quillspark.sources import files


def report(findings: DataFrame, lexicon: DataFrame, old: DataFrame, new: DataFrame, claims: DataFrame, coverage: DataFrame, synthesis: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """The review's five sections as tables, in this order.

    findings: (id, class, title, absence, term). old, new: (line_no, text). claims: (id, status, note). coverage: (key, text, verdict).
    synthesis: (key, text). clusters: (cluster, rank, strength, text). disputed: a claim that the text doesn't show, or a change that
    nobody claims. open: findings that the text still has. converging: findings by how many ways reach them. corroborated: open
    findings with coverage rows below met. novel: clusters that touch no finding.
    """
    rows = findings.select("id", "class", "title", "absence").distinct()
    terms = joins.expand_terms(findings.select("id", "term"), lexicon)
    states = closure.closure(rows.select("id", "absence"), terms, old, new)
    told = records.with_claims(rows.select("id", "class", "title").join(states, "id"), claims)
    verdict = T.adjudication(F.col("state"), F.col("status"))
    disputed = told.withColumn("check", F.when(F.col("matched"), verdict)).filter("check IS NOT NULL")
    opened = told.filter(F.col("state").isin("UNCHANGED", "STILL ABSENT"))
    met = records.corroborating(terms, coverage)
    order = lambda df: aggregates.ranked(df, [*records.finding_order(), F.col("id").cast("string")], "place")
    both = aggregates.convergence(terms.join(rows.select("id", "class"), "id"), coverage.select("key", "text"), synthesis)
    reached = aggregates.ranked(both, [F.col("score").desc(), F.col("class"), F.col("id")], "place")
    backed = opened.join(met.groupBy("id").agg(F.count("*").alias("rows")), "id")
    return {
        "disputed": order(disputed.select("id", "class", "title", "state", "status", "check")), "open": order(opened.select("id", "class", "title", "state", "detail")),
        "converging": reached.select("place", "id", "class", "score"), "corroborated": order(backed.select("id", "class", "title", "rows")),
        "novel": records.novel(clusters, terms).select("cluster", "rank", "strength"),
    }


def matrix(register: DataFrame, states: DataFrame, id_column: str, old_slug: str, new_slug: str, lines: DataFrame) -> DataFrame:
    """Register rows (_row, id_column) with the evidence cell (J35) of their finding: _row, value.

    states: closure()'s rows. lines: (id, side, line_no), where each finding's terms stand, side old or new.
    """
    places = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("line_no"))))
    where = lines.groupBy("id").agg(places("old").alias("_o"), places("new").alias("_n"))
    none = F.array().cast("array<int>")
    told = states.select("id", "state", "detail").join(where, "id", "left")
    cell = T.evidence_cell(F.col("state"), F.col("detail"), old_slug, new_slug, F.coalesce(F.col("_o").cast("array<int>"), none), F.coalesce(F.col("_n").cast("array<int>"), none))
    key = F.trim(F.col(f"`{id_column}`"))
    return register.select("_row", key.alias("id")).join(told.select(F.col("id").cast("string").alias("id"), cell.alias("value")), "id").select("_row", "value")


def write_back(register: DataFrame, values: DataFrame, column: str, overwrite: bool = False, before: str | None = None) -> DataFrame:
    """The register with the cells set, in a new column before another one where before is given; rows stay in their order."""
    if before is not None and column not in register.columns:
        register = files.insert_column(register, column, before)
    kept = files.annotate(register, values, column, overwrite)
    return kept.orderBy("_row")

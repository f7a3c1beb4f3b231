"""Queries over the compositions that ask a model, with providers that answer by rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from quillspark.plans import adversarial as V
from quillspark.plans import relations as R
from quillspark.plans.queries import query


class Attacker:
    """Refutes by the number of the part that is asked about: some with a passage, some with words that nobody wrote, some not at all."""

    name = "by-rule"

    def ask(self, system: str, user: str) -> str:
        n = int(re.search(r"part (\d+)", user)[1])
        passage = user.split("PASSAGES\n", 1)[1].split("]\n", 1)[1].split("\n", 1)[0]
        if system == V.LENSES["search"]:
            told = {"refuted": n % 2 == 0, "evidence": "words that nobody wrote" if n % 5 == 0 else passage}
        elif system == V.LENSES["rebuttal"]:
            if n % 7 == 0:
                raise TimeoutError("no answer")
            told = {"refuted": n % 3 == 0, "evidence": passage}
        else:
            told = {"refuted": n % 11 == 0, "evidence": ""}
        return json.dumps(told | {"gap_addressed": "the gap", "reason": f"reason {n}"})


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 5 = 0 AS sf, p_partkey % 7 = 0 AS rf, CAST(p_partkey % 2 = 0 AND p_partkey % 5 > 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AND p_partkey % 7 > 0 AS INTEGER) AS n, p_partkey % 4 = 0 AS u FROM part)
 SELECT id, CASE WHEN sf OR rf THEN 'contested' WHEN n = 2 AND NOT u THEN 'refuted' WHEN n > 0 THEN 'contested' ELSE 'confirmed' END AS status, CAST(n AS BIGINT) AS refutations, u AS universal,
  CASE WHEN sf AND rf THEN 'rebuttal,search' WHEN sf THEN 'search' WHEN rf THEN 'rebuttal' ELSE '' END AS lens_failures, id % 11 = 0 AS immaterial FROM v""")
def o11_verify(spark, sf):
    """Parts as findings, attacked through three lenses over nations as passages."""
    findings = R.spread(R.table(spark, sf, "part")).selectExpr("p_partkey AS id", "concat(CASE WHEN p_partkey % 4 = 0 THEN 'Keep every part ' ELSE 'Keep the part ' END, p_partkey, ' ', p_name) AS requirement", "'unmet' AS verdict", "'not there' AS reason")
    chunks = R.table(spark, sf, "nation").selectExpr("n_nationkey AS chunk_id", "concat('The nation ', n_name, ' keeps its parts.') AS text")
    return V.verify(findings, chunks, Attacker(), 4, stop_after=10_000).select("id", "status", "refutations", "universal", "lens_failures", "immaterial")


class Nominator:
    """Nominates the first two words of four letters or more of a section, the second with a quote that isn't there."""

    name = "by-rule"

    def ask(self, system: str, user: str) -> str:
        found = re.findall(r"[a-z]{4,}", user.split("\n\n", 1)[1])[:2]
        return json.dumps({"terms": [{"term": w, "quote": w if k == 0 else w + " nowhere at all"} for k, w in enumerate(found)]})


@query()
def n11_undefined(spark, sf):
    """Terms that sections of all documents nominate, and that their document uses twice or more and never defines."""
    docs = R.documents(spark, sf)
    terms, _ = V.nominate(docs, Nominator())
    return V.undefined_terms(docs, terms).select("slug", "term", F.col("uses").cast("long").alias("uses"), "start")


class Judge:
    """Addressed where a new rule is shown."""

    name = "by-rule"

    def ask(self, system: str, user: str) -> str:
        return json.dumps({"verdict": "addressed" if "+a new rule" in user else "partial", "rationale": "seen", "quote": ""})


@query("""WITH s AS (SELECT DISTINCT p_size AS n FROM part), r AS (SELECT c_custkey AS id, 1 + c_custkey % 55 AS n FROM customer)
 SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 OR r.n % 10 = 0 OR s.n IS NULL OR r.n % 2 = 1 THEN 'addressed' ELSE 'not_addressed' END AS verdict,
  CASE WHEN id % 11 = 0 THEN 'SKIPPED' WHEN id % 7 = 0 THEN 'WIDE' WHEN r.n % 10 = 0 OR s.n IS NULL THEN 'WIDE+UNLOCATABLE' WHEN r.n % 2 = 1 THEN 'DIFF' ELSE 'UNCHANGED' END AS basis FROM r LEFT JOIN s ON s.n = r.n""")
def o11_adjudicate(spark, sf):
    """Customers' comments on sections that parts of one size make: every tenth is gone in the new revision, odd ones have a new line, and those over 25 have
    another number."""
    from quillspark.operators.aggregates import ranked
    from quillspark.plans.adjudication import adjudicate

    part = R.table(spark, sf, "part").withColumn("title", F.expr("concat(' Topic ', translate(cast(p_size AS string), '0123456789', 'abcdefghij'))"))
    body = part.selectExpr("p_size", "1 AS k", "p_partkey AS at", "concat('the ', p_name) AS text")
    heads = part.select("p_size", "title").distinct()
    head = lambda number: heads.selectExpr("p_size", "0 AS k", "0L AS at", f"concat({number}, title) AS text")
    old = head("p_size").unionByName(body)
    kept = "p_size % 10 > 0"
    new = head("CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END").unionByName(body).filter(kept)
    new = new.unionByName(heads.filter(f"{kept} AND p_size % 2 = 1").selectExpr("p_size", "2 AS k", "0L AS at", "'a new rule' AS text"))
    rows = R.table(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 7 > 0 THEN concat('§', 1 + c_custkey % 55) ELSE 'All' END AS section", "CASE WHEN c_custkey % 11 > 0 THEN 'settle it' ELSE ' ' END AS comment")
    number = lambda df: ranked(df, [F.col("p_size"), F.col("k"), F.col("at")], "line_no").select(F.col("line_no").cast("int").alias("line_no"), "text")
    return adjudicate(rows, number(old), number(new), Judge()).select("id", "verdict", "basis")

"""Queries over inventories item by item, cells of readers, and parts cut by a table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import cells as K
from quillspark.operators import inventories as I
from quillspark.operators import lines as L
from quillspark.plans import relations as R
from quillspark.plans.queries import _headed, headed_sql, query

# An order's inventory: a section whose lists hold good and bad items, and one that is one of six things.
_LISTS = '"capabilities": [], "evidence_claims": [], "authority": [], "defers_to": [], "consumes": [], "produces": []'
INVENTORY = f"""'{{"doc": "d", "runs": 2, "sections": [{{"heading": "1. A", "locator": "d:1-5", "passes": ' || (1 + o_orderkey % 2) || ', "full_passes": ' || (1 + o_orderkey % 2)
 || ', "capabilities": ["ingests", {{"name": ' || o_custkey || '}}], "authority": [{{"capability": "c' || o_custkey || '", "owner": "o", "polarity": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'maybe' ELSE 'owns' END
 || '"}}], "evidence_claims": [{{"claim": "is kept", "points_to": ["Section 2", "Appendix A"]}}], "consumes": [null, " "], "produces": ["p' || (o_orderkey % 6) || '"], "defers_to": []}}, '
 || CASE o_orderkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '{{"heading": "2. B", "error": "t"}}' WHEN 2 THEN '{{"heading": 3}}' WHEN 3 THEN '{{"heading": "2. B", "locator": "d:6-9", "passes": 1, "full_passes": 0, "degraded": true, {_LISTS}}}'
 WHEN 4 THEN '{{"heading": "2. B", "skipped": true, "error": "over the limit"}}' ELSE '{{"heading": "2. B", "locator": "d:6-9", "passes": 2, "full_passes": 2, "capabilities": null}}' END || ']}}'"""


def _states(spark, sf):
    raw = R.spread(R.table(spark, sf, "orders")).selectExpr("o_orderkey AS slug", f"{INVENTORY} AS json")
    return I.section_states(I.entries(raw)[0])


@query("""SELECT o_orderkey AS slug, 1 AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'short' ELSE 'read' END AS state, NULL AS why FROM orders UNION ALL
 SELECT o_orderkey, 2, CASE WHEN o_orderkey % 6 = 3 THEN 'partial' ELSE 'unread' END, CASE o_orderkey % 6 WHEN 0 THEN 'nothing is there' WHEN 1 THEN 'extraction failed' WHEN 2 THEN 'its heading is a whole' WHEN 4 THEN 'over the limit' WHEN 5 THEN 'its capabilities is a null' END FROM orders""")
def d22_section_states(spark, sf):
    """Sections of all orders' inventories: read, short, partial or unread, and why."""
    return _states(spark, sf).select("slug", "position", "state", "why")


@query("""SELECT o_orderkey AS slug, l.list, l.item, CASE WHEN l.list = 'capabilities' AND l.item = 2 THEN 'has a whole for its name' WHEN l.list = 'authority' AND o_orderkey % 3 = 0 THEN 'has a polarity that isn''t owns or excludes' END AS why,
 CASE WHEN l.list = 'capabilities' AND l.item = 1 THEN 'ingests' WHEN l.list = 'authority' AND o_orderkey % 3 > 0 THEN 'c' || o_custkey WHEN l.list = 'evidence_claims' THEN 'Section 2 and Appendix A' WHEN l.list = 'produces' THEN 'p' || (o_orderkey % 6) END AS said
 FROM orders, (VALUES ('capabilities', 1), ('capabilities', 2), ('authority', 1), ('evidence_claims', 1), ('produces', 1)) l(list, item)""")
def d22_items(spark, sf):
    """Every item of every section that was read: what it says, or why it was set aside."""
    told = I.inventory_items(_states(spark, sf))
    return told.select("slug", "list", "item", "why", F.coalesce("name", "points_to", "capability").alias("said"))


@query(headed_sql(L.CHUNKS))
def d02_cut_lines(spark, sf):
    """Chunks by the table function over lines: those of d02_chunks."""
    return L.cut_table(L.to_lines(_headed(spark, sf)), L.CHUNKS)


@query(headed_sql(L.SECTIONS))
def d04_cut_lines(spark, sf):
    return L.cut_table(L.to_lines(_headed(spark, sf)), L.SECTIONS)


# An order is a labelled row, its items are readers' verdicts of it; a line's number is the reader.
TRUTH = "SELECT o_orderkey AS id, o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 'addressed' ELSE 'not_addressed' END AS verdict FROM orders"
RUNS = "SELECT l_linenumber AS model, l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'addressed' WHEN 'R' THEN 'not_addressed' ELSE 'partial' END AS verdict FROM lineitem"
CELLS = f"""t AS ({TRUTH}), m AS (SELECT list_sort(list(score))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS m FROM t),
 c AS (SELECT t.*, CASE WHEN score >= m AND verdict = 'addressed' THEN 'A' WHEN verdict = 'addressed' THEN 'B' WHEN score >= m THEN 'C' ELSE 'D' END AS cell FROM t, m)"""


def _readers(spark, sf):
    orders, items = R.table(spark, sf, "orders"), R.table(spark, sf, "lineitem")
    truth = orders.selectExpr("o_orderkey AS id", "o_totalprice AS score", "CASE WHEN o_orderstatus = 'F' THEN 'addressed' ELSE 'not_addressed' END AS verdict")
    return truth, items.selectExpr("l_linenumber AS model", "l_orderkey AS id", "CASE l_returnflag WHEN 'A' THEN 'addressed' WHEN 'R' THEN 'not_addressed' ELSE 'partial' END AS verdict")


@query(f"""WITH {CELLS}, x AS (SELECT model, cell, r.id, (CASE WHEN r.verdict = 'partial' THEN 'not_addressed' ELSE r.verdict END = c.verdict)::INTEGER AS ok FROM ({RUNS}) r JOIN c ON c.id = r.id),
 g AS (SELECT model, count(DISTINCT id) AS covered, coalesce(avg(ok) FILTER (cell = 'A'), 0) AS a, coalesce(avg(ok) FILTER (cell = 'B'), 0) AS b, coalesce(avg(ok) FILTER (cell = 'C'), 0) AS c, coalesce(avg(ok) FILTER (cell = 'D'), 0) AS d FROM x GROUP BY model),
 p(place, policy, pa, pb, pc, pd) AS (VALUES (1, 'vocabulary matcher', 1, 0, 0, 1), (2, 'blanket addressed', 1, 1, 0, 0), (3, 'blanket refuse', 0, 0, 1, 1), (4, 'outcome judge', 1, 1, 1, 1)),
 n AS (SELECT model, arg_min(policy, (round((a - pa) ** 2 + (b - pb) ** 2 + (c - pc) ** 2 + (d - pd) ** 2, 9), place)) AS policy FROM g, p GROUP BY model)
 SELECT model, covered, CASE WHEN covered >= 80 THEN round(a, 6) END AS a, CASE WHEN covered >= 80 THEN round(b, 6) END AS b, CASE WHEN covered >= 80 THEN round(c, 6) END AS c, CASE WHEN covered >= 80 THEN round(d, 6) END AS d,
  CASE WHEN covered >= 80 THEN round((a + d) / 2 - (b + c) / 2, 6) END AS gap, CASE WHEN covered >= 80 THEN policy END AS policy FROM g JOIN n USING (model)""")
def g22_cells(spark, sf):
    """Readers' rates in the four cells of price and truth, and the policy that they are nearest to."""
    truth, runs = _readers(spark, sf)
    told = K.cell_rates(K.cells(truth), runs)
    return told.select("model", "covered", *[F.round(c, 6).alias(c) for c in ("a", "b", "c", "d", "gap")], "policy")


@query(f"""WITH t AS ({TRUTH}), b AS (SELECT max(n) / sum(n) AS baseline FROM (SELECT count(*) AS n FROM t GROUP BY verdict)), m(mapping, partial) AS (VALUES ('strict', 'not_addressed'), ('lenient', 'addressed'))
 SELECT model, mapping, count(*) FILTER (CASE WHEN r.verdict = 'partial' THEN m.partial ELSE r.verdict END = t.verdict) AS hits, count(*) AS seen,
  round(count(*) FILTER (CASE WHEN r.verdict = 'partial' THEN m.partial ELSE r.verdict END = t.verdict) / count(*), 6) AS accuracy, round(any_value(baseline), 6) AS baseline FROM ({RUNS}) r JOIN t ON t.id = r.id, m, b GROUP BY model, mapping""")
def g20_accuracy(spark, sf):
    """Readers' accuracy with a partial answer counted either way, beside the most frequent label's share."""
    truth, runs = _readers(spark, sf)
    return K.accuracy(truth, runs).withColumn("accuracy", F.round("accuracy", 6)).withColumn("baseline", F.round("baseline", 6))

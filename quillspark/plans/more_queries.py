"""Queries over inventories, pointers, claims, section comparison, definitions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.scale import COVERAGE
from quillspark.operators import joins as J
from quillspark.operators import lines as L
from quillspark.operators import pointers as P
from quillspark.operators import synthesis as S
from quillspark.plans import relations as R
from quillspark.plans.queries import JUDGED, LINES, READINGS, REVISIONS, query, term_table

# Pointers of ten forms, and what each of them names.
POINTERS = """CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN 'see Sections ' || l_suppkey || ', ' || (l_suppkey + 1) || ', and ' || (l_suppkey + 2) WHEN 1 THEN 'Section ' || l_suppkey || '.2 to ' || l_suppkey || '.5'
 WHEN 2 THEN 'Appendices B, C and F; Annex 3' WHEN 3 THEN '§' || l_suppkey || '.' || l_linenumber || ' (Table 4) and 09' WHEN 4 THEN 'Section ' || l_suppkey || ' onwards' WHEN 5 THEN 'Tables 4 to 6 of the plan, p. 12'
 WHEN 6 THEN 'Appendix II to IV' WHEN 7 THEN 'the 2024 roadmap, Sections ' || l_suppkey || '/' || (l_suppkey + 2) || '.0' WHEN 8 THEN 'Sections ' || l_suppkey || ' thru 3' ELSE 'cross-section ' || l_suppkey END"""


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey + l_linenumber) % 10 AS k, l_suppkey AS s, l_linenumber AS n FROM lineitem)
 SELECT id, array_to_string(CASE k WHEN 0 THEN ['section ' || s, 'section ' || (s + 1), 'section ' || (s + 2)] WHEN 1 THEN list_transform(range(2, 6), lambda i: 'section ' || s || '.' || i) WHEN 2 THEN ['appendix b', 'appendix c', 'appendix f', 'annex 3']
  WHEN 3 THEN ['section ' || s || '.' || n, 'section 9'] WHEN 4 THEN ['section ' || s] WHEN 6 THEN ['appendix ii', 'appendix iii', 'appendix iv'] WHEN 7 THEN ['section ' || s, 'section ' || (s + 2)]
  WHEN 8 THEN CASE WHEN s <= 3 THEN list_transform(range(s, 4), lambda i: 'section ' || i) ELSE ['section ' || s, 'section 3'] END ELSE [] END, ', ') AS keys, k IN (3, 5) AS other, k = 4 OR k = 8 AND s > 3 AS more FROM t""")
def d24_places(spark, sf):
    """What each pointer names, whether a table or a page is among it, and whether more is meant."""
    rows = R.table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", f"{POINTERS} AS target")
    told = P.with_places(R.spread(rows))
    return told.select("id", F.array_join(F.transform("keys", lambda k: F.concat_ws(" ", k["kind"], k["number"])), ", ").alias("keys"), "other", "more")


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey + l_linenumber) % 10 AS k FROM lineitem) SELECT id, k IN (1, 2, 6, 8) AS bare FROM t""")
def d25_bare(spark, sf):
    """Pointers that are their places and nothing else."""
    rows = R.spread(R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")).selectExpr("l_orderkey * 10 + l_linenumber AS id", f"{POINTERS} AS target")
    return rows.select("id", P.bare(F.col("target")).alias("bare"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'section' WHEN 1 THEN 'section' WHEN 2 THEN 'appendix' WHEN 3 THEN NULL WHEN 4 THEN 'annex' ELSE 'section' END AS kind,
 CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || (1 + p_partkey % 7) WHEN 1 THEN p_size || 'a' WHEN 2 THEN 'b' WHEN 4 THEN p_size || '' WHEN 5 THEN p_size || '' END AS number FROM part""")
def d25_heading_keys(spark, sf):
    """What marked headings say they are; "3D ..." is a title."""
    part = R.table(spark, sf, "part")
    heading = F.expr("""CASE p_partkey % 6 WHEN 0 THEN concat('## 0', p_size, '.', 1 + p_partkey % 7, ' ', p_name) WHEN 1 THEN concat('**', p_size, 'a.** ', p_name) WHEN 2 THEN concat('Appendix B: ', p_name)
      WHEN 3 THEN concat(p_size, 'D ', p_name) WHEN 4 THEN concat('> Annex ', p_size, ' ', p_name) ELSE concat('| Section ', p_size, '.0: ', p_name) END""")
    key = P.heading_place(heading, strict=True)
    return part.select(F.col("p_partkey").alias("id"), key["kind"].alias("kind"), key["number"].alias("number"))


@query("""SELECT p_partkey AS id, repeat('x', p_size // 10) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS numeral, p_size AS n FROM part""")
def j25_roman(spark, sf):
    """Sizes as small Roman numerals, and back."""
    told = R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), P.numeral(F.col("p_size")).alias("numeral"))
    return told.select("id", "numeral", P.roman(F.col("numeral")).alias("n"))


@query("""WITH t AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 4 AS k FROM part) SELECT id, array_to_string(CASE k WHEN 0 THEN list_transform(range(s, s + 6), lambda i: i || '') WHEN 1 THEN list_transform(range(2, 5), lambda i: s || '.' || i)
 WHEN 2 THEN ['4a', '4b', '4c'] ELSE CASE WHEN s >= 7 THEN list_transform(range(7, s + 1), lambda i: i || '') ELSE [] END END, ' ') AS members FROM t""")
def j26_ranges(spark, sf):
    """Members of ranges of numbers, sub-sections and letters; one that runs backwards has none."""
    part = R.table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 4)
    first, last = F.expr("CASE k WHEN 0 THEN p_size || '' WHEN 1 THEN p_size || '.2' WHEN 2 THEN '4a' ELSE '7' END"), F.expr("CASE k WHEN 0 THEN (p_size + 5) || '' WHEN 1 THEN p_size || '.4' WHEN 2 THEN '4c' ELSE p_size || '' END")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(P.run_of(first, last), " ").alias("members"))


INVENTORY = """CASE WHEN o_orderkey % 13 = 0 THEN '{broken' ELSE concat('{"doc": "d', cast(o_orderkey AS string), '", "runs": 2, "sections": [{"heading": "1 A", "locator": "d:1-5", "full_passes": ', cast(o_orderkey % 3 AS string),
 ', "produces": ["x', cast(o_custkey AS string), '", "y"]}, {"heading": "2 B", "locator": "d:', cast(6 + o_orderkey % 2 AS string), '-9", "error": ', CASE WHEN o_orderkey % 5 = 0 THEN '"timeout"' ELSE 'null' END, ', "full_passes": 2, "skipped": ', CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END, '}]}') END"""


def _sections(spark, sf):
    raw = R.table(spark, sf, "orders").selectExpr("o_orderkey AS slug", f"{INVENTORY} AS json")
    return S.sections_of(S.read_inventories(raw)[0])


@query("""SELECT o_orderkey AS slug, CAST(2 AS BIGINT) AS asked, CAST((o_orderkey % 3 = 2) AS BIGINT) + CAST((o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) AS BIGINT) AS answered, CAST((o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS BIGINT) AS failed,
 CAST(0 AS BIGINT) AS degraded, CAST((o_orderkey % 3 < 2) AS BIGINT) AS short, CAST((o_orderkey % 7 = 0) AS BIGINT) AS skipped FROM orders WHERE o_orderkey % 13 <> 0""")
def g24_shortfall(spark, sf):
    return S.shortfall(_sections(spark, sf))


@query("SELECT o_orderkey AS slug, CAST(6 AS INTEGER) AS \"from\", CAST(6 AS INTEGER) AS \"to\" FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 2 = 1")
def d30_left_out(spark, sf):
    return S.left_out(_sections(spark, sf))


@query("SELECT o_orderkey AS slug, x AS item FROM (SELECT o_orderkey, unnest(['x' || CAST(o_custkey AS VARCHAR), 'y']) AS x FROM orders WHERE o_orderkey % 13 <> 0)")
def d23_flatten(spark, sf):
    return S.flattened(_sections(spark, sf), "produces").select("slug", "item")


@query("""WITH c AS (SELECT doc_id AS id, doc_id AS slug, CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 60) WHEN doc_id % 3 = 1 THEN 'not in ' || substr(text, 5, 60) ELSE 'one' END AS q, text FROM documents),
 f AS (SELECT id, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM c)
 SELECT id, CASE WHEN length(q) < 25 OR NOT contains(q, ' ') OR contains(q, ' | ') THEN 'fragment' WHEN contains(t, lower(q)) THEN 'kept' ELSE 'dropped' END AS state FROM f""")
def e10_claim_quotes(spark, sf):
    docs = R.documents(spark, sf)
    at = F.substring("text", 5, 60)
    claims = docs.select(F.col("slug").alias("id"), "slug", F.when(F.col("slug") % 3 == 0, at).when(F.col("slug") % 3 == 1, F.concat(F.lit("not in "), at)).otherwise("one").alias("quote"))
    return S.claim_quotes(claims, docs).select("id", "state")


@query("""WITH a AS (SELECT DISTINCT p_name, p_type FROM part), w AS (SELECT 'The ' || p_name || ' systems' AS s FROM a) SELECT DISTINCT s AS subject, lower(regexp_replace(s, '^The | systems$', '', 'g')) || ' system' AS key FROM w""")
def j06_subject_keys(spark, sf):
    named = R.table(spark, sf, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" systems")).alias("subject")).distinct()
    return named.select("subject", S.subject_key(F.col("subject")).alias("key"))


@query(f"""WITH {JUDGED}, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 4 = 0 THEN a || '  x' WHEN id % 4 = 1 THEN a || ' y' ELSE a || ' x' END AS b1, a || ' x' AS b0 FROM judged)
 SELECT id, CASE WHEN b1 IS NULL THEN 'missing' WHEN b0 = b1 THEN 'none' WHEN regexp_replace(b1, '\\s+', ' ', 'g') = b0 THEN 'cosmetic' ELSE 'substantive' END AS changed FROM s""")
def c13_section_changes(spark, sf):
    rows = R.judged(spark, sf)
    old = rows.select("id", F.lit("t").alias("title"), F.concat("a", F.lit(" x")).alias("body"))
    end = F.when(F.col("id") % 4 == 0, "  x").when(F.col("id") % 4 == 1, " y").otherwise(" x")
    return S.section_changes(old, rows.filter("id % 10 <> 0").select("id", F.lit("t").alias("title"), F.concat("a", end).alias("body")))


CHANGED = "CASE WHEN l_returnflag = 'A' THEN 'substantive' WHEN l_returnflag = 'R' THEN 'none' ELSE 'missing' END"


@query(f"""WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Updated the text' WHEN 1 THEN 'will be updated' ELSE 'Added a table' END AS action FROM orders),
 p AS (SELECT l_orderkey AS id, count(*) AS named, count(*) FILTER (c = 'missing') AS missing, count(*) FILTER (c = 'substantive') AS moved, count(*) FILTER (c = 'none') AS same FROM (SELECT l_orderkey, {CHANGED} AS c FROM lineitem) GROUP BY 1)
 SELECT a.id, CASE WHEN a.id % 3 = 1 THEN 'NO CLAIM' WHEN named IS NULL THEN 'NO SECTION' WHEN missing = named THEN 'SECTION MISSING' WHEN moved > 0 AND same > 0 THEN 'MIXED' WHEN moved > 0 THEN 'SUPPORTED' ELSE 'DISPUTED' END AS outcome FROM a LEFT JOIN p USING (id)""")
def j34_action_check(spark, sf):
    actions = R.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'Updated the text' WHEN 1 THEN 'will be updated' ELSE 'Added a table' END AS action")
    changes = R.table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_partkey AS section", f"{CHANGED} AS changed")
    return S.action_check(actions, changes)


@query(f"""WITH {JUDGED} SELECT count(*) FILTER (a <> 'unmet' AND b = 'met') AS kept_real, count(*) FILTER (a <> 'unmet' AND b <> 'met') AS kept_false, count(*) FILTER (a = 'unmet' AND b = 'met') AS killed_real, count(*) FILTER (a = 'unmet' AND b <> 'met') AS killed_false,
 count(*) FILTER (b = 'met') / count(*) AS before, count(*) FILTER (a <> 'unmet' AND b = 'met') / count(*) FILTER (a <> 'unmet') AS after FROM judged""")
def g16_survivors(spark, sf):
    status = F.when(F.col("a") == "met", "confirmed").when(F.col("a") == "partial", "contested").otherwise("refuted")
    return S.survivors(R.judged(spark, sf).select(status.alias("status"), (F.col("b") == "met").alias("real")))


@query(f"""WITH {JUDGED}, c AS (SELECT CASE WHEN a = b THEN 'identical' ELSE 'moved' END AS change, CASE WHEN a <> b THEN coalesce(abs(CASE a WHEN 'unmet' THEN 0 WHEN 'partial' THEN 1 WHEN 'met' THEN 2 END - CASE b WHEN 'unmet' THEN 0 WHEN 'partial' THEN 1 WHEN 'met' THEN 2 END), 9) END AS d FROM judged)
 SELECT change, count(*) AS n, CAST(sum(d) AS BIGINT) AS distance FROM c GROUP BY change""")
def g13_moves(spark, sf):
    rows = R.judged(spark, sf).withColumnRenamed("id", "obligation")
    side = lambda c: rows.select("obligation", F.col(c).alias("verdict"))
    return S.moves(J.compare_runs(side("a"), side("b"), scale=COVERAGE))


@query(f"""WITH {JUDGED}, x AS (SELECT id, a, b, id % 3 AS q, id % 2 AS p FROM judged) SELECT count(*) FILTER (id % 7 > 0 AND id % 5 > 0) AS shared, count(*) FILTER (id % 7 > 0 AND id % 5 > 0 AND a = b) AS identical, count(*) FILTER (id % 7 > 0 AND id % 5 > 0 AND a <> b) AS moved,
 count(*) FILTER (id % 7 > 0 AND id % 5 > 0 AND a = b AND q <> p) AS quote_drift, count(*) FILTER (id % 7 > 0 AND id % 5 = 0) AS only_a, count(*) FILTER (id % 7 = 0 AND id % 5 > 0) AS only_b FROM x""")
def g13_run_diff(spark, sf):
    """Two runs of the orders, of which each leaves some out: what agrees, moves, and rests on another quote."""
    rows = R.judged(spark, sf)
    a = rows.filter("id % 7 > 0").selectExpr("id AS obligation", "a AS verdict", "concat(' q', id % 3) AS quote")
    b = rows.filter("id % 5 > 0").selectExpr("id AS obligation", "b AS verdict", "concat('q', id % 2, ' ') AS quote")
    return S.run_diff(a, b, COVERAGE.values + COVERAGE.off)[0]


@query(f"""WITH {JUDGED}, x AS (SELECT a, (SELECT count(*) FROM judged j WHERE j.b = v.a) AS nb, count(*) AS na FROM judged v GROUP BY a) SELECT a AS verdict, na AS a, nb AS b, nb - na AS delta FROM x""")
def g13_verdict_deltas(spark, sf):
    rows = R.judged(spark, sf)
    side = lambda c: rows.select(F.col("id").alias("obligation"), F.col(c).alias("verdict"), F.lit("").alias("quote"))
    return S.run_diff(side("a"), side("b"), ("unmet", "partial", "met"))[1].drop("place")


@query(f"""WITH {JUDGED}, x AS (SELECT count(*) FILTER (a = 'unmet' AND b = 'unmet') AS tp, count(*) FILTER (a <> 'unmet' AND b = 'unmet') AS fn, count(*) FILTER (a = 'unmet' AND b <> 'unmet') AS fp, count(*) FILTER (a <> 'unmet' AND b <> 'unmet') AS tn FROM judged)
 SELECT tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM x""")
def g18_absence(spark, sf):
    """One judge's unmet as a claim of absence, held against the other's."""
    told = S.absence_scores(R.judged(spark, sf).select(F.col("a").alias("verdict"), (F.col("b") == "unmet").alias("absent")))
    return told.select("tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision")])


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS c FROM lineitem), x AS (SELECT q, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS top FROM s JOIN part ON p_partkey = c)
 SELECT q AS query_id, count(*) AS seen, count(top) AS named, coalesce(array_to_string(list_sort(list(DISTINCT top) FILTER (top IS NOT NULL)), ', '), '') AS sections, count(top) = 0 AS blind FROM x GROUP BY q""")
def g27_blind_obligations(spark, sf):
    """Orders as obligations that saw parts as chunks: whether one of them stands under a numbered section."""
    seen = R.table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_partkey AS chunk_id")
    chunks = R.table(spark, sf, "part").selectExpr("p_partkey AS chunk_id", "CASE p_partkey % 3 WHEN 0 THEN concat(' ', p_size, '.2 ', p_name) WHEN 1 THEN p_name ELSE concat(p_size, '% of it') END AS heading")
    return S.blind_obligations(seen, chunks)


LOOSE = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"""WITH d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT id, array_to_string(list_filter(l, lambda x, i: i % 2 = 1), chr(10)) AS odd, array_to_string(list_filter(l, lambda x, i: i % 2 = 0), chr(10)) AS even FROM d),
 w AS (SELECT id, {LOOSE.format('odd')} AS q, {LOOSE.format('even')} AS g FROM s)
 SELECT id, CASE WHEN len(g) = 0 THEN false ELSE len(list_intersect(g, q)) / len(g) >= 0.3 END AS hit, round(CASE WHEN len(list_distinct(list_concat(g, q))) = 0 THEN 0 ELSE len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) END, 6) AS tightness FROM w""")
def g18_span_scores(spark, sf):
    """Whole texts: the lines of odd number as a quote, the others as the span it is held against."""
    part = lambda k: F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % 2 == k), "\n")
    rows = R.spread(R.table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), part(0).alias("quote"), F.array(part(1)).alias("gold"))
    return S.span_scores(rows).withColumn("tightness", F.round("tightness", 6))


@query(f"WITH {READINGS} SELECT model, round(avg(CASE WHEN verdict = 'met' THEN l_quantity ELSE 0 END), 6) AS score FROM readings GROUP BY model")
def g23_reader_averages(spark, sf):
    rows = R.readings(spark, sf).select("model", F.when(F.col("verdict") == "met", F.col("l_quantity").cast("string")).otherwise("n/a").alias("score"))
    return S.reader_averages(rows, "score").withColumn("score", F.round("score", 6))


@query(f"""WITH {READINGS}, o AS (SELECT id, verdict, CASE verdict WHEN 'met' THEN 1 WHEN 'partial' THEN 2 WHEN 'unmet' THEN 3 ELSE 0 END AS r FROM readings) SELECT id, arg_max(verdict, r) AS label FROM o GROUP BY id""")
def g31_harshest(spark, sf):
    rows = R.readings(spark, sf).select("id", F.col("model").cast("int").alias("position"), F.col("verdict").alias("label"))
    return S.harshest(rows, ("met", "partial", "unmet"))


@query("""WITH r AS (SELECT o_custkey AS letter, o_orderkey AS id, o_orderpriority LIKE '1%' AS positive FROM orders), n AS (SELECT *, count(*) FILTER (positive) OVER (PARTITION BY letter) AS n, row_number() OVER (PARTITION BY letter, positive ORDER BY id) AS r FROM r)
 SELECT letter, id, positive FROM n WHERE positive OR r <= 2 * n""")
def f29_matched_controls(spark, sf):
    return S.matched_controls(R.table(spark, sf, "orders").select(F.col("o_custkey").alias("letter"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").startswith("1").alias("positive")))


# Of fourteen lines of a document the second is a heading, the fourth a glossary's, the eighth the next one, the tenth a sentence, the twelfth an entry.
TERMED = "CASE line_no % 14 WHEN 2 THEN '# Alpha ' || slug || ' unit' WHEN 4 THEN '# Glossary' WHEN 5 THEN 'beta-' || slug || ' store' WHEN 8 THEN '# End' WHEN 10 THEN 'The Gamma ' || slug || ' is a' WHEN 12 THEN 'delta ' || slug || ' :' ELSE '-' END"


@query(f"""WITH {LINES}, n AS (SELECT slug, max(line_no) AS n FROM lines GROUP BY slug), k(i, least, term, how) AS (VALUES (1, 2, 'alpha ', 'has its own heading'), (2, 5, 'Beta ', 'glossary entry'), (3, 10, 'gamma ', 'definition sentence'), (4, 12, 'DELTA ', 'definition list entry'), (5, 0, 'epsilon ', NULL))
 SELECT slug, term || slug AS term, CASE WHEN n >= least THEN how END AS defined FROM n, k""")
def e12_definitions(spark, sf):
    """Every document's five terms: by heading, glossary, sentence, list entry, and one that it doesn't define."""
    rows = R.lines(spark, sf).withColumn("text", F.expr(TERMED))
    terms = rows.select("slug").distinct().select("slug", F.explode(F.array(*[F.concat(F.lit(x), F.col("slug").cast("string")) for x in ("alpha ", "Beta ", "gamma ", "DELTA ", "epsilon ")])).alias("term"))
    return S.definitions(terms, rows)


@query("""WITH h AS (SELECT DISTINCT p_brand AS id, p_type AS term, p_partkey % 50 AS line FROM part), w AS (SELECT id, term, count(*) AS width FROM h GROUP BY ALL),
 r AS (SELECT h.*, width, dense_rank() OVER (PARTITION BY id ORDER BY width, term) AS r FROM h JOIN w USING (id, term)), f AS (SELECT id, line, min(r) AS r FROM r GROUP BY ALL), g AS (SELECT id, r, count(*) AS n FROM f GROUP BY ALL),
 e AS (SELECT d.*, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY d.id ORDER BY d.r) AS BIGINT) AS lines FROM (SELECT DISTINCT id, term, width, r FROM r) d LEFT JOIN g ON g.id = d.id AND g.r = d.r)
 SELECT id, term, width, lines FROM e WHERE lines <= 30 OR r = 1""")
def k10_widen_terms(spark, sf):
    hits = R.table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("term"), (F.col("p_partkey") % 50).alias("line")).distinct()
    return S.widen_terms(hits, 30)


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), i AS (SELECT name, upper(array_to_string(list_transform(string_split(name, ' '), lambda x: substr(x, 1, 1)), '')) AS initials FROM n)
 SELECT initials, min(name) AS name FROM i WHERE length(initials) >= 2 GROUP BY initials HAVING count(*) = 1""")
def k11_initials(spark, sf):
    from quillspark.operators.graph import initials

    return initials(R.table(spark, sf, "part").select(F.col("p_name").alias("name")))


@query()
def d15_requirement_candidates(spark, sf):
    """The sentences with a modal word of all documents, whole texts."""
    return L.candidates(R.documents(spark, sf))


@query("""WITH t AS (SELECT doc_id AS slug, replace(replace(text, ' the ', ' SHALL '), ' in ', ' MAY NOT ') AS text FROM documents WHERE text <> ''),
 p AS (SELECT slug, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM t), l AS (SELECT slug, unnest(range(1, len(p) + 1)) AS line_no, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS x FROM p),
 k AS (SELECT *, line_no - row_number() OVER (PARTITION BY slug ORDER BY line_no) AS para FROM l WHERE x <> '' AND x NOT LIKE '#%' AND x NOT LIKE '|%' AND NOT (length(x) < 80 AND regexp_matches(x, '^\\d+(\\.\\d+)*\\s+\\S'))),
 s AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY slug, para ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM k),
 b AS (SELECT slug, para, string_split(regexp_replace(string_agg(x, ' ' ORDER BY line_no), '([.;])(\\s+)([A-Z(])', '\\1\\2' || chr(1) || '\\3', 'g'), chr(1)) AS w FROM s GROUP BY ALL),
 e AS (SELECT slug, para, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS said FROM b), o AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY slug, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM e),
 m AS (SELECT *, CASE WHEN regexp_matches(said, '\\bMAY\\s+NOT\\b') THEN 'MAY NOT' ELSE 'SHALL' END AS modality_hint FROM o WHERE regexp_matches(said, '\\bMAY\\s+NOT\\b|\\bSHALL\\b'))
 SELECT m.slug, (SELECT max(s.line_no) FROM s WHERE s.slug = m.slug AND s.para = m.para AND s.at <= m.at) AS line, modality_hint, trim(said) AS raw FROM m""")
def d15_modal_sentences(spark, sf):
    """Invented prose has no modal words: two common words of it stand in for them."""
    docs = R.documents(spark, sf).withColumn("text", F.expr("replace(replace(text, ' the ', ' SHALL '), ' in ', ' MAY NOT ')"))
    return L.candidates(docs).select("slug", "line", "modality_hint", "raw")


@query("""WITH n AS (SELECT doc_id AS slug, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n FROM documents)
 SELECT slug, 1 AS line, 1 AS depth, 'One' AS title, n + 6 AS "end", CAST(NULL AS INTEGER) AS over_line FROM n UNION ALL SELECT slug, n + 2, 2, 'Two', n + 6, 1 FROM n UNION ALL SELECT slug, n + 7, 1, 'Three', n + 7, NULL FROM n""")
def d12_outline(spark, sf):
    docs = R.documents(spark, sf).select("slug", F.concat(F.lit("# One\n"), "text", F.lit("\n## Two\nx\n```\n# no\n```\n# Three\n")).alias("text"))
    return S.outline(docs).select("slug", "line", "depth", "title", "end", "over_line")


@query(f"""WITH {REVISIONS}, c AS (SELECT t.id, (SELECT count(*) FROM o WHERE o.id = t.id) AS old_lines, (SELECT count(*) FROM w WHERE w.id = t.id) AS new_lines FROM terms t),
 s AS (SELECT id, CASE WHEN old_lines > 120 OR new_lines > 120 THEN 'TOO BROAD' WHEN old_lines + new_lines = 0 THEN 'STILL ABSENT' WHEN new_lines = 0 THEN 'REMOVED' WHEN old_lines = 0 THEN 'ADDED'
 WHEN (SELECT list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY n) FROM o WHERE o.id = c.id) = (SELECT list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY n) FROM w WHERE w.id = c.id) THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM c)
 SELECT 'closure' AS part, state AS what, count(*) AS n FROM s GROUP BY state
 UNION ALL SELECT 'drift', CASE doc_id % 20 WHEN 3 THEN 'never frozen' WHEN 4 THEN 'gone' ELSE 'as frozen' END, count(*) FROM documents GROUP BY ALL
 UNION ALL SELECT 'vocabulary', t.term, CAST(coalesce(sum(CASE WHEN contains(lower(text), term) THEN (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) END), 0) AS BIGINT) FROM terms t CROSS JOIN (SELECT text FROM lines WHERE slug % 20 <> 4) GROUP BY t.term""")
def o03_review(spark, sf):
    """The deterministic review of two revisions of the corpus, each without a twentieth of the documents: closure states, drift and the terms' uses."""
    from quillspark.plans.review import review

    docs, terms = R.documents(spark, sf), term_table(spark)
    lexicon = terms.select("term", F.col("term").alias("variant")).limit(0)
    out = review(docs.filter("slug % 20 <> 3"), docs.filter("slug % 20 <> 4"), terms.select("id", F.lit(True).alias("absence")), terms, lexicon, terms.select("term"))
    tally = lambda part, what: out[part].groupBy(F.lit(part).alias("part"), F.col(what).alias("what")).agg(F.count("*").alias("n"))
    uses = out["vocabulary"].select(F.lit("vocabulary").alias("part"), F.col("term").alias("what"), F.col("uses").cast("long").alias("n"))
    return tally("closure", "state").unionByName(tally("drift", "state")).unionByName(uses)



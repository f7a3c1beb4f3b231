"""Queries over places, quantities, integrity, self-claims and letters, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import closure as C
from quillspark.operators import lines as L
from quillspark.operators import records as N
from quillspark.operators import sections as P
from quillspark.plans import relations as R
from quillspark.plans.queries import JUDGED, LINES, STOP, query

HEADS = "SELECT DISTINCT CAST(p_brand AS VARCHAR) AS slug, 'section' AS kind, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '.' || CAST(p_size % 3 AS VARCHAR) END AS number, p_size * 10 AS line, p_size * 10 + 8 AS e FROM part"


@query(f"""WITH h AS ({HEADS}), p AS (SELECT p_partkey AS id, p_brand AS slug, CAST(p_partkey % 40 AS VARCHAR) AS number FROM part)
 SELECT p.id, p.number, h.number AS found, h.line FROM p JOIN h ON h.slug = p.slug AND (h.number = p.number OR starts_with(h.number, p.number || '.'))""")
def d13_located(spark, sf):
    heads = R.table(spark, sf, "part").selectExpr("p_brand AS slug", "'section' AS kind", "CASE p_size % 3 WHEN 0 THEN cast(p_size AS string) ELSE concat(p_size, '.', p_size % 3) END AS number", "p_size * 10 AS line", "p_size * 10 + 8 AS end").distinct()
    places = R.table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand AS slug", "'section' AS kind", "cast(p_partkey % 40 AS string) AS number")
    return P.located(places, heads).select("id", "number", "found", "line")


@query(f"""WITH {LINES}, l AS (SELECT slug, line_no, CASE line_no % 6 WHEN 0 THEN (line_no % 4) || '. Step one' WHEN 1 THEN (line_no % 5) || '. Step two' WHEN 3 THEN '7.' || (line_no % 3) || ' Place alone' ELSE 't' END AS text FROM lines),
 k AS (SELECT *, CASE WHEN text <> 't' THEN split_part(rtrim(split_part(text, ' ', 1), '.'), ' ', 1) END AS k FROM l), n AS (SELECT *, lag(k) OVER w AS b, lead(k) OVER w AS a FROM k WINDOW w AS (PARTITION BY slug ORDER BY line_no))
 SELECT slug, CASE WHEN k LIKE '%.0' THEN split_part(k, '.', 1) ELSE k END AS key, min(line_no) AS line_no FROM n WHERE k IS NOT NULL AND a IS NULL AND b IS NULL GROUP BY ALL""")
def d14_unlisted(spark, sf):
    """Lines made numbered: two in a row are a list, one alone is a place."""
    text = F.expr("CASE line_no % 6 WHEN 0 THEN concat(line_no % 4, '. Step one') WHEN 1 THEN concat(line_no % 5, '. Step two') WHEN 3 THEN concat('7.', line_no % 3, ' Place alone') ELSE 't' END")
    return P.unlisted(R.lines(spark, sf).withColumn("text", text).withColumn("marked", F.lit(False)))


@query(f"""WITH {LINES}, c AS (SELECT slug, line_no AS start, CASE line_no % 3 WHEN 0 THEN (line_no % 2) || '.1 Sub' WHEN 1 THEN (line_no % 2) || ' Top' ELSE 'Preface' END AS heading, text FROM lines),
 s AS (SELECT *, CASE WHEN heading = 'Preface' THEN heading ELSE substr(heading, 1, 1) END AS section FROM c)
 SELECT slug, section, min(start) AS start, CAST(count(*) AS INTEGER) AS chunks, substr(string_agg(text, chr(10) ORDER BY start), 1, 1400) AS context FROM s GROUP BY slug, section""")
def d17_section_contexts(spark, sf):
    heading = F.expr("CASE line_no % 3 WHEN 0 THEN concat(line_no % 2, '.1 Sub') WHEN 1 THEN concat(line_no % 2, ' Top') ELSE 'Preface' END")
    return P.section_contexts(R.lines(spark, sf).select("slug", heading.alias("heading"), F.col("line_no").alias("start"), "text"))


@query(f"""WITH {LINES}, t AS (SELECT slug, line_no, CASE line_no % 4 WHEN 0 THEN 'threshold k' || (line_no % 9) || ' holds' WHEN 1 THEN 'sum of beta_' || chr(CAST(97 + slug % 5 AS INTEGER)) || ' and rate limiting' WHEN 2 THEN CASE WHEN slug % 3 = 0 THEN 'k' || (line_no % 9) || ' set to 4' ELSE 'edge_state' END ELSE 'factor in it' END AS text FROM lines),
 u AS (SELECT slug, line_no, 'k' || (line_no % 9) AS name FROM t WHERE line_no % 4 = 0 UNION ALL SELECT slug, line_no, 'beta_' || chr(CAST(97 + slug % 5 AS INTEGER)) FROM t WHERE line_no % 4 = 1),
 p AS (SELECT DISTINCT u.slug, u.name FROM u JOIN t ON t.slug = u.slug AND t.line_no BETWEEN u.line_no - 1 AND u.line_no + 1 WHERE t.text LIKE '%set to%')
 SELECT u.slug, u.name, count(*) AS uses, min(u.line_no) AS first_line FROM u LEFT JOIN p ON p.slug = u.slug AND p.name = u.name WHERE p.name IS NULL GROUP BY u.slug, u.name""")
def d19_unpinned_quantities(spark, sf):
    """Lines made to use quantities; a third of the documents gives some of them a value one line on."""
    text = F.expr("CASE line_no % 4 WHEN 0 THEN concat('threshold k', line_no % 9, ' holds') WHEN 1 THEN concat('sum of beta_', chr(97 + slug % 5), ' and rate limiting') WHEN 2 THEN CASE WHEN slug % 3 = 0 THEN concat('k', line_no % 9, ' set to 4') ELSE 'edge_state' END ELSE 'factor in it' END")
    return P.unpinned(R.lines(spark, sf).withColumn("text", text))


@query(f"""WITH {LINES} SELECT slug, line_no, text FROM lines WHERE line_no % 12 BETWEEN 4 AND 8 AND line_no >= 4""")
def d21_glossary(spark, sf):
    """Of twelve lines the fourth is made a glossary's heading and the tenth another one."""
    rows = R.lines(spark, sf)
    text = F.expr("CASE line_no % 12 WHEN 3 THEN '4. Glossary of terms' WHEN 9 THEN '# Other matters' ELSE concat('w ', text) END")
    return P.glossary_lines(rows.withColumn("text", text)).withColumn("text", F.substring("text", 3, 1_000_000))


@query("""SELECT c_custkey AS slug, 'unknown role ' || CASE WHEN c_custkey % 7 = 3 THEN 'none' ELSE 'author' END AS fault FROM customer WHERE c_custkey % 7 IN (2, 3) UNION ALL SELECT NULL, count(*) FILTER (c_custkey % 500 = 1 AND c_custkey % 7 NOT IN (2, 3)) || ' anchors' FROM customer HAVING count(*) FILTER (c_custkey % 500 = 1 AND c_custkey % 7 NOT IN (2, 3)) <> 1""")
def c05_roles(spark, sf):
    role = F.expr("CASE WHEN c_custkey % 7 = 2 THEN 'author' WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 500 = 1 THEN 'anchor' ELSE 'draft' END")
    return P.roles(R.table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"), role.alias("role")))


ENTRY = f"""e AS (SELECT slug, line_no AS position, line_no AS first, line_no + CASE WHEN slug % 11 = 0 AND line_no = 3 THEN 100000 ELSE 0 END AS last, CASE WHEN slug % 5 = 0 AND line_no = 2 THEN 'Elsewhere' ELSE 'H' || line_no END AS heading FROM lines WHERE slug % 13 > 0)"""


@query(f"""WITH {LINES}, {ENTRY}, f AS (SELECT slug, position, CASE WHEN slug % 11 = 0 AND position = 3 THEN 'outside of the text' WHEN slug % 5 = 0 AND position = 2 THEN 'not the heading there' END AS fault FROM e)
 SELECT slug, arg_min(position, position) AS position, arg_min(fault, position) AS fault FROM f WHERE fault IS NOT NULL GROUP BY slug""")
def c08_moved_headings(spark, sf):
    """Every line is a heading with an entry; some entries name another heading or a place outside."""
    rows = R.lines(spark, sf)
    entries = rows.filter("slug % 13 > 0").selectExpr("slug", "line_no AS position", "line_no AS first", "line_no + CASE WHEN slug % 11 = 0 AND line_no = 3 THEN 100000 ELSE 0 END AS last", "CASE WHEN slug % 5 = 0 AND line_no = 2 THEN 'Elsewhere' ELSE concat('H', line_no) END AS heading")
    return P.moved_headings(entries, rows.withColumn("text", F.concat(F.lit("## H"), F.col("line_no"))))


@query("""SELECT doc_id AS slug, NOT (doc_id % 4 = 1 OR (doc_id % 4 >= 2 AND doc_id % 6 = 0)) AS consulted, CASE WHEN doc_id % 4 = 1 THEN 'another text' WHEN doc_id % 4 >= 2 AND doc_id % 6 = 0 THEN 'not the heading there' END AS why FROM documents""")
def c09_consulted(spark, sf):
    docs = R.documents(spark, sf)
    pinned = docs.select("slug", F.when(F.col("slug") % 4 == 0, F.sha2("text", 256)).when(F.col("slug") % 4 == 1, F.lit("other")).alias("text_sha256"))
    return P.consulted(pinned, docs, docs.filter("slug % 6 = 0").select("slug", F.lit("not the heading there").alias("fault")))


@query(f"""WITH {LINES}, c AS (SELECT slug, line_no, unnest(list_distinct(['3.' || (line_no % 6), CAST(slug % 4 AS VARCHAR)])) AS reference FROM lines) SELECT * FROM c WHERE reference NOT IN ('3.1', '3.2', '3.4', '1', '3')""")
def c11_dangling(spark, sf):
    rows = R.lines(spark, sf).withColumn("text", F.expr("concat('as §3.', line_no % 6, ' and § ', slug % 4, ' say')"))
    cited = spark.createDataFrame([("## 3.1 A",), ("### §3.2 B",), ("#### § 3.4 C",), ("## 1 D",), ("## 3 E",), ("# 2 no",), ("text",)], "text string")
    return P.dangling(rows, cited)


@query("""WITH d AS (SELECT doc_id AS slug, CASE WHEN doc_id % 9 = 0 THEN 'source hash mismatch' WHEN doc_id % 7 = 0 THEN 'source changed' WHEN doc_id % 5 = 0 AND doc_id % 8 > 0 THEN 'text edited' END AS state FROM documents) SELECT slug, state, '' AS detail FROM d WHERE state IS NOT NULL""")
def o02_freeze_report(spark, sf):
    """A plain run over frozen documents: some have another source, some another text, some a wrong pin, an eighth was never frozen."""
    docs = R.documents(spark, sf)
    before = docs.filter("slug % 8 > 0 OR slug % 7 = 0").select("slug", F.when(F.col("slug") % 7 == 0, F.lit("old")).otherwise(F.sha2(F.col("slug").cast("string"), 256)).alias("source_sha256"), F.when(F.col("slug") % 5 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("text_sha256"), F.size(F.split("text", "\n")).alias("text_lines"))
    pins = docs.select("slug", F.when(F.col("slug") % 9 == 0, F.lit("zz")).otherwise(F.substring(F.sha2(F.col("slug").cast("string"), 256), 1, 12)).alias("pin"))
    return P.freeze(docs.withColumn("source_sha256", F.sha2(F.col("slug").cast("string"), 256)), before, pins)[1]


@query("""SELECT doc_id AS slug, sha256(CAST(doc_id AS VARCHAR)) AS source_sha256, sha256(text) AS text_sha256, len(string_split(text, chr(10))) AS text_lines FROM documents""")
def o02_freeze(spark, sf):
    docs = R.documents(spark, sf).withColumn("source_sha256", F.sha2(F.col("slug").cast("string"), 256))
    return P.freeze(docs, None)[0]


@query("""WITH s AS (SELECT p_brand AS slug, p_partkey AS position, p_size AS number, p_name AS owner FROM part WHERE p_partkey % 3 = 0), o AS (SELECT slug, number, arg_min(owner, position) AS owner FROM s GROUP BY ALL)
 SELECT p_partkey AS id, owner AS source FROM part LEFT JOIN o ON o.slug = p_brand AND o.number = p_size""")
def k04_deferral_sources(spark, sf):
    part = R.table(spark, sf, "part")
    sections = part.selectExpr("p_brand AS slug", "p_partkey AS position", "CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_size, '. ', p_name, ' ') ELSE concat(p_size, '.1 ', p_name) END AS heading")
    deferrals = part.selectExpr("p_partkey AS id", "p_brand AS slug", "concat(p_size, '.', p_partkey % 3, ' Part') AS heading")
    return P.deferral_sources(deferrals, P.section_owners(sections)).select("id", "source")


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS slug, p_size, p_partkey % 12 AS k, p_name FROM part), h AS (SELECT DISTINCT p_brand AS slug, p_size FROM part WHERE p_size % 4 < 3), v AS (SELECT DISTINCT p_brand AS slug, p_size, p_name FROM part WHERE p_size % 4 = 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY slug, p_size, p_name ORDER BY id) AS r FROM c WHERE k >= 7),
 s AS (SELECT c.*, CASE WHEN k = 6 THEN 'not checked: not a claim' WHEN k = 0 THEN 'not checked: no pointer' WHEN k = 1 THEN 'not checked: its own section' WHEN k = 2 THEN 'not checked: no place' WHEN k = 3 THEN 'not checked: too little said'
   WHEN k = 4 THEN 'not checked: a table or a page' WHEN k = 5 THEN 'not checked: no number' WHEN r > 1 THEN 'not checked: said before'
   WHEN c.p_size % 4 = 3 THEN CASE WHEN c.slug LIKE '%1%' THEN 'no such section' ELSE 'not among what was read' END WHEN c.p_size % 4 <> 1 THEN 'in the document, not in the inventory'
   WHEN EXISTS (SELECT 1 FROM v WHERE v.slug = c.slug AND v.p_size = c.p_size AND (split_part(v.p_name, ' ', 1) IN (split_part(c.p_name, ' ', 1), split_part(c.p_name, ' ', 2)) OR split_part(v.p_name, ' ', 2) IN (split_part(c.p_name, ' ', 1), split_part(c.p_name, ' ', 2)))) THEN 'held' ELSE CASE WHEN c.slug LIKE '%1%' THEN 'not held there' ELSE 'not held in what was read' END END AS state
 FROM c LEFT JOIN (SELECT id, r FROM f) f USING (id))
 SELECT id, state, state NOT LIKE 'not checked%' AND state <> 'held' AND (slug NOT LIKE '%1%' OR k >= 10 OR state LIKE 'in the doc%') AS doubtful FROM s""")
def k08_self_claims(spark, sf):
    """Parts as claims about numbered sections: the eight reasons not to check one, what is held, what isn't, and what is doubtful."""
    part = R.table(spark, sf, "part")
    claims = part.selectExpr("p_partkey AS id", "p_brand AS slug", "CASE p_partkey % 12 WHEN 3 THEN 'is covered' WHEN 6 THEN NULL ELSE concat(replace(p_name, ' ', 'zzz '), 'zzz') END AS claim",
        "CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'this section' WHEN 2 THEN 'elsewhere' WHEN 4 THEN 'Table 4' WHEN 5 THEN 'the calibration section' WHEN 10 THEN concat('Section ', p_size, ' onwards') WHEN 11 THEN concat('Section ', p_size, ' of the ICD') ELSE concat('Section ', p_size) END AS target")
    heads = part.filter("p_size % 4 < 3").selectExpr("p_brand AS slug", "'section' AS kind", "cast(p_size AS string) AS number", "p_size * 100 AS line", "p_size * 100 + 99 AS end").distinct()
    held = part.filter("p_size % 4 = 1").selectExpr("p_brand AS slug", "p_size * 100 + 5 AS first", "p_size * 100 + 9 AS last", "concat(replace(p_name, ' ', 'zzz '), 'zzz') AS capability").distinct()
    read = part.selectExpr("p_brand AS slug", "p_brand LIKE '%1%' AS complete").distinct()
    return P.self_claims(claims, heads, held, read).select("id", "state", "doubtful")


@query(f"""WITH {LINES}, l AS (SELECT slug, line_no, text FROM lines WHERE slug % 5 > 0), n AS (SELECT slug, line_no, CASE WHEN line_no % 3 = 1 THEN (line_no + 2) // 3 END AS n, text FROM l), m AS (SELECT *, max(n) OVER (PARTITION BY slug ORDER BY line_no) AS number FROM n)
 SELECT slug, CAST(number AS INTEGER) AS number, min(line_no) AS first, trim(regexp_replace(string_agg(text, ' ' ORDER BY line_no), '\\s+', ' ', 'g')) AS body FROM m GROUP BY slug, number""")
def d26_letter_outline(spark, sf):
    """Each third line opens the next comment; page headers stand between; a fifth of the letters begins with number 2 and gives no row."""
    rows = R.lines(spark, sf)
    number = F.floor((F.col("line_no") + 2) / 3) + F.when(F.col("slug") % 5 == 0, 1).otherwise(0)
    text = F.when(F.col("line_no") % 3 == 1, F.concat(number.cast("string"), F.lit(".  "), "text")).otherwise(F.regexp_replace("text", r"^(\s*\d{1,3}\.)", " " * 13 + "$1"))  # too far in to open a comment
    base = rows.select("slug", (F.col("line_no") * 10).alias("line_no"), text.alias("text"))
    date = rows.filter("line_no % 4 = 2").selectExpr("slug", "line_no * 10 + 1 AS line_no", "'May 8, 2024' AS text")
    page = rows.filter("line_no % 4 = 2").selectExpr("slug", "line_no * 10 + 2 AS line_no", "concat('Page ', line_no) AS text")
    return P.letter_outline(base.unionByName(date).unionByName(page)).withColumn("first", F.expr("cast(first / 10 AS int)"))


@query("""WITH o AS (SELECT o_custkey AS slug, CAST(o_orderkey AS BIGINT) AS number, o_orderkey % 4 AS k FROM orders), e AS (SELECT slug, number, 3 AS prior, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS level FROM o UNION ALL SELECT slug, number, 4, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END FROM o UNION ALL SELECT slug, number, 7, 2 FROM o WHERE k = 3)
 SELECT slug, prior, CASE max(level) WHEN 2 THEN 'not_addressed' WHEN 1 THEN 'partial' ELSE 'addressed' END AS verdict FROM e GROUP BY slug, prior""")
def k19_rulings(spark, sf):
    body = F.expr("concat('We note your response to prior comments 3 and 4. Thank you. ', CASE o_orderkey % 4 WHEN 0 THEN 'It is clear.' WHEN 1 THEN 'We reissue the comment.' WHEN 2 THEN 'We reissue the first bullet of it in part.' ELSE 'We reissue prior comment 7 here.' END)")
    return P.rulings(R.table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("number"), body.alias("body")))


@query("SELECT o_custkey AS id, arg_max('said ' || o_orderkey, (o_orderdate, 'said ' || o_orderkey)) AS claim, max(o_orderdate) AS date FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 > 0 GROUP BY o_custkey")
def k21_latest_claim(spark, sf):
    letters = R.table(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderstatus = 'F' AS ours", "o_orderdate AS date", "CASE WHEN o_orderkey % 5 > 0 THEN concat('said ', o_orderkey) ELSE ' ' END AS text")
    return P.latest_claim(letters)


@query("""WITH b AS (SELECT o_custkey AS company, o_orderkey AS id, o_orderdate AS d, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS k FROM orders), n AS (SELECT *, lead(k) OVER w AS nk, lead(id) OVER w AS ni FROM b WINDOW w AS (PARTITION BY company ORDER BY d, k, id)) SELECT company, id, CASE WHEN nk = 1 THEN ni END AS reply FROM n WHERE k = 0""")
def a35_next_reply(spark, sf):
    orders = R.table(spark, sf, "orders")
    return P.next_reply(orders.filter("o_orderstatus = 'F'").selectExpr("o_custkey AS company", "o_orderkey AS id", "o_orderdate AS date"), orders.filter("o_orderstatus <> 'F'").selectExpr("o_custkey AS company", "o_orderkey AS reply", "o_orderdate AS date"))


@query("""WITH u AS (SELECT doc_id AS id, length(text) AS size, row_number() OVER (ORDER BY length(text), doc_id) AS place, count(*) OVER () AS n FROM documents WHERE length(text) >= 1000) SELECT id, size FROM u WHERE place IN (SELECT least(k * greatest(1, n // 12), n - 1) + 1 FROM range(12) r(k))""")
def k22_spread_pick(spark, sf):
    docs = R.documents(spark, sf).select(F.col("slug").alias("id"), F.char_length("text").alias("size"))
    return P.spread_pick(docs, 12, 1000).select("id", "size")


@query(f"""WITH {LINES} SELECT slug, line_no, CASE line_no % 7 WHEN 5 THEN '# New' WHEN 6 THEN text WHEN 0 THEN text WHEN 1 THEN text END AS text FROM lines WHERE line_no % 7 IN (5, 6, 0) OR (line_no = 1)""")
def k20_regression(spark, sf):
    """A revision without the section that each second heading opens, and with one heading renamed."""
    text = F.expr("CASE line_no % 7 WHEN 2 THEN '## Drop' WHEN 3 THEN '### Deeper' WHEN 5 THEN '# Old' WHEN 1 THEN CASE WHEN line_no = 1 THEN text ELSE '## Drop' END ELSE text END")
    rows = R.lines(spark, sf).withColumn("text", text)
    return P.renamed(P.without_section(rows, "## Drop"), {"Old": "New"})


@query("SELECT doc_id AS slug, md5(regexp_replace(text, '\\n$', '')) AS text_md5 FROM documents WHERE text <> ''")
def k23_joined_texts(spark, sf):
    return P.joined_texts(R.lines(spark, sf)).select("slug", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {LINES} SELECT slug, line_no, 'F-' || line_no AS id, 'met / ' || line_no || ' / x' AS cells FROM lines WHERE line_no % 4 = 1""")
def a27_register_rows(spark, sf):
    text = F.expr("CASE line_no % 4 WHEN 1 THEN concat(' | F-', line_no, ' | met |', line_no, '| x | ') WHEN 2 THEN '| --- | --- |' WHEN 3 THEN '| note | F-1 |' ELSE text END")
    return P.register_rows(R.lines(spark, sf).withColumn("text", text)).withColumn("cells", F.array_join("cells", " / "))


@query("""SELECT DISTINCT len(string_split(p_name, ' ')) + 1 AS n, sha256(p_name || ' ' || lower(p_type)) AS digest FROM part""")
def a28_denylist(spark, sf):
    return P.deny_phrases(R.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name", F.lit("--"), "p_type", F.lit("!")).alias("phrase")))


@query("""SELECT doc_id AS slug, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{3,}'), lambda x: lower(x) NOT IN ('this', 'given', 'above', 'below', 'shown', 'across', 'through', 'stated', 'listed') AND NOT regexp_matches(x, '^[A-Z]{1,4}[-_]?\\d{1,4}$')))) >= 0 AS counted,
 len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{3,}'), lambda x: lower(x) NOT IN ('this', 'given', 'above', 'below', 'shown', 'across', 'through', 'stated', 'listed') AND NOT regexp_matches(x, '^[A-Z]{1,4}[-_]?\\d{1,4}$')), lambda x: lower(x)))) AS words FROM documents""")
def j17_claim_words(spark, sf):
    return R.documents(spark, sf).select("slug", F.lit(True).alias("counted"), F.size(P.claim_words(F.col("text"))).alias("words"))


# 2.O: whole reviews

OFFLINE = "CASE ('0x' || substr(sha256({}), 1, 2))::INTEGER % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'partial' WHEN 2 THEN 'unmet' ELSE 'unverifiable' END"


@query(f"""WITH {LINES}, ch AS (SELECT CAST(slug AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) AS chunk_id, text FROM lines), d AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS term FROM ch) WHERE term NOT IN ({STOP}) GROUP BY ALL),
 i AS (SELECT term, sqrt((SELECT count(*) FROM ch) / (count(*) + 1)) AS idf FROM d GROUP BY term), ob AS (SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 10 = 0 THEN 'MAY' ELSE 'SHALL' END AS modality, text FROM benchmark),
 q AS (SELECT id, term, count(*) AS qf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS term FROM ob WHERE modality <> 'MAY') WHERE term NOT IN ({STOP}) GROUP BY ALL),
 s AS (SELECT id, chunk_id, round(sum(idf * least(qf, tf)), 6) AS score FROM q JOIN i USING (term) JOIN d USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id DESC) AS rank FROM s),
 p AS (SELECT r.id, string_agg(ch.text, chr(10) || chr(10) ORDER BY rank) AS passages FROM r JOIN ch USING (chunk_id) WHERE rank <= 12 GROUP BY r.id),
 v AS (SELECT ob.*, CASE WHEN modality = 'MAY' THEN 'not_applicable' ELSE {OFFLINE.format("'Judge the obligation by the passages.' || chr(0) || ob.text || coalesce(chr(10) || chr(10) || passages, '')")} END AS verdict FROM ob LEFT JOIN p USING (id)),
 a AS (SELECT DISTINCT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{4,}}'), lambda x: x NOT IN ({STOP})))) AS word FROM ob WHERE modality <> 'MAY'),
 w AS (SELECT word, sum((length(low) - length(replace(low, word, ''))) // length(word)) AS hits FROM (SELECT DISTINCT word FROM a), (SELECT lower(text) AS low FROM documents) GROUP BY word),
 h AS (SELECT a.id, a.word, CAST(hits AS BIGINT) AS hits, row_number() OVER (PARTITION BY a.id ORDER BY hits, a.word) AS r FROM a JOIN w USING (word) WHERE hits > 0),
 g AS (SELECT id, count(*) AS n, sum(hits) AS total, string_agg(word || 'x' || hits, ', ' ORDER BY hits, word) AS e FROM h WHERE r <= 3 GROUP BY id)
 SELECT v.id, modality, verdict, CASE WHEN verdict = 'unmet' THEN CASE WHEN n >= 2 AND total >= 8 THEN 'contested' ELSE 'clear' END END AS gate, CASE WHEN verdict = 'unmet' AND n >= 2 AND total >= 8 THEN e END AS evidence FROM v LEFT JOIN g USING (id)""")
def o05_coverage(spark, sf):
    """Benchmark passages as obligations against all documents' lines, with the offline provider."""
    from quillspark.plans.review import coverage
    from quillspark.provider import Offline

    items = R.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 10 == 0, "MAY").otherwise("SHALL").alias("modality"), "text")
    chunks = R.lines(spark, sf).select(F.concat_ws(":", F.col("slug").cast("string"), F.col("line_no").cast("string")).alias("chunk_id"), "text")
    return coverage(items, R.documents(spark, sf), Offline(), chunks=chunks).select("id", "modality", "verdict", "gate", "evidence")


@query(f"""SELECT c_mktsegment AS scope, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS INTEGER) AS place FROM customer GROUP BY 1""")
def o09_status(spark, sf):
    """The scopes of all rows, most first."""
    from quillspark.operators.aggregates import ranked, tally

    return ranked(tally(R.table(spark, sf, "customer").selectExpr("c_mktsegment AS scope"), "scope"), [F.col("n").desc(), F.col("scope")], "place")


@query("""WITH m AS (SELECT doc_id AS slug, sha256(text) AS h FROM documents) SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'unstamped' WHEN o_orderkey % 4 = 0 THEN 'stale' ELSE 'current' END AS stamp, o_orderkey % 6 > 0 AND o_orderkey % 4 > 0 AND o_custkey % 80 BETWEEN 1 AND 40 AS recovered FROM orders WHERE o_orderkey % (SELECT count(*) FROM m) IN (SELECT slug FROM m)""")
def o13_repaired_cites(spark, sf):
    """Rejected citations come back where the text is the one they were made for and they lie in it."""
    docs = R.documents(spark, sf)
    n = docs.count()
    pins = docs.select(F.col("slug").alias("doc"), F.sha2("text", 256).alias("text_sha256"))
    rows = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n).alias("doc"), F.concat((F.col("o_custkey") % 80).cast("string"), F.lit("")).alias("cite"))
    stamped = rows.join(pins, "doc").withColumn("doc_sha256", F.when(F.col("id") % 6 == 0, None).when(F.col("id") % 4 == 0, F.lit("old")).otherwise(F.col("text_sha256"))).drop("text_sha256")
    told = C.stale(stamped, pins)
    good = (F.col("stamp") == "current") & (T.citation(F.col("cite"), F.lit(40)) == "ok")
    return told.select("id", "stamp", good.alias("recovered"))


@query("""WITH o AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0), p AS (SELECT query_id, doc_id AS chunk_id, CAST('0x' || substr(sha256('Does this passage contribute to this obligation?' || chr(0) || o.text || chr(10) || chr(10) || d.text), 1, 2) AS INTEGER) % 3 AS a FROM o, documents d),
 r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, chunk_id) AS rank FROM p WHERE a > 0) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def f21_screened(spark, sf):
    """The stated obligations, every twentieth, asked about all documents, offline."""
    from quillspark.plans.review import screened
    from quillspark.provider import Offline

    asked = R.table(spark, sf, "benchmark").filter("item_id % 20 = 0").selectExpr("item_id AS id", "text")
    return screened(asked, R.documents(spark, sf).select(F.col("slug").alias("chunk_id"), "text"), Offline(("none", "contributes", "discharges")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' and ' || p_type ELSE NULL END AS pointer FROM part""")
def d31_pointers(spark, sf):
    json = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('"', p_name, '"') WHEN 1 THEN concat('["', p_name, '", "', p_type, '"]') ELSE 'null' END""")
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.pointer_text(json).alias("pointer"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'H' || o_custkey || ' (d:' || o_custkey || ')' WHEN 1 THEN 'H' || o_custkey WHEN 2 THEN 'the section at d:' || o_custkey || ', which has no heading' ELSE 'a section without a name' END AS named,
 CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '; ' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE '' END AS doubt FROM orders""")
def j39_doubts(spark, sf):
    rows = R.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 < 2 THEN concat('H', o_custkey) END AS h", "CASE WHEN o_orderkey % 4 IN (0, 2) THEN concat('d:', o_custkey) ELSE '' END AS at", "CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END AS a", "CASE WHEN o_orderkey % 2 = 0 THEN 'b' END AS b")
    return rows.select("id", T.named_section(F.col("h"), F.col("at")).alias("named"), T.in_doubt(F.col("a"), F.col("b")).alias("doubt"))


@query("""WITH s AS (SELECT url AS path, sha256(html) AS h, strlen(html) AS bytes, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM pages), b AS (SELECT *, substr(regexp_replace(lower(regexp_replace(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1), '[^A-Za-z0-9]+', '-', 'g')), '^-|-$', '', 'g'), 1, 40) AS b FROM s WHERE r = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY path) AS k FROM b) SELECT path, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS slug, h AS source_sha256, CAST(bytes AS INTEGER) AS bytes, count(*) OVER (PARTITION BY h) > 1 AS twice FROM n""")
def a02_init_corpus(spark, sf):
    """Pages as a tree of files: slugs, hashes, sizes and which contents come twice."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("url").orderBy("page_id")
    pages = R.table(spark, sf, "pages").withColumn("r", F.row_number().over(order)).filter("r = 1")
    return C.corpus_entries(pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")))


@query(f"WITH {LINES} SELECT slug, line_no, md5(text) AS text_md5 FROM lines")
def a09_load(spark, sf):
    """Every document's lines, read without a pin."""
    return L.to_lines(R.documents(spark, sf)).select("slug", "line_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT o_orderkey AS id, o_orderkey % 6 IN (0, 1) AS ok, o_custkey % 3 = 0 OR o_custkey % 3 = 1 AS empty, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 2 = 1 ELSE o_custkey % 4 = 1 END AS whole FROM orders""")
def e15_records(spark, sf):
    json = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN '{"of": 3, "answered": 3, "runs": 1, "not_read": [], "short": []}' WHEN 1 THEN '{"of": 3, "answered": 2, "runs": 1, "not_read": [{"heading": "x"}], "short": []}' WHEN 2 THEN '{"of": 3, "answered": 2, "runs": 1, "not_read": [], "short": []}'
      WHEN 3 THEN '{"of": "3", "answered": 3, "runs": 1, "not_read": [], "short": []}' WHEN 4 THEN '{"of": 3, "answered": 3, "not_read": [], "short": []}' ELSE '{"of": 3, "answered": 2, "runs": 1, "not_read": ["x"], "short": []}' END""")
    rows = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), json.alias("j"), F.expr("CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' \t' ELSE 'x' END").alias("x"),
        F.expr("CASE WHEN o_custkey % 4 = 0 THEN cast(o_orderkey % 2 AS int) END").alias("full"), F.expr("CASE WHEN o_custkey % 4 = 1 THEN array('a') WHEN o_custkey % 4 = 2 THEN cast(array() AS array<string>) END").alias("u"))
    return rows.select("id", N.answers_ok(F.col("j")).alias("ok"), N.empty_place(F.col("x")).alias("empty"), N.fully_read(F.col("full"), F.col("u")).alias("whole"))


# Operators over files' rows


@query("SELECT doc_id AS slug, true AS pinned FROM documents WHERE doc_id % 2 = 0")
def a08_load_pinned(spark, sf):
    """Documents with a pin of 12 digits of their text's hash."""
    docs = R.documents(spark, sf)
    pins = docs.filter("slug % 2 = 0").select("slug", F.substring(F.sha2("text", 256), 1, 12).alias("pin"))
    return C.load_pinned(docs, pins).select("slug", "pinned")


@query(f"WITH {LINES} SELECT slug, line_no FROM lines WHERE line_no % 9 <> 2")
def a10_content_lines(spark, sf):
    banner = F.when(F.col("line_no") % 9 == 2, F.concat(F.lit("  ########## slide "), F.col("line_no").cast("string"), F.lit(" ##########"))).otherwise(F.col("text"))
    return L.content_lines(R.lines(spark, sf).withColumn("text", banner)).select("slug", "line_no")


@query("""SELECT o_custkey AS slug, CASE o_custkey % 4 WHEN 1 THEN 'no sections' WHEN 2 THEN 'no document' WHEN 3 THEN 'no sections' END AS reason, CASE WHEN o_custkey % 4 = 0 THEN CAST(count(*) AS INTEGER) END AS sections FROM orders GROUP BY o_custkey""")
def a20_inventories(spark, sf):
    """Inventories as JSON: read ones with their sections, refused ones with the reason."""
    from quillspark.operators import synthesis as S

    section = F.to_json(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("heading"), F.lit("d:1-2").alias("locator"))))
    rows = R.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("slug")).agg(section.alias("s"))
    kind = F.col("slug") % 4
    json = F.when(kind == 0, F.concat(F.lit('{"doc": "d", "runs": 1, "sections": '), "s", F.lit("}"))).when(kind == 1, F.lit('{"doc": "d"}')).when(kind == 2, F.concat(F.lit('{"sections": '), "s", F.lit("}"))).otherwise(F.lit("{broken"))
    read, refused = S.read_inventories(rows.select("slug", json.alias("json")))
    return read.select("slug", F.lit(None).cast("string").alias("reason"), F.size("sections").alias("sections")).unionByName(refused.select("slug", "reason", F.lit(None).cast("int").alias("sections")))


@query("""SELECT p_partkey AS _row, p_name AS name, CASE WHEN p_size > 20 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS note, '' AS found FROM part""")
def b14_annotated(spark, sf):
    """A column set by row where it was empty, and a new one before another."""
    from quillspark.sources import files

    part = R.table(spark, sf, "part")
    register = part.selectExpr("p_partkey AS _row", "p_name AS name", "CASE WHEN p_size > 20 THEN p_brand ELSE '  ' END AS note")
    values = part.filter("p_partkey % 3 = 0").selectExpr("p_partkey AS _row", "p_type AS value")
    return files.insert_column(files.annotate(register, values, "note"), "found", "note").select("_row", "name", "note", "found")


@query("""SELECT 'D5-' || lpad(CAST(row_number() OVER (ORDER BY p_retailprice, p_partkey) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY p_retailprice, p_partkey) AS VARCHAR))) AS INTEGER), '0') AS id, p_partkey AS part FROM part""")
def b06_numbered(spark, sf):
    from quillspark.sources import files

    rows = R.table(spark, sf, "part").selectExpr("p_partkey AS part", "p_retailprice AS p")
    return files.numbered(rows, [F.col("p"), F.col("part")], "D5").select("id", "part")


@query(f"WITH {JUDGED} SELECT id, b IN ('unmet', 'partial', 'unverifiable') AS flagged FROM judged")
def e03_flagged(spark, sf):
    from quillspark.functions.scale import COVERAGE

    return R.judged(spark, sf).select("id", COVERAGE.flagged(F.col("b")).alias("flagged"))


ASKED = "'Judge.' || chr(0) || 'row ' || o_custkey"


@query(f"""SELECT o_orderkey AS id, sha256('offline' || chr(0) || {ASKED}) AS key, {OFFLINE.format(ASKED)} AS answer, 'ok' AS status FROM orders""")
def n02_answers(spark, sf):
    """Equal prompts are asked once, by the offline provider, and every row gets its answer."""
    from quillspark.provider import Offline, ask_all

    prompts = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Judge.").alias("system"), F.concat(F.lit("row "), F.col("o_custkey").cast("string")).alias("user"))
    return ask_all(prompts, Offline()).select("id", "key", "answer", "status")


@query(f"""WITH q AS (SELECT item_id AS qid, text AS question FROM benchmark), m(model) AS (VALUES ('a'), ('b')) SELECT qid, model, {OFFLINE.format("'Answer from the document alone, with quotes.' || chr(0) || 'The text.' || chr(10) || chr(10) || question")} AS answer FROM q, m""")
def n12_panel(spark, sf):
    """Two offline readers answer every question over one document."""
    from quillspark.plans.agents import panel
    from quillspark.provider import Offline

    questions = R.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return panel(questions, "The text.", {"a": Offline(), "b": Offline()}).select("qid", "model", "answer")


@query("""WITH c AS (SELECT s_suppkey AS id, 'C' || s_suppkey AS comment, 'P' || s_nationkey AS passage FROM supplier), o AS (SELECT *, """ + OFFLINE.format("'What would settle this comment? The document is withheld.' || chr(0) || comment") + """ AS outcome FROM c)
 SELECT id, outcome, """ + OFFLINE.format("'Does the passage show the outcome?' || chr(0) || comment || chr(10) || chr(10) || outcome || chr(10) || chr(10) || passage") + """ AS verdict FROM o""")
def n13_outcome_first(spark, sf):
    from quillspark.plans.agents import outcome_first
    from quillspark.provider import Offline

    rows = R.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "concat('C', s_suppkey) AS comment", "concat('P', s_nationkey) AS passage")
    return outcome_first(rows, Offline()).select("id", "outcome", "verdict")


LOOSE_WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id AS slug, {LOOSE_WORDS} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT {LOOSE_WORDS} AS w FROM benchmark WHERE text IS NOT NULL), v(n) AS (VALUES (2), (3)),
 d AS (SELECT DISTINCT n, sha256(array_to_string(w[1:n], ' ')) AS digest FROM b, v WHERE len(w) >= n), g AS (SELECT slug, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: sha256(array_to_string(w[i:i + n - 1], ' ')))) AS digest FROM w, v WHERE len(w) >= n)
 SELECT slug, n, digest, count(*) AS hits FROM g JOIN d USING (n, digest) GROUP BY ALL""")
def c14_denied_phrases(spark, sf):
    """Documents with the first two or three words of a benchmark passage, by digests of both lengths."""
    words = F.filter(F.split(T.loose(F.col("text")), " "), lambda w: w != "")
    phrases = R.table(spark, sf, "benchmark").select(words.alias("w"), F.explode(F.array(F.lit(2), F.lit(3))).alias("n")).filter(F.size("w") >= F.col("n")).select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"))
    return C.denied_phrases(R.documents(spark, sf), P.deny_phrases(phrases))

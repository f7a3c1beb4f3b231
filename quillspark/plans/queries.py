"""One query for each group of operators over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.functions.scale import COVERAGE, WEIGHTS, lookup, worst
from quillspark.operators import aggregates as A
from quillspark.operators import closure as C
from quillspark.operators import graph as G
from quillspark.operators import joins as J
from quillspark.operators import lines as L
from quillspark.operators.cells import upper_median
from quillspark.operators.durable import written
from quillspark.plans import relations as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = """lines AS (SELECT slug, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line_no, unnest(p) AS text
  FROM (SELECT doc_id AS slug, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM documents WHERE text <> ''))"""
JUDGED = f"judged AS (SELECT o_orderkey AS id, o_custkey AS ref, {R.FIRST} AS a, {R.SECOND} AS b FROM orders)"
READINGS = f"readings AS (SELECT l_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS model, l_partkey AS ref, {R.READING} AS verdict, l_suppkey, l_quantity FROM lineitem)"
RANKED = "CASE {} WHEN 'unmet' THEN 0 WHEN 'partial' THEN 1 WHEN 'met' THEN 2 END"
TERMS = ["idiot", "theation", "the of", "erhaps", "stupid"]
STOP = ", ".join(f"'{w}'" for w in T.RETRIEVAL_STOP)
CONCEPT = ", ".join(f"'{w}'" for w in T.CONCEPT_STOP)


def term_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(TERMS)], "id int, term string")


TERM_ROWS = "terms(id, term) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ")"


# 2.A and 2.C: lines, hashes, drift


@query(f"WITH {LINES} SELECT slug, line_no, md5(text) AS text_md5 FROM lines")
def d01_lines(spark, sf):
    return R.lines(spark, sf).select("slug", "line_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id AS slug, sha256(text) AS text_sha256, strlen(text) AS bytes, len(string_split(text, chr(10))) AS text_lines FROM documents")
def c01_manifest(spark, sf):
    return C.manifest(R.documents(spark, sf))


@query("""SELECT doc_id AS slug, CASE WHEN doc_id % 7 = 0 THEN 'never frozen' WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 3 = 0 THEN 'edited' ELSE 'as frozen' END AS state,
 CASE WHEN doc_id % 7 <> 0 THEN len(string_split(text, chr(10))) END AS lines_before, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 <> 0 THEN len(string_split(text, chr(10))) END AS lines_now FROM documents""")
def c03_drift(spark, sf):
    docs = R.documents(spark, sf)
    edited = docs.withColumn("text", F.when(F.col("slug") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return C.drift(C.manifest(docs.filter("slug % 7 <> 0")), C.manifest(edited.filter("slug % 7 = 0 OR slug % 5 <> 0")))


@query(f"""WITH {JUDGED} SELECT id, CASE WHEN id % 11 = 0 THEN 'unstamped' WHEN id % 4 = 0 THEN 'stale' ELSE 'current' END AS stamp FROM judged""")
def c07_stale_verdicts(spark, sf):
    rows = R.judged(spark, sf).select("id", F.col("id").alias("doc"), F.when(F.col("id") % 11 != 0, F.sha2(F.col("id").cast("string"), 256)).alias("doc_sha256"))
    pins = rows.select("doc", F.sha2(F.when(F.col("doc") % 4 == 0, F.lit("new")).otherwise(F.col("doc").cast("string")), 256).alias("text_sha256"))
    return C.stale(rows, pins).select("id", "stamp")


@query("""WITH g AS (SELECT doc_id AS slug, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
 e AS (SELECT slug, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' '))) AS gram, len(w) AS n FROM g),
 b AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' '))) AS gram FROM
   (SELECT list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 4)
 SELECT slug, count(*) AS hits FROM e WHERE n >= 4 AND gram IN (SELECT gram FROM b) GROUP BY slug""")
def c10_phrase_digests(spark, sf):
    words = F.filter(F.split(T.loose(F.col("text")), " "), lambda w: w != "")
    denied = R.table(spark, sf, "benchmark").select(F.explode(T.grams(words, 4)).alias("gram")).select(F.sha2("gram", 256).alias("digest"))
    return C.phrase_digests(R.documents(spark, sf), denied)


@query("""WITH s AS (SELECT url AS path, substr(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), '[^A-Za-z0-9]+', '-', 'g')), '^-|-$', '', 'g'), 1, 40) AS b FROM (SELECT DISTINCT url FROM pages))
 SELECT path, CASE WHEN r = 1 THEN b ELSE b || '-' || CAST(r AS VARCHAR) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY path) AS r FROM s)""")
def c06_slugs(spark, sf):
    return C.slugs(R.table(spark, sf, "pages").select(F.col("url").alias("path")).distinct())


# 2.D: segmentation


def cut_sql(rule: L.Cut) -> str:
    """The cuts as a recursion over line numbers: part, heading, start, lines and characters so far, and whether a part is full."""
    full = f"r >= {rule.rows}" + (f" OR c >= {rule.chars}" if rule.chars else "")
    full = f"(({full}) AND {'blank' if rule.blank else 'true'})"
    opens = f"(heads AND (r0 >= {rule.least} OR (r0 = 0 AND NOT titled0)))" if rule.keep_title else "heads"
    return f"""WITH RECURSIVE {LINES}, b AS (SELECT slug, line_no, text, trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^#+', '')) AS bare, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM lines),
 l AS (SELECT slug, line_no, text, bare, x = '' AS blank, x LIKE '#%' OR (length(bare) BETWEEN 1 AND {rule.short - 1} AND regexp_matches(bare, '{rule.title}')) AS heads FROM b),
 s(slug, n, k, heading, start, r, c, titled, full_now, body) AS (SELECT DISTINCT slug, 0, 0, '(front matter)', 1, 0, 0, false, false, false FROM l
  UNION ALL SELECT slug, line_no, CASE WHEN opens OR f THEN k + 1 ELSE k END, CASE WHEN opens THEN bare ELSE heading END, CASE WHEN opens OR f THEN line_no ELSE start END,
   CASE WHEN opens THEN 0 ELSE r0 + 1 END, CASE WHEN opens THEN 0 ELSE c0 + length(text) END, CASE WHEN opens THEN true ELSE titled0 END,
   CASE WHEN opens THEN false ELSE {full.replace('r >=', 'r0 + 1 >=').replace('c >=', 'c0 + length(text) >=')} END, NOT opens
   FROM (SELECT *, {opens} AS opens FROM (SELECT l.slug, l.line_no, l.text, l.bare, l.blank, l.heads, s.k, s.heading, s.start, s.full_now AS f, CASE WHEN s.full_now THEN 0 ELSE s.r END AS r0, CASE WHEN s.full_now THEN 0 ELSE s.c END AS c0, CASE WHEN s.full_now THEN false ELSE s.titled END AS titled0 FROM s JOIN l ON l.slug = s.slug AND l.line_no = s.n + 1) q) p),
 g AS (SELECT s.slug, k, min(s.heading) AS heading, min(s.start) AS start, coalesce(string_agg(l.text, chr(10) ORDER BY n) FILTER (body), '') AS text, bool_or(s.titled) AS titled, coalesce(bool_or(body AND NOT l.blank), false) AS said FROM s JOIN l ON l.slug = s.slug AND l.line_no = s.n GROUP BY s.slug, k),
 z AS (SELECT *, lead(start) OVER (PARTITION BY slug ORDER BY k) AS nxt FROM g), t AS (SELECT slug, max(line_no) AS last FROM l GROUP BY slug)
 SELECT z.slug, CAST(row_number() OVER (PARTITION BY z.slug ORDER BY k) - 1 AS INTEGER) AS chunk_id, heading, start, coalesce(nxt - 1, last) AS "end", text FROM z JOIN t ON t.slug = z.slug WHERE said {'OR titled' if rule.keep_title else ''}"""


def _headed(spark, sf):
    """Every seventh line begins as a heading would, so that there is something to cut at."""
    docs = R.documents(spark, sf)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 5, F.concat(F.lit("# "), F.substring(x, 1, 30))).when(i % 11 == 7, F.lit("3.1 Part")).when(i % 11 == 9, F.lit(" ")).otherwise(x))
    return docs.withColumn("text", F.array_join(lines, "\n"))


HEADED_TEXT = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 5 THEN '# ' || substr(x, 1, 30) WHEN (i - 1) % 11 = 7 THEN '3.1 Part' WHEN (i - 1) % 11 = 9 THEN ' ' ELSE x END), chr(10))"


def headed_sql(rule: L.Cut) -> str:
    return cut_sql(rule).replace("FROM documents WHERE text <> ''", f"FROM (SELECT doc_id, {HEADED_TEXT} AS text FROM documents WHERE text <> '')")


@query(headed_sql(L.CHUNKS))
def d02_chunks(spark, sf):
    return L.cut_documents(_headed(spark, sf), L.CHUNKS)


@query(headed_sql(L.WINDOWS))
def d03_windows(spark, sf):
    return L.cut_documents(_headed(spark, sf), L.WINDOWS)


@query(headed_sql(L.SECTIONS))
def d04_sections(spark, sf):
    return L.cut_documents(_headed(spark, sf), L.SECTIONS)


@query(f"WITH {LINES} SELECT slug, line_no, text FROM lines WHERE trim(text) <> '' AND (line_no - 1) % 9 >= 6")
def d05_unread_lines(spark, sf):
    """Sections of six lines with holes of three between them."""
    rows = R.lines(spark, sf)
    parts = rows.filter("line_no % 9 = 1").select("slug", F.col("line_no").alias("start"), (F.col("line_no") + 5).alias("end"))
    return L.unread(rows, parts)


@query(f"""WITH {LINES}, k AS (SELECT slug, line_no, line_no - row_number() OVER (PARTITION BY slug ORDER BY line_no) AS i FROM lines WHERE length(text) >= 200)
 SELECT slug, min(line_no) AS first, max(line_no) AS last FROM k GROUP BY slug, i""")
def d06_runs(spark, sf):
    return L.runs_of(R.lines(spark, sf).filter(F.char_length("text") >= 200))


FAMILIES = """CASE line_no % 5 WHEN 0 THEN 'AS-G' || (line_no % 40) || ' and ' WHEN 1 THEN 'IF-RO-' || (slug % 90) || ', ' WHEN 2 THEN 'see ND-' || (line_no % 7) || ' ' WHEN 3 THEN 'CF-' || line_no % 9 || ' PG-1 ' ELSE 'xND-1 ' END || text"""


@query(f"""WITH {LINES}, t AS (SELECT slug, {FAMILIES} AS text FROM lines), o AS (SELECT slug, unnest(list_concat(list_concat(regexp_extract_all(text, '\\b[A-Z]{{2,4}}-G-?\\d{{1,3}}\\b'), regexp_extract_all(text, '\\bIF-[A-Z]{{2,5}}-\\d{{1,3}}\\b')),
   list_concat(regexp_extract_all(text, '\\bND-\\d{{1,3}}\\b'), regexp_extract_all(text, '\\b(?:CF|PG)-\\d{{1,3}}\\b')))) AS identifier FROM t),
 e AS (SELECT slug, identifier, regexp_extract(identifier, '^[A-Z]+(?:-[A-Z]+)?') AS prefix, count(*) AS n FROM o GROUP BY ALL)
 SELECT slug, prefix, count(*) AS distinct_ids, sum(n) AS occurrences, count(*) FILTER (n = 1) AS singletons FROM e GROUP BY slug, prefix""")
def d18_identifier_classes(spark, sf):
    """Invented prose has no register identifiers, so one of the four families is written before each line."""
    return L.identifier_classes(L.identifiers(R.lines(spark, sf).withColumn("text", F.expr(FAMILIES))))


@query(f"""WITH {LINES}, w AS (SELECT slug, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\\-]*') AS w FROM lines),
 g AS (SELECT slug, lower(unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')))) AS phrase FROM w WHERE len(w) >= 2
   UNION ALL SELECT slug, lower(unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) FROM w WHERE len(w) >= 3)
 SELECT slug, phrase, count(*) AS uses FROM g WHERE len(list_filter(string_split(phrase, ' '), lambda x: length(x) < 3 OR x IN ('the', 'and', 'that'))) = 0 GROUP BY slug, phrase HAVING count(*) >= 5""")
def d20_phrases(spark, sf):
    return L.phrases(R.lines(spark, sf), ("the", "and", "that"))


@query(f"""WITH {LINES}, h AS (SELECT DISTINCT slug, greatest(line_no - 2, 1) AS a, line_no + 2 AS b FROM lines WHERE contains(text, 'idiot')),
 n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY slug ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
 g AS (SELECT *, sum(new) OVER (PARTITION BY slug ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n)
 SELECT slug, min(a) AS first, max(b) AS last FROM g GROUP BY slug, g""")
def d27_merged_windows(spark, sf):
    return L.merged_windows(R.lines(spark, sf).filter(F.contains("text", F.lit("idiot"))), 2)


@query("SELECT doc_id AS slug, len(list_filter(string_split(regexp_replace(text, '([.;])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences FROM documents")
def d16_sentences(spark, sf):
    return R.documents(spark, sf).select("slug", F.size(L.sentences(F.col("text"))).alias("sentences"))


@query(f"""WITH {LINES} SELECT slug, line_no, string_agg(text, chr(10)) OVER (PARTITION BY slug ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM lines""")
def h13_context(spark, sf):
    return L.windows(R.lines(spark, sf)).select("slug", "line_no", "context")


@query(f"""WITH {LINES}, p AS (SELECT slug, line_no, trim(text) AS t FROM lines),
 m AS (SELECT *, CASE WHEN length(t) <= 80 AND regexp_matches(t, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?[A-Z][^.!?]{{2,78}}$') AND NOT regexp_matches(t, '[,;:]$')
   AND len(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')) BETWEEN 2 AND 13 THEN line_no END AS h FROM p),
 n AS (SELECT *, max(h) OVER (PARTITION BY slug ORDER BY line_no RANGE BETWEEN 399 PRECEDING AND CURRENT ROW) AS heading_line FROM m)
 SELECT n.slug, n.line_no, p.t AS heading, n.heading_line FROM n LEFT JOIN p ON p.slug = n.slug AND p.line_no = n.heading_line""")
def f15_nearest_heading(spark, sf):
    return L.nearest_heading(R.lines(spark, sf))


# 2.F: joins


@query(f"WITH {LINES}, {TERM_ROWS} SELECT DISTINCT id, slug, line_no FROM lines JOIN terms ON contains(lower(text), term)")
def f01_contains(spark, sf):
    return J.contains_join(R.lines(spark, sf), term_table(spark)).select("id", "slug", "line_no").distinct()


@query("""WITH terms AS (SELECT p_partkey AS id, upper(p_name) AS term FROM part), lex AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term, p_type AS variant FROM part UNION SELECT DISTINCT p_name, p_brand FROM part),
 l AS (SELECT id, lower(term) AS term FROM terms), p AS (SELECT id, regexp_extract_all(term, '\\w+|\\W+') AS p FROM l),
 e AS (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM p)
 SELECT id, term FROM l UNION SELECT id, lower(variant) FROM l JOIN lex USING (term)
 UNION SELECT id, array_to_string(list_concat(list_concat(p[:i-1], [lower(variant)]), p[i+1:]), '') FROM e JOIN lex ON lex.term = p[i]""")
def f02_expand_terms(spark, sf):
    """Parts' names with the variants of their second word (types) and of the whole name (brands)."""
    part = R.table(spark, sf, "part")
    lexicon = part.select(F.split("p_name", " ")[1].alias("term"), F.col("p_type").alias("variant")).unionByName(part.select(F.col("p_name").alias("term"), F.col("p_brand").alias("variant"))).distinct()
    return J.expand_terms(part.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("term")), lexicon)


PAIR = f"""CASE WHEN a = '' AND b = '' THEN 'UNRANKABLE' WHEN a = '' OR b = '' THEN 'ONE JUDGE ONLY' WHEN a = b THEN 'AGREE'
 WHEN {RANKED.format('a')} IS NULL OR {RANKED.format('b')} IS NULL THEN 'UNRANKABLE' WHEN abs({RANKED.format('a')} - {RANKED.format('b')}) <= 1 THEN 'ADJACENT' ELSE 'DISAGREE' END"""


@query(f"WITH {JUDGED} SELECT id, a, b, {PAIR} AS agreement FROM judged")
def f03_two_judges(spark, sf):
    rows = R.judged(spark, sf)
    return J.compare_judges(rows.select("id", F.col("a").alias("verdict")), rows.select("id", F.col("b").alias("verdict")))


@query(f"""WITH {JUDGED}, x AS (SELECT id, CASE WHEN id % 10 <> 0 THEN a END AS a, CASE WHEN id % 9 <> 0 THEN b END AS b FROM judged WHERE id % 10 <> 0 OR id % 9 <> 0),
 c AS (SELECT *, CASE WHEN b IS NULL THEN 'only a' WHEN a IS NULL THEN 'only b' WHEN a = b THEN 'identical' ELSE 'moved' END AS change FROM x)
 SELECT id AS obligation, a, b, change, CASE WHEN change = 'moved' THEN coalesce(abs({RANKED.format('a')} - {RANKED.format('b')}), 9) END AS distance FROM c""")
def f04_compare_runs(spark, sf):
    rows = R.judged(spark, sf).withColumnRenamed("id", "obligation")
    return J.compare_runs(rows.filter("obligation % 10 <> 0").select("obligation", F.col("a").alias("verdict")), rows.filter("obligation % 9 <> 0").select("obligation", F.col("b").alias("verdict")))


@query(f"WITH {READINGS} SELECT id FROM readings GROUP BY id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM readings)")
def f05_answered_by_all(spark, sf):
    return J.answered_by_all(R.readings(spark, sf))


@query(f"WITH {READINGS} SELECT DISTINCT id, model FROM readings WHERE (id, model) NOT IN (SELECT id, model FROM readings WHERE l_quantity > 40)")
def f08_resume(spark, sf):
    rows = R.readings(spark, sf)
    return J.not_done(rows.select("id", "model").distinct(), rows.filter("l_quantity > 40").select("id", "model"), ["id", "model"])


SPANS = """spans AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 600) AS BIGINT) AS f, CAST(floor(epoch(ts) / 600) AS BIGINT) + CAST(floor(value) AS BIGINT) % 97 AS l, event_type FROM events)"""


@query(f"WITH {SPANS} SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.f <= b.l AND b.f <= a.l")
def f13_overlapping_spans(spark, sf):
    first = F.floor(F.unix_timestamp("ts") / 600)
    spans = R.table(spark, sf, "events").select("event_id", "user_id", "event_type", first.alias("f"), (first + F.floor("value") % 97).alias("l"))
    a = spans.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), F.col("f").alias("a_first"), F.col("l").alias("a_last"))
    b = spans.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b"), F.col("f").alias("b_first"), F.col("l").alias("b_last"))
    return J.overlapping(a, b, "user_id", 128).select("user_id", "a", "b")


@query("""SELECT e.event_id, e.user_id, m.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') e
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def f15_asof(spark, sf):
    events = R.table(spark, sf, "events")
    marks = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("last_signup"))
    return J.asof(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "last_signup").select("event_id", "user_id", "last_signup")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS item_id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score FROM q, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id DESC) AS rank FROM s) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 12""")
def f22_nearest_passages(spark, sf):
    """The whole set of queries: every twentieth vector, against all vectors."""
    items = R.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return J.top_k(items.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "embedding"), items, 12, digits=6)


@query("""WITH al(canonical, alias, pos) AS (VALUES ('ring', 'ring', 1), ('small', 'small', 2), ('small ring', 'small ring', 3), ('widget', 'widget', 4)), n AS (SELECT DISTINCT p_name AS name FROM part),
 r AS (SELECT name, canonical, row_number() OVER (PARTITION BY name ORDER BY length(alias) DESC, pos) AS r FROM n LEFT JOIN al ON contains(lower(name), alias)) SELECT name, canonical FROM r WHERE r = 1""")
def f26_longest_alias(spark, sf):
    aliases = spark.createDataFrame([("ring", "ring", 1), ("small", "small", 2), ("small ring", "small ring", 3), ("widget", "widget", 4)], "canonical string, alias string, pos int")
    return J.longest_alias(R.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct(), aliases)


LEXICAL = f"""d AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({STOP}) GROUP BY ALL),
 i AS (SELECT term, sqrt((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM d GROUP BY term),
 q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS term FROM benchmark) WHERE term NOT IN ({STOP}) GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, sum(idf * least(qf, tf)) AS score FROM q JOIN i USING (term) JOIN d USING (term) GROUP BY ALL)"""


def _lexical(spark, sf, k=None):
    """All scores, or those of the k best documents of each query."""
    q = R.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = R.spread(R.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return J.lexical_top(q, docs, k, digits=4) if k else J.lexical_scores(q, docs)


@query(f"WITH {LEXICAL}, r AS (SELECT query_id, chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, chunk_id DESC) AS rank FROM s) SELECT * FROM r WHERE rank <= 4")
def g06_lexical_retrieval(spark, sf):
    scored = _lexical(spark, sf, 4).withColumn("score", F.round("score", 4))
    return A.top_with_rest(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id").desc()], 4).drop("more")


@query(f"""WITH {LEXICAL}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, chunk_id DESC) AS rank FROM s),
 o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM s), u AS (SELECT * FROM r WHERE rank <= 20 UNION ALL SELECT * FROM o WHERE rank <= 20)
 SELECT query_id, chunk_id AS item_id, round(sum(1.0 / (60 + rank - 1)), 6) AS score FROM u GROUP BY ALL""")
def h16_rank_fusion(spark, sf):
    scored = written(_lexical(spark, sf).withColumn("score", F.round("score", 4)).withColumnRenamed("chunk_id", "item_id"), "scores")
    by = lambda *order: A.top_with_rest(scored, ["query_id"], list(order), 20).select("query_id", "item_id", "rank")
    return J.fused(by(F.col("score").desc(), F.col("item_id").desc()), by("item_id")).withColumn("score", F.round("score", 6))


# 2.G: aggregations


@query(f"""WITH {LINES}, {TERM_ROWS} SELECT t.term, coalesce(sum(CASE WHEN contains(lower(text), term) THEN (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) END), 0) AS uses,
 min(CASE WHEN contains(lower(text), term) THEN line_no END) AS first_line FROM terms t CROSS JOIN lines GROUP BY t.term""")
def g02_term_counts(spark, sf):
    return A.term_counts(R.lines(spark, sf), term_table(spark).select("term"))


@query(f"""WITH {READINGS}, h AS (SELECT id, verdict AS word, CAST(sum(l_quantity) AS BIGINT) AS hits FROM readings WHERE verdict <> 'met' OR l_quantity > 5 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits, word) AS r FROM h WHERE hits > 0),
 g AS (SELECT id, count(*) AS n, sum(hits) AS total, string_agg(word || 'x' || CAST(hits AS VARCHAR), ', ' ORDER BY hits, word) AS evidence FROM r WHERE r <= 3 GROUP BY id)
 SELECT id, CASE WHEN n >= 2 AND total >= 8 THEN 'contested' ELSE 'clear' END AS gate, CASE WHEN n >= 2 AND total >= 8 THEN evidence END AS evidence FROM (SELECT DISTINCT id FROM h) LEFT JOIN g USING (id)""")
def g04_absence_gate(spark, sf):
    rows = R.readings(spark, sf).filter("verdict <> 'met' OR l_quantity > 5")
    return A.absence_gate(rows.groupBy("id", F.col("verdict").alias("word")).agg(F.sum("l_quantity").cast("long").alias("hits")))


@query(f"WITH {READINGS} SELECT verdict, model, count(*) AS n FROM readings GROUP BY ALL")
def g07_tallies(spark, sf):
    return A.tally(R.readings(spark, sf), "verdict", "model")


@query(f"""WITH {JUDGED}, w AS (SELECT ref AS cluster, id, CASE a WHEN 'unmet' THEN 1.0 WHEN 'partial' THEN 0.6 WHEN 'unverifiable' THEN 0.4 ELSE 0 END AS w FROM judged),
 g AS (SELECT cluster, round(CAST(sum(w) AS DOUBLE), 6) AS strength, count(*) AS size, arg_max(id, (w, -id)) AS lead, min(id) AS f FROM w GROUP BY cluster)
 SELECT cluster, strength, size, lead, row_number() OVER (ORDER BY strength DESC, size DESC, f) AS rank FROM g""")
def g08_cluster_strength(spark, sf):
    return A.clusters(R.judged(spark, sf).select(F.col("ref").alias("cluster"), "id", F.col("id").alias("position"), F.col("a").alias("verdict")))


@query(f"""WITH {READINGS} SELECT id, count(*) AS judges, CASE WHEN min(verdict) = max(verdict) THEN 'AGREE' WHEN bool_or({RANKED.format('verdict')} IS NULL) THEN 'UNRANKABLE'
 WHEN max({RANKED.format('verdict')}) - min({RANKED.format('verdict')}) <= 1 THEN 'ADJACENT' ELSE 'DISAGREE' END AS agreement FROM readings GROUP BY id""")
def g10_agreement(spark, sf):
    return A.agreement(R.readings(spark, sf))


@query("""WITH l AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN 'Every valve closes' ELSE 'A valve closes' END AS requirement, CASE l_linenumber % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'rebuttal' ELSE 'materiality' END AS lens,
   l_returnflag = 'R' AS refuted, l_tax > 0.07 AS failed FROM lineitem),
 f AS (SELECT id, requirement, lens, max(refuted) AS refuted, max(failed) AS failed FROM l GROUP BY ALL),
 g AS (SELECT id, requirement, count(*) FILTER (lens <> 'materiality' AND refuted) AS refutations, coalesce(bool_or(lens <> 'materiality' AND failed), false) AS any_failed FROM f GROUP BY ALL)
 SELECT id, refutations, requirement LIKE 'Every%' AS universal, CASE WHEN any_failed THEN 'contested' WHEN refutations >= 2 AND requirement NOT LIKE 'Every%' THEN 'refuted' WHEN refutations >= 1 THEN 'contested' ELSE 'confirmed' END AS status FROM g""")
def g12_verification(spark, sf):
    rows = R.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", "CASE WHEN l_orderkey % 3 = 0 THEN 'Every valve closes' ELSE 'A valve closes' END AS requirement",
        "CASE l_linenumber % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'rebuttal' ELSE 'materiality' END AS lens", "l_returnflag = 'R' AS refuted", "l_tax > 0.07 AS failed")
    return A.verification(rows.groupBy("id", "requirement", "lens").agg(F.max("refuted").alias("refuted"), F.max("failed").alias("failed")))


@query(f"""WITH {JUDGED}, f AS (SELECT a IN ('unmet', 'partial', 'unverifiable') AS x, b IN ('unmet', 'partial', 'unverifiable') AS y FROM judged),
 c AS (SELECT count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (NOT x AND y) AS fn, count(*) FILTER (NOT x AND NOT y) AS tn FROM f) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def g14_confusion(spark, sf):
    return R.judged(spark, sf).agg(*A.confusion(COVERAGE.flagged(F.col("a")), COVERAGE.flagged(F.col("b"))))


@query(f"""WITH {JUDGED}, n AS (SELECT ref, id, CASE WHEN b = '' THEN 'not_applicable' ELSE b END AS v FROM judged),
 g AS (SELECT ref, max(CASE v WHEN 'met' THEN 0 WHEN 'unverifiable' THEN 1 WHEN 'partial' THEN 2 WHEN 'unmet' THEN 3 END) AS top, arg_min(v, id) AS f FROM n GROUP BY ref)
 SELECT ref, CASE WHEN f = 'not_applicable' AND coalesce(top = 0, true) THEN 'not_applicable' ELSE CASE top WHEN 0 THEN 'met' WHEN 1 THEN 'unverifiable' WHEN 2 THEN 'partial' WHEN 3 THEN 'unmet' END END AS verdict FROM g""")
def g15_worst_verdict(spark, sf):
    rows = R.judged(spark, sf).withColumn("v", F.when(F.col("b") == "", "not_applicable").otherwise(F.col("b")))
    return rows.groupBy("ref").agg(worst(F.col("v"), F.col("id")).alias("verdict"))


@query(f"""WITH {LEXICAL}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, chunk_id DESC) AS rank FROM s),
 g AS (SELECT i.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark i JOIN documents d ON contains(d.text, i.text))
 SELECT g.query_id, count(r.rank) AS found, count(*) AS wanted, count(r.rank) / count(*) AS recall, count(r.rank) / 12 AS precision, count(r.rank) = count(*) AS covered FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id AND r.rank <= 12 GROUP BY g.query_id""")
def g19_recall_at_k(spark, sf):
    scored = _lexical(spark, sf, 12).withColumn("score", F.round("score", 4)).withColumnRenamed("chunk_id", "item_id")
    ranked = A.top_with_rest(scored, ["query_id"], [F.col("score").desc(), F.col("item_id").desc()], 12)
    items = R.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    gold = J.holding(R.spread(R.table(spark, sf, "documents").select("doc_id", "text")), items).select("query_id", F.col("doc_id").alias("item_id"))
    return A.recall_at(ranked, gold, 12)


@query(f"WITH {READINGS}, n AS (SELECT model, verdict, count(*) AS n FROM readings GROUP BY ALL) SELECT * FROM n WHERE n = (SELECT max(m.n) FROM n m WHERE m.model = n.model)")
def g29_majority_with_ties(spark, sf):
    return A.majority(R.readings(spark, sf), "verdict", "model")


@query(f"WITH {READINGS} SELECT l_suppkey, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM readings GROUP BY l_suppkey")
def g22_upper_median(spark, sf):
    return upper_median(R.readings(spark, sf), "l_quantity", "l_suppkey")


# 2.H and 2.B: order, first rows, pivots


@query(f"""WITH {READINGS}, f AS (SELECT DISTINCT ref, id FROM readings WHERE verdict = 'unmet'), r AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY id) AS rank, greatest(count(*) OVER (PARTITION BY ref) - 3, 0) AS more FROM f) SELECT * FROM r WHERE rank <= 3""")
def h09_first_locators(spark, sf):
    rows = R.readings(spark, sf).filter("verdict = 'unmet'").select("ref", "id").distinct()
    return A.top_with_rest(rows, ["ref"], ["id"], 3)


@query(f"WITH {READINGS}, r AS (SELECT ref, id, l_quantity, row_number() OVER (PARTITION BY ref ORDER BY l_quantity DESC, id, model, l_suppkey) AS r FROM readings) SELECT ref, id, l_quantity FROM r WHERE r = 1")
def h10_best_nomination(spark, sf):
    return A.first_by_order(R.readings(spark, sf), ["ref"], [F.col("l_quantity").desc(), "id", "model", "l_suppkey"]).select("ref", "id", "l_quantity")


@query(f"""WITH {JUDGED}, k(k) AS (VALUES (3), (5), (10)), r AS (SELECT row_number() OVER (ORDER BY id DESC) AS rank, a = b AS hit FROM judged) SELECT k, count(*) FILTER (hit) AS hits, count(*) AS shown FROM r JOIN k ON rank <= k GROUP BY k""")
def h18_precision_at_k(spark, sf):
    first = R.judged(spark, sf).orderBy(F.col("id").desc()).limit(10).select("id", (F.col("a") == F.col("b")).alias("hit"))
    return A.precision_at(first.withColumn("rank", F.row_number().over(W.orderBy(F.col("id").desc()))))


@query(f"WITH {READINGS} SELECT id, " + ", ".join(f"max(CASE WHEN model = '{k}' THEN verdict END) AS \"{k}\"" for k in range(1, 8)) + " FROM readings GROUP BY id")
def b16_evaluators(spark, sf):
    return A.evaluators(R.readings(spark, sf), [str(k) for k in range(1, 8)])


# 2.J: scalars


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS folded, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS loose,
 regexp_replace(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:9], ' '), '^[ ,;:.]+|[ ,;:.]+$', '', 'g') AS searchable,
 CASE WHEN length(text) > 32 THEN substr(text, 1, 29) || '...' ELSE text END AS shortened FROM documents""")
def j01_folds(spark, sf):
    t = F.col("text")
    return R.spread(R.table(spark, sf, "documents")).select("doc_id", T.fold(t).alias("folded"), T.loose(t).alias("loose"), T.searchable(t).alias("searchable"), T.shortened(t).alias("shortened"))


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}'), lambda x: x NOT IN ({STOP})) AS w, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({CONCEPT}))) AS c FROM documents)
 SELECT doc_id, len(w) AS n_terms, len(c) AS n_concepts FROM t""")
def j15_tokens(spark, sf):
    t = F.col("text")
    return R.spread(R.table(spark, sf, "documents")).select("doc_id", F.size(T.terms(t)).alias("n_terms"), F.size(T.concepts(t)).alias("n_concepts"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({CONCEPT}))) AS c FROM documents),
 p AS (SELECT a.doc_id, a.c AS a, b.c AS b FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS overlap, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard FROM p""")
def j19_similarities(spark, sf):
    t = R.spread(R.table(spark, sf, "documents")).select("doc_id", T.concepts(F.col("text")).alias("c"))
    p = t.select("doc_id", F.col("c").alias("a")).join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("c").alias("b")), "doc_id")
    return p.select("doc_id", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("""WITH n AS (SELECT DISTINCT CAST(p_size AS INTEGER) * 37 % 700 + 1 AS n FROM part) SELECT n, CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, n AS back FROM n""")
def j23_columns(spark, sf):
    n = R.table(spark, sf, "part").select((F.col("p_size").cast("int") * 37 % 700 + 1).alias("n")).distinct()
    lettered = n.withColumn("letters", T.column_letters(F.col("n")))
    return lettered.withColumn("back", T.column_number(F.col("letters")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def j29_dates(spark, sf):
    return R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.iso_date(F.date_format("o_orderdate", "MMMM d, yyyy")).cast("string").alias("d"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, count(*) AS copies, 'doc' || CAST(l_suppkey AS VARCHAR) AS slug, l_linenumber AS first, l_linenumber + CAST(l_quantity AS INTEGER) AS last FROM lineitem GROUP BY ALL""")
def j36_locators(spark, sf):
    rows = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.format_string("doc%d:%d-%d", "l_suppkey", "l_linenumber", F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("at"))
    return rows.select("id", "n", T.locator(F.col("at")).alias("p")).groupBy("id", "n", "p.slug", "p.first", "p.last").agg(F.count("*").alias("copies"))


STATE = "CASE o_custkey % 5 WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'CHANGED' WHEN 2 THEN 'STILL ABSENT' WHEN 3 THEN 'REMOVED' ELSE 'ABSENT' END"
SAID = "CASE o_orderkey % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'in progress' WHEN 2 THEN 'new' ELSE 'unknown' END"


@query(f"""WITH s AS (SELECT o_orderkey AS id, {STATE} AS state, lower({SAID}) AS said FROM orders)
 SELECT id, CASE WHEN said = 'completed' AND state IN ('UNCHANGED', 'STILL ABSENT') THEN 'DISPUTED' WHEN said = 'completed' AND state IN ('CHANGED', 'ADDED', 'REMOVED') THEN 'SUPPORTED'
 WHEN said = 'in progress' AND state IN ('UNCHANGED', 'STILL ABSENT') THEN 'NO MOVEMENT' WHEN said = 'new' AND state IN ('CHANGED', 'ADDED', 'REMOVED') THEN 'UNCLAIMED CHANGE' END AS comment FROM s""")
def j33_claims_and_states(spark, sf):
    rows = R.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{STATE} AS state", f"{SAID} AS said")
    return rows.select("id", T.adjudication(F.col("state"), F.col("said")).alias("comment"))


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || text) AS key FROM documents")
def n03_cache_keys(spark, sf):
    return R.spread(R.table(spark, sf, "documents")).select("doc_id", T.cache_key("source", "lang", "text").alias("key"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(?:every|each|all|any|no)\\s+\\w+') AS universal, regexp_matches(text, '(?i)\\bset to\\b|=\\s*[-+]?\\d') AS assigned FROM documents")
def e07_predicates(spark, sf):
    t = F.col("text")
    return R.spread(R.table(spark, sf, "documents")).select("doc_id", t.rlike(T.UNIVERSAL).alias("universal"), t.rlike(r"(?i)\bset to\b|=\s*[-+]?\d").alias("assigned"))


@query("""WITH q AS (SELECT doc_id, lower(trim(regexp_replace(substr(text, 20, 60), '\\s+', ' ', 'g'))) AS quote, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS passage FROM documents)
 SELECT doc_id, quote <> '' AND contains(passage, quote) AS quoted FROM q""")
def e11_quotes(spark, sf):
    from quillspark.plans.review import quote_check

    rows = R.spread(R.table(spark, sf, "documents")).select("doc_id", F.substring("text", 20, 60).alias("quote"), F.col("text").alias("passage"))
    return quote_check(rows).select("doc_id", "quoted")


# 2.K and closure


REVISIONS = f"""{LINES}, {TERM_ROWS}, o AS (SELECT DISTINCT id, slug * 100000 + line_no AS n, text FROM lines JOIN terms ON contains(lower(text), term) WHERE slug % 20 <> 3),
 w AS (SELECT DISTINCT id, slug * 100000 + line_no AS n, text FROM lines JOIN terms ON contains(lower(text), term) WHERE slug % 20 <> 4)"""


@query(f"""WITH {REVISIONS}, c AS (SELECT t.id, (SELECT count(*) FROM o WHERE o.id = t.id) AS old_lines, (SELECT count(*) FROM w WHERE w.id = t.id) AS new_lines FROM terms t)
 SELECT id, old_lines, new_lines, CASE WHEN old_lines > 120 OR new_lines > 120 THEN 'TOO BROAD' WHEN old_lines + new_lines = 0 THEN 'STILL ABSENT' WHEN new_lines = 0 THEN 'REMOVED' WHEN old_lines = 0 THEN 'ADDED'
 WHEN (SELECT list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY n) FROM o WHERE o.id = c.id) = (SELECT list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY n) FROM w WHERE w.id = c.id) THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM c""")
def j32_closure(spark, sf):
    """Two revisions of the corpus as one long document each; a line's number is its document's and its own."""
    rows = R.lines(spark, sf)
    number = (F.col("slug") * 100000 + F.col("line_no")).alias("line_no")
    terms = term_table(spark)
    findings = terms.select("id", F.lit(True).alias("absence"))
    out = C.closure(findings, terms, rows.filter("slug % 20 <> 3").select(number, "text"), rows.filter("slug % 20 <> 4").select(number, "text"))
    return out.select("id", "state", "old_lines", "new_lines")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + s_suppkey % 2) % 25 AS dst FROM supplier WHERE s_nationkey <> (s_nationkey * 7 + s_suppkey % 2) % 25),
 p(s, here, path) AS (SELECT src, dst, [src, dst] FROM e WHERE dst > src UNION ALL SELECT p.s, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.here WHERE len(p.path) < 8 AND e.dst > p.s AND NOT list_contains(p.path, e.dst))
 SELECT array_to_string(list_sort(path), ',') AS nodes, min(array_to_string(path, ',')) AS path FROM p WHERE (here, s) IN (SELECT src, dst FROM e) GROUP BY 1""")
def k03_cycles(spark, sf):
    edges = R.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey") % 2) % 25).cast("long").alias("dst"))
    e = edges.filter("src <> dst").distinct()
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    found = G.cycles(e)
    return found.select(shown(F.col("nodes")).alias("nodes"), shown(F.col("path")).alias("path"))


@query("""WITH RECURSIVE v AS (SELECT label AS grp, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
 near AS (SELECT a.grp, a.i, list(b.i) AS n FROM v a JOIN v b ON a.grp = b.grp AND b.i < a.i AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.55 GROUP BY a.grp, a.i),
 r(grp, i, labels, top) AS (SELECT grp, 0, CAST([] AS BIGINT[]), CAST(-1 AS BIGINT) FROM v GROUP BY grp
  UNION ALL SELECT grp, i, list_append(labels, coalesce(m, top + 1)), CASE WHEN m IS NULL THEN top + 1 ELSE top END FROM (SELECT r.grp, CAST(v.i AS INTEGER) AS i, r.labels, r.top, list_min(list_transform(n, lambda j: r.labels[j])) AS m FROM r JOIN v ON v.grp = r.grp AND v.i = r.i + 1 LEFT JOIN near ON near.grp = v.grp AND near.i = v.i) q)
 SELECT v.grp, v.id, v.id AS position, CAST(r.labels[v.i] AS INTEGER) AS cluster FROM v JOIN r ON r.grp = v.grp AND r.i = v.i""")
def k01_greedy_clusters(spark, sf):
    """Vectors in order of id join the first cluster near enough, within each label."""
    rows = R.table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").alias("position"), "embedding")
    return G.greedy_groups(rows)


@query()
def k13_diffs(spark, sf):
    """Each document against its text without every fifth line."""
    docs = R.documents(spark, sf).select(F.col("slug").alias("id"), F.split("text", "\n").alias("old"))
    return G.diffs(docs.withColumn("new", F.filter("old", lambda x, i: i % 5 != 4)))


@query("""WITH h AS (SELECT item_id, list_transform(range(0, 32), lambda i: CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 255.0 - 0.5) AS r FROM benchmark)
 SELECT item_id, array_to_string(list_transform(r, lambda v: CAST(CAST(round(v / sqrt(list_sum(list_transform(r, lambda u: u * u))) * 1e6) AS BIGINT) AS VARCHAR)), ' ') AS vector FROM h""")
def n06_offline_vectors(spark, sf):
    """In millionths."""
    vector = F.transform(T.offline_vector(F.col("text")), lambda v: F.round(v * 1e6).cast("long").cast("string"))
    return R.table(spark, sf, "benchmark").select("item_id", F.array_join(vector, " ").alias("vector"))


@query(f"""WITH {JUDGED} SELECT id, a, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'absent' ELSE 'unverifiable' END ELSE 'present' END AS status FROM judged""")
def o00_absence_rule(spark, sf):
    from quillspark.plans.review import absent

    rows = R.judged(spark, sf).select("id", (F.col("id") % 2).alias("slug"), "a")
    complete = spark.createDataFrame([(0, True), (1, False)], "slug long, complete boolean")
    return absent(rows, rows.filter("id % 3 <> 0"), ["id"], complete).select("id", "a", "status")


@query(f"""WITH {JUDGED}, {LINES} SELECT verdict, count(*) AS n, round(sum(w), 4) AS strength FROM (SELECT a AS verdict, CASE a WHEN 'unmet' THEN 1.0 WHEN 'partial' THEN 0.6 ELSE 0.0 END AS w FROM judged) GROUP BY verdict""")
def flagship_verdict_strength(spark, sf):
    rows = R.judged(spark, sf).withColumn("w", lookup(F.col("a"), WEIGHTS, 0.0))
    return rows.groupBy(F.col("a").alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("strength"))

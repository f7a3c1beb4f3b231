"""Queries over what an inventory comes to: owners, gaps, orphans, similar sets, and which finding reaches which planted item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import attribution as B
from quillspark.operators import sets as E
from quillspark.operators import synthesis as S
from quillspark.plans import relations as R
from quillspark.plans.queries import CONCEPT, query

WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}'), lambda x: x NOT IN (" + CONCEPT + ")))"
RAW = "list_transform(range(0, 32), lambda i: CAST('0x' || substr(sha256(label), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 255.0 - 0.5)"


def grouped(name: str, source: str) -> str:
    """CTEs that make name (key, id, cluster) of source (key, id, label): the first row that a chain of ever earlier near labels leads to."""
    return f"""{name}_l AS (SELECT label, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS v FROM (SELECT DISTINCT label, {RAW} AS r FROM {source})),
 {name}_n AS (SELECT a.key, a.id AS i, b.id AS j FROM {source} a JOIN {source} b ON a.key = b.key AND b.id < a.id JOIN {name}_l x ON x.label = a.label JOIN {name}_l y ON y.label = b.label WHERE list_dot_product(x.v, y.v) >= 0.62),
 {name}_r(key, i, m) AS (SELECT key, id, id FROM {source} UNION SELECT r.key, r.i, n.j FROM {name}_r r JOIN {name}_n n ON n.key = r.key AND n.i = r.m),
 {name} AS (SELECT key, i AS id, min(m) AS cluster FROM {name}_r GROUP BY ALL)"""


def vectors(*labels: DataFrame) -> DataFrame:
    """label and its offline vector, for all labels of one-column frames."""
    every = labels[0].toDF("label")
    for x in labels[1:]:
        every = every.unionByName(x.toDF("label"))
    return every.distinct().withColumn("embedding", T.offline_vector(F.col("label")))


# Parts as an inventory: a brand is a document, a part an entry, a deferral or an output of it.
NAMES = ["sensor fabric", "hydrology", "alerting", "archive", "gateway"]
NODE = "CASE {0} WHEN 1 THEN 'fabric sensor' WHEN 2 THEN 'hydrology' WHEN 3 THEN 'alerting' WHEN 4 THEN 'archive' ELSE 'gateway' END"
ENTRIES = "SELECT p_brand AS slug, p_partkey AS id, CASE WHEN p_size < 10 THEN p_type ELSE p_type || ' ' || split_part(p_name, ' ', 2) END AS capability, split_part(p_name, ' ', 1) AS action, 'unit ' || substr('abcdefghij', 1 + p_size % 5, 3) AS owner FROM part WHERE p_size % 4 > 0"
D5 = f"""e AS ({ENTRIES}), ec AS (SELECT slug AS key, id, capability AS label FROM e), {grouped('cap', 'ec')},
 ea AS (SELECT e.slug || '/' || cap.cluster AS key, e.id, e.action AS label FROM e JOIN cap ON cap.key = e.slug AND cap.id = e.id), {grouped('act', 'ea')},
 d5 AS (SELECT e.slug, cap.cluster AS cap, act.cluster AS act, count(DISTINCT e.owner) AS owners FROM e JOIN cap ON cap.key = e.slug AND cap.id = e.id JOIN act ON act.key = e.slug || '/' || cap.cluster AND act.id = e.id GROUP BY ALL HAVING owners > 1),
 dual AS (SELECT d5.slug, x.capability AS label, y.action, owners FROM d5 JOIN e x ON x.id = d5.cap JOIN e y ON y.id = d5.act)"""
DEFERRED = "SELECT p_brand AS slug, p_partkey AS id, p_type AS capability, 1 + p_size % 5 AS a, 1 + (p_size * 3 + p_partkey) % 5 AS b FROM part WHERE p_partkey % 3 = 0"
D6 = f"""f AS ({DEFERRED}), fc AS (SELECT slug AS key, id, capability AS label FROM f), {grouped('grp', 'fc')},
 g AS (SELECT DISTINCT f.slug, grp.cluster, {NODE.format('a')} AS src, {NODE.format('b')} AS dst FROM f JOIN grp ON grp.key = f.slug AND grp.id = f.id WHERE a <> b),
 w(slug, cluster, s, here, path) AS (SELECT slug, cluster, src, dst, [src, dst] FROM g WHERE dst > src UNION ALL SELECT w.slug, w.cluster, w.s, g.dst, list_append(w.path, g.dst) FROM w JOIN g ON g.slug = w.slug AND g.cluster = w.cluster AND g.src = w.here WHERE len(w.path) < 8 AND g.dst > w.s AND NOT list_contains(w.path, g.dst)),
 rounds AS (SELECT w.slug, w.cluster, min(w.path) AS path FROM w JOIN g ON g.slug = w.slug AND g.cluster = w.cluster AND g.src = w.here AND g.dst = w.s GROUP BY ALL),
 h AS (SELECT DISTINCT f.slug, grp.cluster FROM f JOIN grp ON grp.key = f.slug AND grp.id = f.id),
 labels AS (SELECT label, {RAW} AS r FROM (SELECT DISTINCT capability AS label FROM f UNION SELECT DISTINCT capability FROM ({ENTRIES}) WHERE capability IS NOT NULL)),
 gaps AS (SELECT h.slug, x.capability AS label, array_to_string(list_append(path, path[1]), ' -> ') AS cycle, CASE WHEN path IS NOT NULL OR h.slug LIKE '%1%' THEN 'finding' ELSE 'doubtful' END AS status
  FROM h JOIN f x ON x.id = h.cluster LEFT JOIN rounds ON rounds.slug = h.slug AND rounds.cluster = h.cluster
  WHERE path IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ({ENTRIES}) o JOIN labels y ON y.label = o.capability JOIN labels z ON z.label = x.capability WHERE o.slug = h.slug
   AND list_dot_product(y.r, z.r) / (sqrt(list_dot_product(y.r, y.r)) * sqrt(list_dot_product(z.r, z.r))) >= 0.62))"""
D8 = f"""p AS (SELECT p_brand AS slug, p_partkey AS id, p_name AS value FROM part WHERE p_partkey % 2 = 0), pc AS (SELECT slug AS key, id, value AS label FROM p), {grouped('outs', 'pc')},
 pw AS (SELECT p.slug, outs.cluster, list_distinct(flatten(list({WORDS.format('p.value')}))) AS w FROM p JOIN outs ON outs.key = p.slug AND outs.id = p.id GROUP BY ALL),
 cw AS (SELECT DISTINCT p_brand AS slug, {WORDS.format("p_name || ' extra'")} AS w FROM part WHERE p_partkey % 3 = 1),
 lone AS (SELECT pw.slug, x.value AS label, CASE WHEN pw.slug LIKE '%1%' THEN 'finding' ELSE 'doubtful' END AS status FROM pw JOIN p x ON x.id = pw.cluster
  WHERE NOT EXISTS (SELECT 1 FROM cw WHERE cw.slug = pw.slug AND len(list_intersect(pw.w, cw.w)) / least(len(pw.w), len(cw.w)) >= 0.6))"""


def _inventory(spark, sf) -> dict[str, DataFrame]:
    part = R.table(spark, sf, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    own = [F.col("p_brand").alias("slug"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("position")]
    name = F.array(*[F.lit(x) for x in NAMES])
    capability = F.when(F.col("p_size") < 10, F.col("p_type")).otherwise(F.concat_ws(" ", F.col("p_type"), second))
    entries = part.filter("p_size % 4 > 0").select(*own, capability.alias("capability"), first.alias("action"), F.expr("'unit ' || substr('abcdefghij', 1 + p_size % 5, 3)").alias("owner"), F.lit("owns").alias("polarity"))
    to = F.element_at(name, (1 + (F.col("p_size") * 3 + F.col("p_partkey")) % 5).cast("int"))
    deferrals = part.filter("p_partkey % 3 = 0").select(*own, F.col("p_type").alias("capability"), F.concat((1 + F.col("p_size") % 5).cast("string"), F.lit(".2 Handed on")).alias("heading"), to.alias("to"))
    sections = part.select(F.col("p_brand").alias("slug")).distinct().select("slug", F.posexplode(name).alias("position", "owner")).select("slug", "position", F.concat((F.col("position") + 1).cast("string"), F.lit(". "), "owner").alias("heading"))
    produced = part.filter("p_partkey % 2 = 0").select(*own, F.col("p_name").alias("value"))
    consumed = part.filter("p_partkey % 3 = 1").select(*own, F.concat("p_name", F.lit(" extra")).alias("value"))
    return {
        "entries": entries, "deferrals": deferrals, "produced": produced, "consumed": consumed, "sections": sections, "read": part.selectExpr("p_brand AS slug", "p_brand LIKE '%1%' AS complete").distinct(),
        "vectors": vectors(entries.select("capability"), entries.select("action"), deferrals.select("capability"), produced.select("value")),
    }


@query(f"""WITH RECURSIVE src AS (SELECT p_brand AS key, p_partkey AS id, p_name || ' ' || p_type AS label FROM part), {grouped('g', 'src')},
 f AS (SELECT key, cluster AS first, row_number() OVER (PARTITION BY key ORDER BY cluster) - 1 AS n FROM (SELECT DISTINCT key, cluster FROM g)) SELECT g.key, g.id, CAST(f.n AS INTEGER) AS cluster FROM g JOIN f ON f.key = g.key AND f.first = g.cluster""")
def k02_concept_groups(spark, sf):
    """Parts of a brand by the cosine of their names' vectors, in rounds."""
    rows = R.table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return S.concept_rows(rows, vectors(rows.select("label")))


@query(f"WITH RECURSIVE {D5} SELECT slug, label, action, owners FROM dual")
def k05_dual_owners(spark, sf):
    """Capabilities of a document by concept, then their actions: what two owners claim."""
    x = _inventory(spark, sf)
    return S.dual_owners(x["entries"], x["vectors"]).select("slug", "label", "action", "owners")


@query(f"WITH RECURSIVE {D6} SELECT slug, label, coalesce(cycle, '') AS cycle, status FROM gaps")
def k06_ownership_gaps(spark, sf):
    """Capabilities that go round between components, and those that are passed on and owned by nobody."""
    x = _inventory(spark, sf)
    return S.ownership_gaps(x["deferrals"], x["entries"], x["read"], x["sections"], x["vectors"]).select("slug", "label", F.coalesce("cycle", F.lit("")).alias("cycle"), "status")


@query(f"""WITH RECURSIVE {D5}, {D6}, {D8}, u AS (SELECT 'D5' AS kind, slug || '/' || label || '/' || action AS key, 'finding' AS status FROM dual UNION ALL SELECT 'D6', slug || '/' || label || coalesce('/cycle: ' || cycle, ''), status FROM gaps UNION ALL SELECT 'D8', slug || '/' || label, status FROM lone)
 SELECT kind || '-' || lpad(CAST(row_number() OVER (PARTITION BY kind ORDER BY key) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY kind ORDER BY key) AS VARCHAR))) AS INTEGER), '0') AS id, kind, key, status FROM u""")
def o07_synthesis(spark, sf):
    """What two own, what goes round or nobody owns, and what nobody consumes, by concept groups of each document."""
    from quillspark.plans.synthesis import candidates

    x = _inventory(spark, sf)
    return candidates(x["entries"], x["deferrals"], x["produced"], x["consumed"], x["read"], x["sections"], x["vectors"])


@query(f"""WITH w AS (SELECT p_partkey AS id, p_size, {WORDS.format("p_name || ' ' || p_type || ' ' || p_brand")} AS w FROM part)
 SELECT id FROM w p WHERE p_size > 25 AND len(w) > 0 AND NOT EXISTS (SELECT 1 FROM w c WHERE c.p_size <= 25 AND len(c.w) > 0 AND len(list_intersect(p.w, c.w)) / least(len(p.w), len(c.w)) >= 0.8)""")
def k07_orphans(spark, sf):
    """Every part is an output or, where it is small, an input."""
    parts = R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return E.orphans(parts.filter("p_size > 25").select("id", "text"), parts.filter("p_size <= 25").select("text"), 0.8)


@query(f"""WITH t AS (SELECT p_brand || '/' || p_size AS grp, p_partkey AS id, {WORDS.format("p_name || ' ' || p_type")} AS w FROM part)
 SELECT a.grp, a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM t a JOIN t b ON a.grp = b.grp AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.5""")
def f19_similar_pairs(spark, sf):
    rows = R.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("grp"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return E.similar_pairs(rows, "grp").withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH t AS (SELECT p_brand AS slug, lower(p_type) AS key, p_size AS start, p_partkey AS id, {WORDS.format("p_name")} AS w FROM part),
 x AS (SELECT a.slug, a.key, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) AS overlap, a.start AS sa, b.start AS sb FROM t a JOIN t b ON a.slug = b.slug AND a.key = b.key AND a.start < b.start),
 r AS (SELECT *, row_number() OVER (PARTITION BY slug, key ORDER BY overlap, sa, a, sb, b) AS rank FROM x) SELECT slug, key, a, b, round(overlap, 6) AS overlap, rank FROM r WHERE rank <= 12""")
def f19_claim_pairs(spark, sf):
    """Parts as claims of one subject: the most unlike pairs of each."""
    claims = R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("slug"), F.concat(F.lit("the "), "p_type").alias("subject"), F.col("p_name").alias("predicate"), F.col("p_size").alias("start"))
    return S.claim_pairs(claims).select("slug", "key", "a", "b", F.round("overlap", 6).alias("overlap"), "rank")


@query(f"""WITH t AS (SELECT p_partkey AS id, p_size AS section, p_brand AS grp, array_to_string(list_sort({WORDS.format("split_part(p_name, ' ', 2)")}), ' ') AS who, array_to_string(list_sort({WORDS.format("p_name")}), ' ') AS what FROM part),
 x AS (SELECT a.id AS a, b.id AS b, a.grp = b.grp OR a.what = b.what AS near FROM t a JOIN t b ON a.id < b.id AND a.section <> b.section AND a.who <> b.who), n AS (SELECT count(*) AS every FROM x)
 SELECT a, b, every FROM x, n WHERE near OR every <= 900 ORDER BY a, b LIMIT 900""")
def f18_owner_pairs(spark, sf):
    """Entries of different sections and owners: all of them, or beyond the limit those of one group, with the number that there are."""
    entries = R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("section"), F.col("p_brand").alias("grp"), F.split("p_name", " ")[1].alias("owner"), F.col("p_name").alias("capability"))
    pairs, every = E.owner_pairs(entries)
    return pairs.withColumn("every", F.lit(every).cast("long"))


# An anchor is a part's name with its type; evidence is a name with something before and behind it, some of it lost.
ANCHOR = "lower(p_name || ' ' || p_type)"
EVIDENCE = "substr(lower(p_type || ' ' || p_name || ' ' || p_type), 1 + p_partkey % 4, 9 + p_size % 13)"
RUNS = f"""a AS (SELECT p_partkey AS anchor, p_brand AS kind, {ANCHOR} AS t FROM part), h AS (SELECT p_partkey AS id, p_brand AS kind, trim({EVIDENCE}) AS t FROM part),
 s AS (SELECT anchor, kind, t, i, n FROM a, range(1, 40) x(i), range(1, 40) y(n) WHERE i + n - 1 <= length(t) AND n >= ceil(length(t) * 0.6 - 1e-9)),
 runs AS (SELECT s.anchor, h.id, max(n) AS run FROM s JOIN h ON h.kind = s.kind AND contains(h.t, substr(s.t, CAST(i AS INTEGER), CAST(n AS INTEGER))) GROUP BY ALL)"""


def _evidence(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = R.table(spark, sf, "part")
    return part.selectExpr("p_partkey AS anchor", "p_brand AS kind", f"{ANCHOR} AS text"), part.selectExpr("p_partkey AS id", "p_brand AS kind", f"{EVIDENCE} AS text")


@query(f"WITH {RUNS} SELECT anchor, id, CAST(run AS INTEGER) AS run FROM runs")
def k15_shared_runs(spark, sf):
    """The longest run of each anchor in each text of its brand, where it is three fifths of the anchor."""
    anchors, texts = _evidence(spark, sf)
    return B.shared_runs(anchors, texts, on=["kind"]).drop("kind")


MATCHED = f"""{RUNS}, p AS (SELECT *, row_number() OVER (ORDER BY anchor) AS i FROM (SELECT DISTINCT anchor FROM runs)), c AS (SELECT p.i, list(runs.id ORDER BY runs.id) AS want FROM p JOIN runs USING (anchor) GROUP BY p.i),
 r(i, taken, found) AS (SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) UNION ALL SELECT CAST(q.i AS INTEGER), CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, f FROM (SELECT c.i, r.taken, list_min(list_filter(c.want, lambda x: NOT list_contains(r.taken, x))) AS f FROM r JOIN c ON c.i = r.i + 1) q),
 matched AS (SELECT p.anchor AS defect, r.found AS finding FROM p JOIN r USING (i) WHERE r.found IS NOT NULL)"""


def _scores(spark, sf):
    anchors, texts = _evidence(spark, sf)
    defects = anchors.select(F.col("anchor").alias("defect"), F.col("anchor").alias("pos"), "kind", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.col("text").alias("anchor"))
    findings = texts.select(F.col("id").alias("finding"), F.col("id").alias("pos"), "kind")
    return B.attribution_scores(defects, findings, texts.select(F.col("id").alias("finding"), "text", F.lit(None).cast("int").alias("line")))


@query(f"WITH RECURSIVE {MATCHED} SELECT defect, finding FROM matched")
def k16_matched(spark, sf):
    """Every planted part takes the first finding of its brand that has its anchor and that nobody has taken."""
    return _scores(spark, sf)[0]


@query(f"""WITH RECURSIVE {MATCHED}, n AS (SELECT count(*) AS wanted FROM part), m AS (SELECT count(*) AS hit FROM matched)
 SELECT wanted, wanted AS scorable, hit, wanted AS findings, round(hit / wanted, 6) AS recall, round(hit / wanted, 6) AS precision FROM n, m""")
def o12_attribution(spark, sf):
    told = _scores(spark, sf)[1]
    return told.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))

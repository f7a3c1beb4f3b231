"""The composed reviews: review, coverage, synthesis and scoring, as lazily joined tables (2.O)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.functions.scale import BADNESS, COVERAGE, lookup, worst
from quillspark.operators import aggregates, closure, graph, joins, lines, records
from quillspark.provider import ModelProvider, ask_all


def review(old: DataFrame, new: DataFrame, findings: DataFrame, terms: DataFrame, lexicon: DataFrame, purpose: DataFrame) -> dict[str, DataFrame]:
    """Without a model: drift, pointers, headings lost and gained, closure and vocabulary. old, new: (slug, text)."""
    a, b = lines.to_lines(old), lines.to_lines(new)
    expanded = joins.expand_terms(terms, lexicon)
    # a line's place in a corpus is its document's and its own, so equal lines of two documents stay two
    placed = lambda x: x.select(F.struct("slug", "line_no").alias("line_no"), "text")
    ha, hb = lines.heading_texts(a), lines.heading_texts(b)
    gone = ha.join(hb, "heading", "left_anti").select("heading", F.lit("removed").alias("change"))
    come = hb.join(ha, "heading", "left_anti").select("heading", F.lit("added").alias("change"))
    return {
        "drift": closure.drift(closure.manifest(old), closure.manifest(new)),
        "pointers": lines.unresolved_targets(b),
        "identifiers": lines.identifier_classes(lines.identifiers(b)),
        "headings": gone.unionByName(come),
        "closure": closure.closure(findings, expanded, placed(a), placed(b)),
        "vocabulary": aggregates.term_counts(b, purpose),
    }


def quote_check(rows: DataFrame) -> DataFrame:
    """(quote, passage): whether the quote stands in the passage, folded, without regard to case."""
    quote, passage = T.fold_lower(F.col("quote")), T.fold_lower(F.col("passage"))
    return rows.withColumn("quoted", (quote != "") & F.contains(passage, quote))


def gate_hits(words: DataFrame, docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(id, word) with hits, how often word or a variant (term, variant) of it stands in all docs (slug, text), inside of words too.

    Each document is cut into runs of letters, digits and hyphens once and equal runs are counted; asked strings meet the parts
    of distinct runs by equality. Only variants of several runs are looked for in whole texts, and their number is checked.
    """
    asked = words.select("word", F.col("word").alias("said")).distinct()
    if lexicon is not None:
        more = lexicon.select(F.lower("term").alias("word"), F.lower("variant").alias("said")).join(words.select("word").distinct(), "word", "left_semi")
        asked = asked.unionByName(more).distinct()
    one = asked.filter(F.col("said").rlike(r"^[a-z0-9\-]+$"))
    held = F.broadcast if joins.fits(one) else lambda df: df
    sizes = one.agg(F.collect_set(F.char_length("said")).alias("sizes"))  # a handful of lengths
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9\-]+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    fits = F.filter("sizes", lambda k: k <= F.char_length("run"))
    # a run's parts come out one by one, and only what is asked for is looked at again
    sized = runs.join(F.broadcast(sizes)).select("run", "n", F.explode(fits).alias("k"))
    placed = sized.select("run", "n", "k", F.explode(F.sequence(F.lit(1), F.char_length("run") - F.col("k") + 1)).alias("i"))
    met = placed.select("run", "n", F.substring(F.col("run"), F.col("i"), F.col("k")).alias("said")).join(held(one), "said").dropDuplicates(["run", "word", "said"])
    hits = met.groupBy("word").agg(F.sum(F.col("n") * T.occurrences(F.col("run"), F.col("said"))).alias("hits"))
    several = asked.filter(~F.col("said").rlike(r"^[a-z0-9\-]+$"))
    if not several.isEmpty():
        low = joins.contains_join(docs, several, term="said")
        hits = hits.unionByName(low.groupBy("word").agg(F.sum(T.occurrences(F.lower("text"), F.col("said"))).alias("hits"))).groupBy("word").agg(F.sum("hits").alias("hits"))
    return words.join(hits, "word", "left").select("id", "word", F.coalesce("hits", F.lit(0)).alias("hits"))


def retrieved(asked: DataFrame, chunks: DataFrame, how: str = "lexical", k: int = 12, sections: int = 3, embed: Callable[[F.Column], F.Column] = T.offline_vector) -> DataFrame:
    """(query_id, chunk_id, rank) of the passages shown for each obligation (id, text).

    lexical (H01, G06): by shared terms, scores rounded so that the order of adding doesn't matter. dense (F22): by cosine. section
    (F23): the best sections by their heading and opening, the opening chunk of each, then its k // sections best chunks; chunks
    need a section there.
    """
    if how == "lexical":
        scored = joins.lexical_top(asked.select(F.col("id").alias("query_id"), "text"), chunks.select("chunk_id", "text"), k).withColumn("score", F.round("score", 6))
        return aggregates.top_with_rest(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id").desc()], k).select("query_id", "chunk_id", "rank")
    queries = asked.select(F.col("id").alias("query_id"), embed(F.col("text")).alias("embedding"))
    items = chunks.select(F.col("chunk_id").alias("item_id"), embed(F.col("text")).alias("embedding"), *(["section"] if how == "section" else []))
    if how == "dense":
        return joins.top_k(queries, items, k).select("query_id", F.col("item_id").alias("chunk_id"), "rank")
    return joins.section_top_k(queries, items, k, sections).select("query_id", F.col("item_id").alias("chunk_id"), "rank")


def screened(asked: DataFrame, chunks: DataFrame, provider: ModelProvider, k: int = 12) -> DataFrame:
    """obligations that retrieval found nothing for are asked about every chunk: discharges before contributes, k at most. Their number is checked."""
    # equal passages and equal obligations are asked of once, by the first that has them; passages aren't shuffled once a question
    hashed = chunks.select("chunk_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("_h"))
    same = hashed.join(hashed.groupBy("_h").agg(F.min("chunk_id").alias("_c")), "_h").select("chunk_id", "_c")
    first = same.filter("chunk_id = _c").select("chunk_id").distinct()
    wanted = joins.small(asked).select(F.col("id").alias("query_id"), "text", F.min("id").over(W.partitionBy("text")).alias("_q"))
    pairs = chunks.select("chunk_id", F.col("text").alias("passage")).join(first, "chunk_id", "left_semi").join(F.broadcast(wanted.filter("query_id = _q").select("query_id", "text")))
    keyed = pairs.select(F.struct("query_id", "chunk_id").alias("id"), F.lit("Does this passage contribute to this obligation?").alias("system"), F.concat_ws("\n\n", "text", "passage").alias("user"))
    told = ask_all(keyed, provider, apart=True).filter(F.col("answer").isin("discharges", "contributes")).select(F.col("id.query_id").alias("_q"), F.col("id.chunk_id").alias("_c"), "answer")
    said = told.join(same, "_c").join(F.broadcast(wanted.select("query_id", "_q")), "_q").select("query_id", "chunk_id", "answer")
    return aggregates.top_with_rest(said, ["query_id"], [F.col("answer").desc(), F.col("chunk_id")], k).select("query_id", "chunk_id", "rank")


def coverage(
    obligations: DataFrame,
    docs: DataFrame,
    provider: ModelProvider,
    k: int = 12,
    least_hits: int = 8,
    chunks: DataFrame | None = None,
    how: str = "lexical",
    lexicon: DataFrame | None = None,
    scope: str | None = None,
    screen: ModelProvider | None = None,
) -> DataFrame:
    """Obligations (id, modality, text) against documents (slug, text): retrieval, verdict, gate, all as rows.

    Only those of one scope (E01), if named. Permissive obligations aren't judged (E02). Where retrieval finds nothing and a
    screen is given, every chunk is asked about. The gate (G04) looks for the obligations' words of five letters or more that
    aren't stop words, and their variants.
    """
    if scope is not None:
        obligations = records.of_scope(obligations, scope)
    if chunks is None:
        cut = lines.cut_documents(docs)
        chunks = cut.select(F.concat_ws(":", F.col("slug").cast("string"), F.col("start").cast("string")).alias("chunk_id"), F.concat_ws("/", F.col("slug").cast("string"), "heading").alias("section"), "text")
    permissive = F.upper(F.trim("modality")).startswith("MAY")
    asked = obligations.filter(~permissive)
    best = retrieved(asked, chunks, how, k)
    if screen is not None:
        unfound = asked.join(best.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
        if not unfound.isEmpty():
            best = best.unionByName(screened(unfound, chunks, screen, k))
    # a few passages for each obligation: the lines aren't shuffled to meet them
    best = F.broadcast(best) if joins.fits(asked, joins.SMALL // k) else best
    passages = best.join(chunks.select("chunk_id", F.col("text").alias("passage")), "chunk_id").groupBy(F.col("query_id").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]), "\n\n").alias("passages")
    )
    prompts = asked.join(passages, "id", "left").select("id", F.lit("Judge the obligation by the passages.").alias("system"), F.concat_ws("\n\n", "text", "passages").alias("user"))
    judged = ask_all(prompts, provider).select("id", F.coalesce("answer", F.lit("unverifiable")).alias("verdict"), "status", "error")
    words = asked.select("id", F.explode(F.array_distinct(T.words_of(F.col("text"), r"[a-z][a-z0-9\-]{4,}", T.RETRIEVAL_STOP))).alias("word"))
    gate = aggregates.absence_gate(gate_hits(words, docs, lexicon), least_hits)
    out = obligations.join(judged, "id", "left").join(gate, "id", "left")
    unmet = F.col("verdict") == "unmet"
    return out.select("id", "modality", "text", F.when(permissive, "not_applicable").otherwise(F.col("verdict")).alias("verdict"), F.when(unmet, F.col("gate")).alias("gate"), F.when(unmet, F.col("evidence")).alias("evidence"), "status", "error")


def flagged_clusters(judged: DataFrame, embed: Callable[[F.Column], F.Column] = T.offline_vector, threshold: float = 0.55) -> DataFrame:
    """Flagged rows (grp, id, position, text, verdict) in greedy clusters with strength and lead."""
    rows = judged.filter(COVERAGE.flagged(F.col("verdict"))).withColumn("embedding", embed(F.col("text")))
    grouped = graph.greedy_groups(rows, threshold=threshold)
    joined = grouped.join(judged.select("id", "verdict"), "id").withColumn("cluster", F.concat_ws("/", F.col("grp").cast("string"), F.col("cluster").cast("string")))
    return aggregates.clusters(joined)


def score_coverage(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Worst verdict of each requirement (ref, position, verdict) against the expected (ref, expected): exact matches and the flag's cells."""
    worst_of = rows.groupBy("ref").agg(worst(F.col("verdict"), F.col("position")).alias("verdict"))
    both = wanted.join(worst_of, "ref")
    flag = lambda c: lookup(F.col(c), BADNESS, 0) > 0
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == F.col("expected")).alias("exact"), *aggregates.confusion(flag("verdict"), flag("expected")))


def absent(left: DataFrame, right: DataFrame, on: list[str], complete: DataFrame) -> DataFrame:
    """The rule of absence: a row without partner is absent only if its source (slug) was read completely, else unverifiable."""
    found = left.join(right.select(*on).distinct().withColumn("_found", F.lit(True)), on, "left").join(complete.select("slug", "complete"), "slug", "left")
    status = F.when(F.col("_found"), "present").when(F.coalesce("complete", F.lit(False)), "absent").otherwise("unverifiable")
    return found.select(*left.columns, status.alias("status"))

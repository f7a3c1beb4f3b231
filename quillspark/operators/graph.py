"""Cycles, greedy groups and diffs (2.K)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.operators.aggregates import ranked
from quillspark.operators.durable import written

#: Longest path that a cycle search walks.
LONGEST = 8


def cycles(edges: DataFrame, longest: int = LONGEST, key: list[str] | None = None) -> DataFrame:
    """Simple cycles of up to longest nodes, each once: its set of nodes and its path from the least node.

    With key, the edges are those of many small graphs (a graph for each value of key), searched at once; a cycle stays inside its graph.
    Paths start at their least node and grow by equi joins, one round a length, so a cycle is found from one start only, in one rotation.
    A node without a way on or back is taken off first, so that paths grow only where a cycle can be. Null nodes have no edges.
    """
    key = key or []
    e = edges.select(*key, F.col("src"), F.col("dst")).filter("src <> dst").distinct()
    for _ in range(2):
        e = e.join(e.select(*key, F.col("src").alias("dst")).distinct(), [*key, "dst"], "left_semi").join(e.select(*key, F.col("dst").alias("src")).distinct(), [*key, "src"], "left_semi").select(*key, "src", "dst")
    e = written(e, "edges")
    paths = e.filter("dst > src").select(*key, F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("at"))
    found = None
    for _ in range(longest - 1):
        step = paths.join(e.select(*key, F.col("src").alias("at"), F.col("dst").alias("next")), [*key, "at"])
        closed = step.filter("next = start").select(*key, "path")
        found = closed if found is None else found.unionByName(closed)
        paths = step.filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(*key, F.concat("path", F.array("next")).alias("path"), "start", F.col("next").alias("at"))
    return found.groupBy(*key, F.array_sort("path").alias("nodes")).agg(F.min("path").alias("path"))


#: Rows of a block of a group; two blocks of vectors and the products of all their rows are one task's work.
BLOCK = 4096


def _order_bits(near: np.ndarray) -> list[int]:
    """Each row of a table of truth values as the bits of one number."""
    packed = np.packbits(near, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _needed(near: list[int], reach: list[int]) -> Iterator[tuple[int, int]]:
    """(i, j) of the neighbours that say all: the last one, the last of those that it doesn't lead to, and so on."""
    for i, left in enumerate(near):
        while left:
            j = left.bit_length() - 1
            yield i, j
            left &= ~(reach[j] | 1 << j)


def _reach(near: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """The needed neighbours inside a block in order of position, and for each row all that they lead to, as bits."""
    kept: list[tuple[int, int]] = []
    reach: list[int] = []
    for i, left in enumerate(_order_bits(np.tril(near, -1))):
        own = 0
        while left:
            j = left.bit_length() - 1
            kept.append((i, j))
            own |= reach[j] | 1 << j
            left &= ~own
        reach.append(own)
    return kept, reach


def met_blocks(rows: DataFrame, key: str, dealt_by: Column, block: int = BLOCK) -> DataFrame:
    """rows once for every two blocks (_a, _b) of their group that they are in one of (_own), so that each pair of rows of a group meets in one task.

    A group is dealt to blocks of about block rows by a hash; a group of one block meets itself alone.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = rows.join(sizes, key).withColumn("_own", F.pmod(dealt_by, blocks).cast("int"))
    each = dealt.select(*rows.columns, "_own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    return each.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_other")


def units(vectors: list) -> np.ndarray:
    """Vectors as rows of length 1; a zero vector stays."""
    unit = np.array(vectors, float).reshape(len(vectors), -1)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)


def _near(a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 512) -> np.ndarray:
    """Which rows of a are near which of b. The products of a few rows are held at a time, a byte a pair is what stays."""
    near = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), rows):
        np.greater_equal(a[i : i + rows] @ b.T, threshold, out=near[i : i + rows])
    return near


def earlier_neighbours(rows: DataFrame, key: str, threshold: float, vector: str, block: int = BLOCK) -> DataFrame:
    """key, i and j: positions of rows of a group of cosine threshold or more, j before i, without those that others lead to.

    A group's rows are dealt to blocks of about block rows by a hash, and every two blocks meet in a task of their own. Of a
    clique of m rows about m * m / block neighbours are left, not m * m / 2: where i is near j and j leads to k, that i is near k says nothing new.
    """
    met = met_blocks(rows.select(key, "position", vector), key, F.xxhash64("position"), block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        unit = units(pdf[vector].tolist())
        place, first = pdf["position"].to_numpy(), (pdf["_own"] == pdf["_a"].iloc[0]).to_numpy()
        parts = [(place[m], unit[m]) for m in (first, ~first)]
        out: list[tuple] = []
        if not len(parts[1][0]):
            p, u = parts[0]
            out = [(p[i], p[j]) for i, j in _reach(_near(u, u, threshold))[0]]
        else:
            for (p, u), (q, v) in ((parts[0], parts[1]), (parts[1], parts[0])):
                near = _near(u, v, threshold)
                near &= q[None, :] < p[:, None]
                if near.any():
                    out += [(p[i], q[j]) for i, j in _needed(_order_bits(near), _reach(_near(v, v, threshold))[1])]
        told = pd.DataFrame(out, columns=["i", "j"])
        told.insert(0, key, pd.Series([pdf[key].iloc[0]] * len(told), dtype=object))
        return told

    kind = rows.schema[key].dataType.simpleString()
    return met.groupBy(key, "_a", "_b").applyInPandas(run, f"{key} {kind}, i long, j long")


def first_reached(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, i and first: the least place that i leads to along edges (key, i, j), j before i; its own where it has none.

    Every round takes the least of a row's own and its neighbours' places, and of the place that this place has come to,
    so a chain halves in each round. Both sides have a row for each row, so they are merged: a broadcast would send them through the driver each round.
    """
    edges = written(edges, "edges")
    own = nodes.join(edges.groupBy(key, "i").agg(F.min("j").alias("j")).hint("merge"), [key, "i"], "left")
    now = written(own.select(key, "i", F.coalesce("j", "i").alias("first")), "first")
    while True:
        at = now.select(key, F.col("i").alias("j"), F.col("first").alias("there"))
        pulled = edges.join(at.hint("merge"), [key, "j"]).groupBy(key, "i").agg(F.min("there").alias("pulled"))
        ahead = now.select(key, F.col("i").alias("first"), F.col("first").alias("jumped")).filter("first <> jumped")
        least = F.least("first", F.coalesce("pulled", "first"), F.coalesce("jumped", "first"))
        after = now.join(pulled.hint("merge"), [key, "i"], "left").join(ahead.hint("merge"), [key, "first"], "left").select(key, "i", least.alias("first"), (least < F.col("first")).alias("moved"))
        after = written(after, "first")
        if not after.filter("moved").limit(1).count():
            return after.select(key, "i", "first")
        now = after.select(key, "i", "first")


def greedy_groups(rows: DataFrame, key: str = "grp", threshold: float = 0.55, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (key, id, position, vector) of a group in order of position join the first cluster that has a member of cosine threshold or more.

    A row's cluster is the first of its earlier neighbours' clusters, so it is the one that the earliest row founded to which a chain of
    ever earlier neighbours leads. That is found in rounds over all groups, so that no group is one task's work. Positions are
    distinct within a group; a null or zero vector is near nothing; rows of a null key are left out.
    """
    held = rows.filter(F.col(key).isNotNull()).select(key, "id", "position", vector)
    near = earlier_neighbours(held.filter(F.col(vector).isNotNull()), key, threshold, vector, block)
    first = first_reached(held.select(key, F.col("position").alias("i")), near, key)
    founders = ranked(first.filter("i = first").select(key, "first"), [F.col(key), F.col("first")], "_place")
    number = founders.join(founders.groupBy(key).agg(F.min("_place").alias("_least")).hint("merge"), key).select(key, "first", (F.col("_place") - F.col("_least")).cast("int").alias("cluster"))
    return held.select(key, "id", "position", F.col("position").alias("i")).join(first.join(number.hint("merge"), [key, "first"]).hint("merge"), [key, "i"]).select(key, "id", "position", "cluster")


def copied_groups(rows: DataFrame, vectors: DataFrame, key: str = "grp", threshold: float = 0.62, block: int = BLOCK, copies: int = 8) -> DataFrame:
    """greedy_groups() of rows (key, id, position, label) by the vectors (label, embedding) of their labels: key, id, position, cluster. Copies of a label in a group
    meet by their first ones, so the time grows with distinct labels. Rows whose label has no row in vectors are left out.

    The least place that a label's copies lead to falls from copy to copy, and never below that of its component, the labels that chains of neighbours join in
    any order. Where the first copies of a component all lead there, so do all later ones. Where they don't, the first 8 copies of its labels
    are looked at, then 64 and so on; once the last ones that were looked at lead there, a later copy can't show another row anything new, and it leads there too.
    """
    size = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    alike = F.coalesce((size > 0) & (size < float("inf")) & F.lit(threshold < 1 - 1e-6), F.lit(False))  # else a row isn't even near its copies
    vectors = written(vectors.select("label", "embedding", alike.alias("_alike")), "vectors")
    told = rows.filter(F.col(key).isNotNull()).select(key, "id", "position", "label").join(vectors.select("label", "_alike").hint("merge"), "label")
    told = told.withColumn("_n", F.row_number().over(W.partitionBy(key, "label").orderBy("position")))
    # without a use for copies, each row is a label of its own
    own = F.when(F.col("_alike"), F.lit(0).cast("long")).otherwise(F.col("position").cast("long"))
    told = written(told.withColumn("_own", own).withColumn("_n", F.when(F.col("_alike"), F.col("_n")).otherwise(1)), "rows")
    kinds = [key, "label", "_own"]

    def reached(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What earlier_neighbours() and first_reached() say of some rows: the neighbours, and (kinds, _n, first)."""
        held = some.join(vectors.drop("_alike").hint("merge"), "label")
        near = written(earlier_neighbours(held.filter(F.col("embedding").isNotNull()), key, threshold, "embedding", block), "near")
        first = first_reached(some.select(key, F.col("position").alias("i")), near, key)
        return near, written(some.withColumn("i", F.col("position")).join(first.hint("merge"), [key, "i"]).select(*kinds, "_n", "position", "first"), "reached")

    near, now = reached(told.filter("_n = 1"))
    to = now.select(key, F.col("position").alias("i"), "first")
    ends = near.join(to.withColumnRenamed("first", "a").hint("merge"), [key, "i"]).join(to.select(key, F.col("i").alias("j"), F.col("first").alias("b")).hint("merge"), [key, "j"])
    met = written(ends.filter("a <> b").select(key, F.col("a").alias("i"), F.col("b").alias("j")).distinct(), "met")
    done = now.select(*kinds, "_n", "first")
    if not met.isEmpty():
        both = met.unionByName(met.select(key, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
        least = first_reached(both.select(key, "i").distinct(), both, key).select(key, F.col("i").alias("first"), F.col("first").alias("least"))
        sizes = told.groupBy(*kinds).agg(F.max("_n").alias("many"))
        left = written(now.join(least, [key, "first"]).select(*kinds, "least").join(sizes.hint("merge"), kinds), "open")
        done = now.select(*kinds, "_n", "first").join(left.select(*kinds), kinds, "left_anti")
        while not left.isEmpty():
            some = written(told.filter(F.col("_n") <= copies).join(left.select(*kinds, "least", "many"), kinds), "copies")
            now = reached(some)[1].join(left, kinds)
            more = now.filter((F.col("_n") == copies) & (F.col("many") > copies) & (F.col("first") > F.col("least"))).select(key, "least").distinct()
            more = written(more, "more")
            done = done.unionByName(now.join(more, [key, "least"], "left_anti").select(*kinds, "_n", "first"))
            left, copies = written(left.join(more, [key, "least"], "left_semi").select(*left.columns), "open"), copies * 8
    done = written(done, "done")
    founders = ranked(done.select(key, "first").distinct(), [F.col(key), F.col("first")], "_place")
    number = founders.join(founders.groupBy(key).agg(F.min("_place").alias("_least")).hint("merge"), key).select(key, "first", (F.col("_place") - F.col("_least")).cast("int").alias("cluster"))
    lists = done.join(number.hint("merge"), [key, "first"]).groupBy(*kinds).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "cluster"))), lambda x: x["cluster"]).alias("_c"))
    return told.join(lists.hint("merge"), kinds).select(key, "id", "position", F.get("_c", F.least(F.col("_n"), F.size("_c")) - 1).alias("cluster"))


def concept_groups(rows: DataFrame, key: str = "grp", threshold: float = 0.5) -> DataFrame:
    """The same by overlap of concept words with a cluster's growing union; rows without a concept word are dropped."""
    told = rows.select(key, "id", "position", T.concepts(F.col("label")).alias("words")).filter(F.size("words") > 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        unions: list[set] = []
        label = []
        for words in map(set, pdf["words"]):
            home = next((k for k, u in enumerate(unions) if len(u & words) >= threshold * min(len(u), len(words))), len(unions))
            if home == len(unions):
                unions.append(set())
            unions[home] |= words
            label.append(home)
        return pd.DataFrame({key: pdf[key], "id": pdf["id"], "position": pdf["position"], "cluster": label})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return told.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, id {kinds['id']}, position long, cluster int")


def diff_counts(old: list[str], new: list[str]) -> tuple[int, int]:
    """Added and dropped lines of a diff without context."""
    added = dropped = 0
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
        if kind != "equal":
            dropped += b - a
            added += d - c
    return added, dropped


def diffs(pairs: DataFrame, context: int = 2) -> DataFrame:
    """(id, old, new) arrays of lines to added, dropped and a unified diff. Equal texts skip the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, a, b in zip(batch["id"], batch["old"], batch["new"], strict=True):
                a, b = list(a), list(b)
                added, dropped = (0, 0) if a == b else diff_counts(a, b)
                rows.append((i, added, dropped, "" if a == b else "\n".join(difflib.unified_diff(a, b, n=context, lineterm=""))))
            yield pd.DataFrame(rows, columns=["id", "added", "dropped", "diff"])

    return pairs.select("id", "old", "new").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, added int, dropped int, diff string")


def initials(names: DataFrame) -> DataFrame:
    """Initials that stand for exactly one name."""
    short = F.upper(F.array_join(F.transform(F.filter(F.split("name", r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))
    each = names.select("name", short.alias("initials")).distinct().groupBy("initials").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return each.filter((F.col("n") == 1) & (F.char_length("initials") >= 2)).select("initials", "name")

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise


#: A node with more neighbours than HUB, and than one in HUBS of all links, is a hub: fewer than 2 * HUBS nodes can be.
HUB, HUBS = 1000, 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v and root (the least id of its component) of every id in edges; loops and repeated edges are fine.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them, until nothing
    changes; rounds grow with the logarithm of a component's diameter. Minima are aggregated map-side. A hub's
    minimum is broadcast to its links where they are, so no task gathers the neighbours of a hub; a node that is
    no hub has HUB links, or one in HUBS of all, at most. Every round is written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now, "edges")
    nodes = now.select(F.col("u").alias("v")).unionByName(now.select("v")).distinct()
    now = now.filter("u <> v")
    before = _sum(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, before[0], own=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large")
        joined = _with_least(large, before[0], own=False)
        least = joined.select("u", F.col("m").alias("v"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least)
        now = materialise(small.filter("u <> v").distinct(), "edges")
        after = _sum(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "v")
    return nodes.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def _with_least(links: DataFrame, n: int, own: bool) -> DataFrame:
    """u, v and m, the least neighbour of u (or u itself, where own): hubs by broadcast, the others by shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    least = least.select("u", F.least("u", "m").alias("m") if own else F.col("m"), "c")
    hub = F.col("c") > max(HUB, n // HUBS)
    marked = links.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("h"))), "u", "left")
    rest = marked.filter("h is null").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return marked.filter("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(rest)


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]

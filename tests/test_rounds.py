"""Operators that work in rounds over all groups at once, against their sequential rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph as G


def in_order(vectors, threshold):
    """The rule as it is told: a row joins the first cluster with a near member."""
    groups, out = [], []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for i, v in enumerate(unit):
        home = next((k for k, g in enumerate(groups) if any(float(v @ unit[j]) >= threshold for j in g)), None)
        if home is None:
            groups.append([i])
            home = len(groups) - 1
        else:
            groups[home].append(i)
        out.append(home)
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_greedy_groups_in_rounds(spark, block):
    rnd = np.random.default_rng(5)
    shapes = {"wide": (120, 6), "dense": (90, 2), "lone": (1, 3), "chain": (80, 2)}
    rows, wanted = [], {}
    for name, (n, dims) in shapes.items():
        v = rnd.normal(size=(n, dims))
        if name == "chain":  # each is near the one before and after alone
            turn = np.arange(n) * 0.04
            v = np.stack([np.cos(turn), np.sin(turn)], 1)
        if name == "wide":
            v[3] = 0
        limit = 0.99924 if name == "chain" else 0.8
        rows += [(name, f"{name}{i}", 10 * i, x.tolist()) for i, x in enumerate(v)]
        wanted[name] = (limit, in_order(v, limit))
    df = spark.createDataFrame(rows, "grp string, id string, position long, embedding array<double>").repartition(5)
    for limit in (0.8, 0.99924):
        got = {(r["grp"], r["position"] // 10): r["cluster"] for r in G.greedy_groups(df, threshold=limit, block=block).collect()}
        assert len(got) == len(rows)
        for name, (own, clusters) in wanted.items():
            if own == limit:
                assert [got[name, i] for i in range(len(clusters))] == clusters, name


def test_a_clique_keeps_few_neighbours(spark):
    rows = spark.range(600).select(F.lit("g").alias("grp"), F.col("id"), F.col("id").alias("position"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert G.earlier_neighbours(rows, "grp", 0.5, "embedding", 100).count() < 600 * 14
    assert G.greedy_groups(rows, block=100).filter("cluster <> 0").count() == 0


def test_null_vectors_and_no_rows(spark):
    schema = "grp string, id long, position long, embedding array<double>"
    got = G.greedy_groups(spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, [1.0]), ("a", 3, 3, [2.0]), (None, 4, 4, [1.0])], schema))
    assert sorted((r["id"], r["cluster"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 1)]
    assert G.greedy_groups(spark.createDataFrame([], schema)).count() == 0


def plain_cycles(edges, longest=8):
    out = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    out.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < longest:
                    walk([*path, b])

    for start in {a for a, _ in edges}:
        walk([start])
    best = {}
    for path in sorted(out):
        best.setdefault(tuple(sorted(path)), path)
    return {(k, v) for k, v in best.items()}


def test_cycles_of_many_graphs(spark):
    rnd = random.Random(3)
    graphs = {g: {(rnd.choice("abcdef"), rnd.choice("abcdef")) for _ in range(rnd.randrange(2, 9))} for g in range(40)}
    graphs = {g: {(a, b) for a, b in e if a != b} for g, e in graphs.items()}
    rows = [(g, a, b) for g, e in graphs.items() for a, b in e]
    out = G.cycles(spark.createDataFrame(rows, "grp int, src string, dst string"), key=["grp"])
    got = {}
    for r in out.collect():
        got.setdefault(r["grp"], set()).add((tuple(r["nodes"]), tuple(r["path"])))
    assert got == {g: plain_cycles(e) for g, e in graphs.items() if plain_cycles(e)}
    assert any(got.values())


def nearest_in_order(rows, least, most):
    """The rule as it is told: claims in order, the nearest later ones of each, two starts once."""
    seen, out = set(), []
    unit = [np.array(v) / max(np.linalg.norm(v), 1e-300) for *_, v in rows]
    for i, a in enumerate(rows):
        near = sorted(((-round(float(unit[i] @ unit[j]), 6), j) for j in range(i + 1, len(rows)) if rows[j][3] != a[3] and round(float(unit[i] @ unit[j]), 6) >= least))
        for score, j in near[:most]:
            pair = frozenset((a[3], rows[j][3]))
            if pair not in seen:
                seen.add(pair)
                out.append((a[0], a[1], rows[j][1], -score))
    return out


@pytest.mark.parametrize("block", [9, 400])
def test_object_pairs_by_blocks(spark, block):
    from quillspark.operators import records as N

    rnd = np.random.default_rng(8)
    docs = {d: [(d, f"{d}{i}", i, int(rnd.integers(0, 25)), rnd.normal(size=4).tolist()) for i in range(n)] for d, n in (("a", 70), ("b", 30), ("c", 1))}
    df = spark.createDataFrame([r for own in docs.values() for r in own], "slug string, id string, position int, start int, embedding array<double>").repartition(6)
    got = sorted((r["slug"], r["a"], r["b"], round(r["score"], 5)) for r in N.object_pairs(df, 0.5, 4, block=block).collect())
    assert got == sorted((*x[:3], round(x[3], 5)) for own in docs.values() for x in nearest_in_order(own, 0.5, 4))

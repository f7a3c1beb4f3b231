"""Middle values by refinement, cells and policies, by hand and by brute force."""

import random

import pytest

from quillspark.operators import cells as K


@pytest.mark.parametrize("few", [K.FEW, 2])
def test_the_middle_of_every_group(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW", few)
    if few == 2:
        monkeypatch.setattr(K, "RANGES", 3)
    rnd = random.Random(31)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(301)], "b": [float(rnd.randrange(4)) for _ in range(200)], "c": [5.0], "d": [1e300, -1e300, 0.0, 1.0], "e": [2.0, 1.0], None: [3.0, 3.0, 9.0], "f": [2.0**k for k in range(60)]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("z", None)]
    got = {r["g"]: r["median"] for r in K.upper_median(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g").collect()}
    assert got == {g: sorted(own)[len(own) // 2] for g, own in groups.items()}


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (9,)], "v int")
    out = K.upper_median(df, "v")
    assert [tuple(r) for r in out.collect()] == [(3,)] and dict(out.dtypes) == {"median": "int"}
    assert K.upper_median(df.limit(0), "v").count() == 0


def test_cells_and_policies(spark):
    rows = [(i, i / 100, "addressed" if i % 2 else "not_addressed") for i in range(100)]
    told = K.cells(spark.createDataFrame(rows, "id int, score double, verdict string"))
    assert {r["id"]: r["cell"] for r in told.collect()} == {i: "DB"[i % 2] if i < 50 else "CA"[i % 2] for i in range(100)}
    by = {"words": lambda i: i >= 50, "yes": lambda i: True, "no": lambda i: False, "right": lambda i: i % 2 == 1}
    runs = [(m, i, "addressed" if f(i) else "partial") for m, f in by.items() for i in range(100)] + [("short", i, "addressed") for i in range(79)]
    got = {r["model"]: r for r in K.cell_rates(told, spark.createDataFrame(runs, "model string, id int, verdict string")).collect()}
    assert {m: r["policy"] for m, r in got.items()} == {"words": "vocabulary matcher", "yes": "blanket addressed", "no": "blanket refuse", "right": "outcome judge", "short": None}
    assert got["words"]["gap"] == 1 and got["right"]["gap"] == 0 and got["short"]["covered"] == 79 and got["short"]["a"] is None
    scored = {(r["model"], r["mapping"]): (r["hits"], r["seen"], r["baseline"]) for r in K.accuracy(told.select("id", "verdict"), spark.createDataFrame(runs, "model string, id int, verdict string")).collect()}
    assert scored["no", "strict"] == (50, 100, 0.5) and scored["no", "lenient"] == (50, 100, 0.5) and scored["right", "strict"][0] == 100 and scored["right", "lenient"][0] == 50

"""Revisions that come out of order, twice, or never."""

import json

from quillspark.streaming import closures as C


def test_closures_between_revisions(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    batches = [
        [("d", "f", 1, 2, "x", "2024-01-01"), ("d", "f", 3, 0, "", "2024-01-01"), ("e", "f", 1, 1, "q", "2024-01-01")],  # revision 2 is missing yet
        [("d", "f", 2, 2, "y", "2024-01-02"), ("d", "f", 1, 2, "x", "2024-01-02"), ("d", "g", 1, 0, "", "2024-01-02"), (None, "g", 1, 0, "", "2024-01-02")],  # it comes, and 1 once more
        [("d", "g", 2, 0, "", "2024-01-03"), ("d", "g", 3, 4, "z", "2024-01-03"), ("d", "g", 4, 4, "z", "2024-01-03"), ("d", "f", 3, 9, "other", "2024-01-03")],
        [("z", "f", 1, 1, "q", "2024-06-01")],  # much later: what wasn't followed is told
        [("e", "f", 2, 1, "q", "2024-06-02"), ("z", "f", 2, 1, "r", "2024-06-02")],  # after all
    ]
    got = []
    try:
        for k, rows in enumerate(batches):
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("slug", "finding", "revision", "lines", "digest", "ts"), r, strict=True)) | {"ts": r[-1] + "T00:00:00Z"}) for r in rows))
            stream = C.closure_stream(C.hit_stream(spark, str(source)), "10 days", "1 hour")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
            now = sorted(map(tuple, spark.read.schema(C.STATES).parquet(out).collect()), key=str)
            got.append([r for r in now if r not in [x for y in got for x in y]])
    finally:
        if keep:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    every = [x for y in got for x in y]
    pairs = sorted(r for r in every if r[3])
    assert pairs == [("d", "f", 1, 2, "CHANGED"), ("d", "f", 2, 3, "REMOVED"), ("d", "g", 1, 2, "STILL ABSENT"), ("d", "g", 2, 3, "ADDED"), ("d", "g", 3, 4, "UNCHANGED"), ("e", "f", 1, 2, "UNCHANGED"), ("z", "f", 1, 2, "CHANGED")]
    assert got[0] == [] and ("d", "f", 2, 3, "REMOVED") in got[1]  # only a later revision tells what became of an earlier one
    assert {r[:3] for r in every if r[4] == "NEVER REVISED"} == {("d", "f", 3), ("d", "g", 4), ("e", "f", 1)}

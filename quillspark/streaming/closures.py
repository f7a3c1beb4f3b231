"""What becomes of a document's findings from revision to revision, as a stream (2.L, J32)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HITS = "slug string, finding string, revision int, lines int, digest string, ts timestamp"
STATES = "slug string, finding string, revision int, next int, state string"
#: Where the state lives: timers and maps need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def between(old: Row | tuple, new: Row | tuple) -> str:
    """The closure state of two revisions' hits, each lines and digest."""
    if not new[0]:
        return "REMOVED" if old[0] else "STILL ABSENT"
    if not old[0]:
        return "ADDED"
    return "UNCHANGED" if old[1] == new[1] else "CHANGED"


class Closures(StatefulProcessor):
    """Holds, for a document and a finding, the hits of each revision until both of its neighbours have come; a revision that comes twice counts once.

    A pair of neighbouring revisions is told when the second of them arrives, in whichever order. Each revision sets a timer; if the next one
    hasn't come when it rings, NEVER REVISED is told, and once more the pair if it comes after all.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getMapState("hits", "revision int", "lines int, digest string, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in rows:
            at = int(row["revision"])
            if self.hits.containsKey((at,)):
                continue
            now = (int(row["lines"] or 0), row["digest"] or "")
            due = int(row["ts"].timestamp() * 1000) + self.patience
            self.hits.updateValue((at,), (*now, due))
            self.handle.registerTimer(due)
            for first, second in ((at - 1, at), (at, at + 1)):
                other = first if second == at else second
                if self.hits.containsKey((other,)):
                    held = self.hits.getValue((other,))
                    old, new = (held, now) if other == first else (now, held)
                    yield Row(slug=key[0], finding=key[1], revision=first, next=second, state=between(old, new))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        rung = expiredTimerInfo.getExpiryTimeInMs()
        for (at,), held in sorted(self.hits.iterator(), key=lambda x: x[0][0]):
            if held[2] == rung and not self.hits.containsKey((at + 1,)):
                yield Row(slug=key[0], finding=key[1], revision=at, next=None, state="NEVER REVISED")

    def close(self) -> None:
        pass


def hit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of what each revision of a document has of each finding: lines, a digest of them, and when it was read."""
    return spark.readStream.schema(HITS).json(path)


def closure_stream(hits: DataFrame, patience: str = "30 days", late: str = "1 hour") -> DataFrame:
    """slug, finding, revision, next and state for every two neighbouring revisions of hit_stream(), and for the ones that aren't followed within
    patience (of event time, which late rows move on). Rows without a document, finding or revision are left out."""
    spark = hits.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = spark.sql(f"SELECT cast(INTERVAL {patience} AS interval day to second) AS i").first()["i"]
    told = hits.filter("slug IS NOT NULL AND finding IS NOT NULL AND revision IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return told.groupBy("slug", "finding").transformWithState(statefulProcessor=Closures(int(wait.total_seconds() * 1000)), outputStructType=STATES, outputMode="Append", timeMode="EventTime")



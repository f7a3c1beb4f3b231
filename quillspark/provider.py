"""The model boundary (2.N): providers behind a DataFrame, with an answer cache and failures as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import cache_key
from quillspark.operators.durable import written


class ModelProvider(Protocol):
    name: str

    def ask(self, system: str, user: str) -> str: ...


class Offline:
    """The same answer to the same question, without a network: one of the allowed words, by hash."""

    name = "offline"

    def __init__(self, words: tuple[str, ...] = ("met", "partial", "unmet", "unverifiable")):
        self.words = words

    def ask(self, system: str, user: str) -> str:
        return self.words[hashlib.sha256(f"{system}\0{user}".encode()).digest()[0] % len(self.words)]


def ask_all(prompts: DataFrame, provider: ModelProvider, answers: DataFrame | None = None, valid: Callable[[str], str | None] | None = None, attempts: int = 2, stop_after: int = 4, apart: bool = False) -> DataFrame:
    """(id, system, user) to id, key, answer, status and error.

    Equal prompts are asked once. Known answers (key, answer) are joined, not asked. An invalid answer is asked for again with the
    reason; after stop_after failures without a success a task asks no more and says so. Nothing is dropped: failures are rows.
    apart: the caller has made prompts distinct, so their texts aren't shuffled for it; should two be equal still, both are asked and one answer counts.
    """
    keyed = prompts.withColumn("key", cache_key(F.lit(provider.name), "system", "user"))
    wanted = keyed.select("key", "system", "user")
    wanted = wanted if apart else wanted.dropDuplicates(["key"])
    if answers is not None:
        wanted = wanted.join(answers.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures, successes = 0, 0
        for batch in batches:
            out = []
            for key, system, user in zip(batch["key"], batch["system"], batch["user"], strict=True):
                answer, error, asked = None, "endpoint given up", user
                for _ in range(attempts if successes or failures < stop_after else 0):
                    try:
                        said = provider.ask(system, asked)
                        successes += 1
                        error = valid(said) if valid else None
                        if error is None:
                            answer = said
                            break
                        asked = f"{user}\n\nThe last answer was refused: {error}"
                    except Exception as e:
                        failures += 1
                        error = f"{type(e).__name__}: {e}"
                out.append((key, answer, "ok" if answer is not None else "failed", None if answer is not None else error))
            yield pd.DataFrame(out, columns=["key", "answer", "status", "error"])

    new = wanted.mapInPandas(run, "key string, answer string, status string, error string")
    new = new.dropDuplicates(["key"]) if apart else new
    if answers is not None:
        new = new.unionByName(answers.select("key", "answer", F.lit("cached").alias("status"), F.lit(None).cast("string").alias("error")))
    return keyed.select("id", "key").join(new, "key", "left")


def ask_cached(prompts: DataFrame, provider: ModelProvider, path: str, **options) -> DataFrame:
    """ask_all() with a table of answers at path: known ones aren't asked, new ones are written there, failures are not."""
    from quillspark.sources.files import append_new, exists

    spark = prompts.sparkSession
    known = spark.read.schema("key string, answer string").parquet(path) if exists(spark, path) else None
    keyed = prompts.withColumn("key", cache_key(F.lit(provider.name), "system", "user"))
    fresh = prompts if known is None else keyed.join(known.select("key"), "key", "left_anti").select(*prompts.columns)
    told = written(ask_all(fresh, provider, **options), "answers")
    append_new(told.filter("answer IS NOT NULL").select("key", "answer"), path, ["key"])
    good = spark.read.schema("key string, answer string").parquet(path) if exists(spark, path) else spark.createDataFrame([], "key string, answer string")
    failed = told.filter("answer IS NULL").select("key", F.col("status").alias("_s"), F.col("error").alias("_e")).dropDuplicates(["key"])
    joined = keyed.select("id", "key").join(good, "key", "left").join(failed, "key", "left")
    status = F.when(F.col("answer").isNotNull(), "ok").otherwise(F.coalesce("_s", F.lit("failed")))
    return joined.select("id", "key", "answer", status.alias("status"), F.when(F.col("answer").isNull(), F.col("_e")).alias("error"))


def ask_guarded(prompts: DataFrame, provider: ModelProvider, stop_after: int = 4, **options) -> DataFrame:
    """The first stop_after prompts by key are asked alone; where each of them fails, the endpoint is given up and nothing else is asked.

    This counts for the endpoint and not for a task; the driver gets stop_after rows.
    """
    keyed = prompts.withColumn("key", cache_key(F.lit(provider.name), "system", "user"))
    first = [r["key"] for r in keyed.select("key").distinct().orderBy("key").limit(stop_after).collect()]
    tried = ask_all(prompts.filter(cache_key(F.lit(provider.name), "system", "user").isin(*first)), provider, **options) if first else None
    if tried is None:
        return ask_all(prompts, provider, **options)
    known = tried.filter("answer IS NOT NULL").select("key", "answer").distinct().collect()
    if not known and len(first) == stop_after:
        return keyed.select("id", "key", F.lit(None).cast("string").alias("answer"), F.lit("failed").alias("status"), F.lit("endpoint given up").alias("error"))
    answers = prompts.sparkSession.createDataFrame([(r["key"], r["answer"]) for r in known], "key string, answer string")
    return ask_all(prompts, provider, answers, **options)


def embed_all(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 16, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """(id, text) to id, embedding, error. Equal texts are embedded once, batch at a time; a batch that fails is tried again, later
    each time, and then its texts are rows with an error."""
    import time

    wanted = texts.select("text").filter("text IS NOT NULL").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said, out = rows["text"].tolist(), []
            for at in range(0, len(said), batch):
                part, error = said[at : at + batch], None
                for attempt in range(tries):
                    try:
                        found = embed(part)
                        out += [(t, [float(x) for x in v], None) for t, v in zip(part, found, strict=True)]
                        error = None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < tries:
                            time.sleep(pause * 2**attempt)
                if error:
                    out += [(t, None, error) for t in part]
            yield pd.DataFrame(out, columns=["text", "embedding", "error"])

    return texts.select("id", "text").join(wanted.mapInPandas(run, "text string, embedding array<double>, error string"), "text", "left").select("id", "embedding", "error")


def embed_cached(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, path: str, **options) -> DataFrame:
    """embed_all() with a table of vectors at path by model and text: known ones aren't embedded, new ones are written there, failures aren't."""
    from quillspark.sources.files import append_new, exists

    spark, schema = texts.sparkSession, "key string, embedding array<double>"
    keyed = texts.select("id", "text", F.sha2(F.concat(F.lit(f"{model}\0"), "text"), 256).alias("key"))
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else None
    fresh = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    wanted = fresh.filter("text IS NOT NULL").dropDuplicates(["key"]).select(F.col("key").alias("id"), "text")
    told = written(embed_all(wanted, embed, **options), "vectors").withColumnRenamed("id", "key")
    append_new(told.filter("embedding IS NOT NULL").select("key", "embedding"), path, ["key"])
    good = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    failed = told.filter("embedding IS NULL").select("key", "error")
    return keyed.select("id", "key").join(good, "key", "left").join(failed, "key", "left").select("id", "embedding", "error")


class Truncated(Exception):
    """A reply that the token budget cut off."""


class Escalating:
    """Asks with three times the budget after each reply that was cut off, up to a cap. ask(system, user, budget) is the endpoint."""

    def __init__(self, name: str, ask: Callable[[str, str, int], str], budget: int = 1000, most: int = 27_000):
        self.name, self._ask, self.budget, self.most = name, ask, budget, most

    def ask(self, system: str, user: str) -> str:
        budget = self.budget
        while True:
            try:
                return self._ask(system, user, budget)
            except Truncated:
                if budget >= self.most:
                    raise
                budget = min(3 * budget, self.most)


def call_log(answers: DataFrame, most: int = 4000) -> DataFrame:
    """A call's row for the log: key, status, the first characters of the answer, and the error."""
    return answers.select("key", "status", F.substring("answer", 1, most).alias("raw"), "error")

"""Questions put to a model section by section, in passes, by a panel and blind (2.N): each is ask_all() over rows, so a failed call is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.provider import ModelProvider, ask_all

FULL = "Give this section's capabilities, authority, defers_to, consumes and produces as one JSON object of lists."
MINIMAL = "Give this section's capabilities, authority and defers_to as one JSON object of lists."


def listed(names: tuple[str, ...]):
    """A validator: a JSON object with a list under each name; what it says is sent back with the question."""
    import json

    def fault(said: str) -> str | None:
        try:
            got = json.loads(said)
        except ValueError:
            return "the reply must be one JSON object"
        if not isinstance(got, dict):
            return "the reply must be a JSON object"
        return next((f"'{n}' must be an array" for n in names if not isinstance(got.get(n), list)), None)

    return fault


FULL_LISTS = ("capabilities", "authority", "defers_to", "consumes", "produces")


def catalogue(sections: DataFrame, provider: ModelProvider, runs: int = 1) -> DataFrame:
    """(slug, position, text) asked runs times for the whole schema, and where that fails for the small one: slug, position,
    pass, answer, degraded, error. Passes are joined by content afterwards (G26)."""
    asked = sections.select("slug", "position", "text", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("pass")).withColumn("id", F.struct("slug", "position", "pass"))
    prompt = lambda df, system: df.select("id", F.concat(F.lit(f"{system} Pass "), F.col("pass").cast("string"), F.lit(".")).alias("system"), F.col("text").alias("user"))
    full = ask_all(prompt(asked, FULL), provider, valid=listed(FULL_LISTS)).select("id", F.col("answer").alias("full"), F.col("error").alias("e0"))
    left = asked.join(full.filter("full IS NULL").select("id"), "id", "left_semi")
    small = ask_all(prompt(left, MINIMAL), provider, valid=listed(FULL_LISTS[:3])).select("id", F.col("answer").alias("small"), F.col("error").alias("e1"))
    both = asked.select("id").join(full, "id").join(small, "id", "left")
    answer = F.coalesce("full", "small")
    return both.select("id.slug", "id.position", "id.pass", answer.alias("answer"), (F.col("full").isNull() & F.col("small").isNotNull()).alias("degraded"), F.when(answer.isNull(), F.coalesce("e1", "e0")).alias("error"))


def passes_of(read: DataFrame, runs: int) -> DataFrame:
    """How many passes answered each section, and how many with the whole schema."""
    each = read.groupBy("slug", "position").agg(F.count("answer").alias("passes"), F.count_if(F.col("answer").isNotNull() & ~F.col("degraded")).alias("full_passes"))
    return each.withColumn("short", F.col("passes") < runs)


def panel(questions: DataFrame, document: str, readers: dict[str, ModelProvider]) -> DataFrame:
    """Every reader's answer to each question (qid, question) over the whole document: qid, model, answer, error."""
    out = None
    for name, provider in sorted(readers.items()):
        asked = questions.select(F.col("qid").alias("id"), F.lit("Answer from the document alone, with quotes.").alias("system"), F.concat(F.lit(document + "\n\n"), "question").alias("user"))
        told = ask_all(asked, provider).select(F.col("id").alias("qid"), F.lit(name).alias("model"), "answer", "error")
        out = told if out is None else out.unionByName(told)
    return out


def blind(answers: DataFrame, salt: str = "") -> DataFrame:
    """Readers by letters, in an order that hides their names and is another one for each question."""
    order = F.xxhash64(F.lit(salt), F.col("qid").cast("string"), "model")
    place = F.row_number().over(W.partitionBy("qid").orderBy(order, "model"))
    return answers.withColumn("label", F.concat(F.lit("Reader "), F.char(place + 64)))


def graded(answers: DataFrame, judge: ModelProvider) -> DataFrame:
    """A judge grades blind answers: qid, label, grade; names are joined back only here."""
    told = blind(answers)
    asked = told.filter("answer IS NOT NULL").select(F.struct("qid", "label").alias("id"), F.lit("Grade the answer.").alias("system"), F.concat_ws("\n", F.lit("Answer of"), "label", "answer").alias("user"))
    grades = ask_all(asked, judge).select("id.qid", "id.label", F.col("answer").alias("grade"))
    return told.join(grades, ["qid", "label"], "left").select("qid", "model", "label", "grade")


def outcome_first(rows: DataFrame, provider: ModelProvider) -> DataFrame:
    """(id, comment, passage): what would settle a comment is asked without the document, and the verdict with both."""
    wanted = ask_all(rows.select("id", F.lit("What would settle this comment? The document is withheld.").alias("system"), F.col("comment").alias("user")), provider)
    both = rows.join(wanted.select("id", F.col("answer").alias("outcome")), "id")
    verdict = ask_all(both.select("id", F.lit("Does the passage show the outcome?").alias("system"), F.concat_ws("\n\n", "comment", "outcome", "passage").alias("user")), provider)
    return both.select("id", "outcome").join(verdict.select("id", F.col("answer").alias("verdict"), "error"), "id")

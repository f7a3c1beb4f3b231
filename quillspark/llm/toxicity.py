"""Toxicity by subword bags (op 8).

A word is the mean of the embeddings of itself and of its character n-grams, hashed into a fixed table; a
document is the mean of its words, each by the root of its count, times a fixed scale; a linear softmax reads it. Table and
softmax are trained together in numpy, with a price on the length of each row, so that only n-grams which speak for a class
in many texts keep a vector. An unseen misspelling shares most n-grams with the word it hides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt
from operator import mul

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside, labelled_sample, materialise, prepare, remainder, texts, whole_rows

WORD = re.compile(r"\w+").findall
#: Rows of the embedding table and numbers in each; the model's size is fixed by them. Characters of an n-gram.
BUCKETS, WIDTH = 1 << 20, 4
GRAMS = (3, 4, 5, 6)
#: What the mean of a document's words is multiplied with: toxic words are few among many.
SCALE = 50.0
#: Blank words, of value 0, that each text gets in addition: a handful of odd words decides less.
PAD = 30
#: Labelled rows of each class that training sees at most, and words of them all: the documented bound. Where the rows have
#: more words, fewer whole rows are taken.
TRAIN_ROWS, TRAIN_WORDS = 2000, 2_000_000
#: The price of a row's length, for one training row (it falls with the root of their number), and the clean class's share of the loss.
PRICE, CLEAN = 0.17, 0.6
#: Training texts that an n-gram must stand in.
LEAST_TEXTS = 3
#: Words that a worker remembers.
MEMORY = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table of all words' n-grams, word after word, and how many each word has; the last one is the word's own."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(marked)), sizes)
    places = np.arange(len(codes))
    rows, owners = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        live = places + n <= ends
        places, hashed, ends, word = places[live], hashed[live], ends[live], word[live]
        hashed = (hashed ^ codes[places + n - 1]) * _STEP
        hashed ^= hashed >> np.uint64(29)
        if n in GRAMS:
            rows.append((hashed * _STEP) >> np.uint64(44))
            owners.append(word)
    rows.append(np.fromiter(map(xxhash.xxh3_64_intdigest, marked), np.uint64, len(marked)) >> np.uint64(44))
    owners.append(np.arange(len(marked)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order].astype(np.int64), np.bincount(owner, minlength=len(marked))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table and their weights in the mean of the text's words."""
    words = Counter(WORD(text.lower()))
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    roots = np.sqrt(np.fromiter(words.values(), float, len(words)))
    rows, sizes = word_rows(list(words))
    weights = np.repeat(roots / (roots.sum() + PAD) / sizes, sizes)
    found, inverse = np.unique(rows, return_inverse=True)
    return found.astype(np.int32), np.bincount(inverse, weights).astype(np.float32)


class SubwordModel:
    """p(toxic) is the softmax of the scaled mean; two classes depend on the difference of its rows only, kept as values and bias."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        """Remembers the values of words, all at once."""
        if len(self.known) >= MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            rows, sizes = word_rows(part)
            sums = np.add.reduceat(self.values[rows], np.cumsum(sizes) - sizes)
            self.known.update(zip(part, (sums / sizes).tolist(), strict=True))

    def word(self, word: str) -> float:
        self.learn([word])
        return self.known[word]

    def scores(self, batch: list[str]) -> list[float]:
        counted = [Counter(WORD(x.lower())) for x in batch]
        self.learn(list(dict.fromkeys(w for words in counted for w in words)))
        value, out = self.known.__getitem__, []
        for words in counted:
            roots = list(map(sqrt, words.values()))
            mean = sum(map(mul, map(value, words), roots)) / (sum(roots) + PAD)
            out.append(float(1 / (1 + np.exp(-np.clip(SCALE * mean + self.bias, -50, 50)))))
        return out


#: Entries of bags that are worked on at once.
BLOCK = 1_000_000


class Loss:
    """The weighted log loss of documents (their bags side by side) as a function of table, softmax and bias, and its gradients.

    Twelve bytes an entry are kept, and sums are made block by block.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, labels: np.ndarray, share: np.ndarray, width: int):
        self.rows, self.cols, self.weights, self.labels, self.share, self.width = rows, cols, weights, labels, share, width

    def sums(self, to: np.ndarray, size: int, value) -> np.ndarray:
        """The sums of value(block) by the numbers in to."""
        out = np.zeros(size)
        for at in range(0, len(to), BLOCK):
            block = slice(at, at + BLOCK)
            out += np.bincount(to[block], value(block), size)
        return out

    def only(self, keep: np.ndarray) -> Loss:
        """The same over the columns marked in keep, numbered anew."""
        live = keep[self.cols]
        number = (np.cumsum(keep) - 1).astype(np.int32)
        return Loss(self.rows[live], number[self.cols[live]], self.weights[live], self.labels, self.share, int(keep.sum()))

    def margins(self, table: np.ndarray, out: np.ndarray, bias: float) -> np.ndarray:
        """What the softmax reads from each document's mean. The mean of rows times out is the mean of the rows' products with it."""
        value = table @ out
        return self.sums(self.rows, len(self.labels), lambda b: value[self.cols[b]] * self.weights[b]) + bias

    def value(self, table: np.ndarray, out: np.ndarray, bias: float) -> float:
        return float((self.share * np.logaddexp(0, -self.margins(table, out, bias) * np.where(self.labels == 1, 1, -1))).sum())

    def gradients(self, table: np.ndarray, out: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
        """pull, of which pull[:, None] * out is the table's gradient, and the gradients of out and bias."""
        error = (1 / (1 + np.exp(-np.clip(self.margins(table, out, bias), -50, 50))) - self.labels) * self.share
        pull = self.sums(self.cols, self.width, lambda b: self.weights[b] * error[self.rows[b]])
        return pull, table.T @ pull, float(error.sum())


def _shrunk(table: np.ndarray, by: float) -> np.ndarray:
    """Each row shorter by so much; rows no longer than that vanish."""
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return table * np.maximum(1 - by / np.maximum(size, 1e-12), 0)


def _steepest(loss: Loss) -> float:
    """A bound of the loss's curvature by the table: a quarter of the largest eigenvalue of the weighted bags."""
    x = np.ones(loss.width)
    size = 1.0
    for _ in range(15):
        x /= np.linalg.norm(x)
        seen = loss.share * loss.sums(loss.rows, len(loss.labels), lambda b, x=x: loss.weights[b] * x[loss.cols[b]])
        x = loss.sums(loss.cols, loss.width, lambda b, seen=seen: loss.weights[b] * seen[loss.rows[b]])
        size = float(np.linalg.norm(x))
    return 0.25 * size * 1.05 + 1e-9


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, path: tuple[int, ...] = (16, 8, 4, 2, 1, 1, 1), steps: int = 60, seed: int = 7) -> SubwordModel:
    """Least loss plus the price of the rows' lengths, by accelerated gradient steps with shrinking.

    Rows that would stay 0 needn't be touched: a round trains the rows whose pull exceeds the price, and the next one
    adds those that by then exceed it. The price comes down by rounds, along path, so that few rows are ever trained.
    N-grams of fewer than LEAST_TEXTS texts keep no vector. Each row's weights are brought to one size first, so that the price means the same
    for frequent and rare n-grams. Without both classes: the share of label 1 for all.
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    share = np.where(labels == 1, (1 - CLEAN) / labels.sum(), CLEAN / (1 - labels).sum())
    price = PRICE / sqrt(len(labels))
    # the n-grams of LEAST_TEXTS texts or more, numbered; the others' entries aren't taken up
    texts_with = np.zeros(BUCKETS, np.int32)
    for own, _ in bags:
        texts_with[own] += 1
    used = np.flatnonzero(texts_with >= LEAST_TEXTS)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    kept = [number[own] >= 0 for own, _ in bags]
    rows = np.repeat(np.arange(len(bags), dtype=np.int32), [int(k.sum()) for k in kept])
    cols = np.concatenate([number[own[k]] for (own, _), k in zip(bags, kept, strict=True)])
    weights = np.concatenate([w[k] for (_, w), k in zip(bags, kept, strict=True)]) * np.float32(SCALE)
    del kept
    whole = Loss(rows, cols, weights, labels, share, len(used))
    size = np.sqrt(whole.sums(cols, len(used), lambda b: weights[b].astype(float) ** 2 * share[rows[b]])) + 1e-9
    for at in range(0, len(cols), BLOCK):
        weights[at : at + BLOCK] /= size[cols[at : at + BLOCK]]

    random = np.random.default_rng(seed)
    out = random.normal(size=WIDTH)
    out /= np.linalg.norm(out)
    table, bias, live = np.zeros((len(used), WIDTH)), _even(share, labels), np.zeros(len(used), bool)
    for k, factor in enumerate(path):
        now_price = price * factor
        pull, _, _ = whole.gradients(table, out, bias)
        wanted = live | (np.abs(pull) > now_price)
        if (wanted == live).all() and k and path[k - 1] == factor:
            break
        live = wanted
        if not live.any():
            continue
        part = whole.only(live)
        curve = _steepest(part)
        now = ahead = table[live]
        bias_now = bias_ahead = bias
        pace = 1.0
        for _ in range(steps):
            pull, head, lift = part.gradients(ahead, out, bias_ahead)
            new = _shrunk(ahead - pull[:, None] * out / curve, now_price / curve)
            bias_new = bias_ahead - lift
            faster = (1 + sqrt(1 + 4 * pace * pace)) / 2
            ahead, bias_ahead = new + (pace - 1) / faster * (new - now), bias_new
            now, bias_now, pace = new, bias_new, faster
            # the softmax row turns with the documents; its length is the table's matter
            turned = out - 0.1 * head
            out = turned / np.linalg.norm(turned)
        table[live], bias = now, bias_now
    values = np.zeros(BUCKETS, np.float32)
    values[used] = (table @ out) / size
    return SubwordModel(values, float(bias))


def _even(share: np.ndarray, labels: np.ndarray) -> float:
    """The bias that fits best alone."""
    toxic = float(share[labels == 1].sum())
    return float(np.log(toxic / (share.sum() - toxic)))


def fit(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS) -> SubwordModel:
    """Bags are made where the texts are; one task trains on those of 2 x rows documents, of TRAIN_WORDS words in all at most.

    A lost executor costs that task, not the driver; the driver gets the rows of the table that have a vector, as values.
    """
    sample = materialise(labelled_sample(docs, labels, "toxic", keep, rows), "labelled")
    sample = whole_rows(sample, beside(sample, ["doc_id", "y"], "text", lambda batch: [(len(WORD(x.lower())),) for x in batch], "n long"), TRAIN_WORDS)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [bag(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "rows": [a.tobytes() for a, _ in own], "weights": [b.tobytes() for _, b in own]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, said = [], []
        for batch in batches:
            bags += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(batch["rows"], batch["weights"], strict=True)]
            said += batch["y"].tolist()
        model = train(bags, np.array(said))
        found = np.flatnonzero(model.values)
        yield pd.DataFrame({"row": np.append(found, -1).astype(np.int64), "value": np.append(model.values[found].astype(float), model.bias)})

    made = sample.mapInPandas(make, "doc_id long, y int, rows binary, weights binary")
    learned = made.repartition(1).sortWithinPartitions("doc_id", "y").mapInPandas(learn, "row long, value double").collect()
    values, bias = np.zeros(BUCKETS, np.float32), None
    for r in learned:
        if r["row"] >= 0:
            values[r["row"]] = r["value"]
        else:
            bias = r["value"]
    return SubwordModel(values, train([], np.empty(0)).bias if bias is None else bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores every whole text; returns doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(doc_id as text) mod folds isn't held; at most rows of each class
    and TRAIN_WORDS words train the model, which has a fixed size. Null and empty texts score as the
    bias does; without labels of both classes all documents score alike. Repeated rows score alike; null ids
    are kept, with held_out false; further columns are left out; an empty table gives no rows. Scoring has no shuffle.
    """
    spark = prepare(docs.sparkSession).sparkContext
    model = fit(docs, labels, remainder(F.col("doc_id"), folds) != held, rows)
    shared = spark.broadcast((model.values, model.bias))

    worker: list[SubwordModel] = []

    def each(batch: list[str]) -> list[tuple[float]]:
        if not worker:  # one model, with its memory of words, for each task
            worker.append(SubwordModel(*shared.value))
        return [(x,) for x in worker[0].scores(batch)]

    out = beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", each, "score double")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns. Trained as score_toxicity() is; texts stay where they are."""
    spark = prepare(docs.sparkSession).sparkContext
    model = fit(docs, labels, remainder(F.col("doc_id"), folds) != held, rows)
    shared = spark.broadcast((model.values, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = SubwordModel(*shared.value)
        for batch in batches:
            yield pd.Series(own.scores(batch.tolist()), dtype="float64")

    return docs.withColumn("__score", score.asNondeterministic()(F.coalesce(F.col("text"), F.lit("")))).filter("__score < 0.5").select(*docs.columns)

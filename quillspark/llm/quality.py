"""Document quality by a linear-chain conditional random field over lines (op 1).

Every line is good or bad; its evidence is its own features and those of the lines before and after it, and
labels of neighbouring lines lean on each other. Forward-backward gives each line's probability of good, and
a document's score is their mean, weighted by line length. The field is trained in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside, labelled_sample, materialise, prepare, remainder, texts, whole_rows

#: Labelled rows of each class that training sees at most, and lines of them all: the documented bound. Where the rows have
#: more lines, fewer whole rows are taken.
TRAIN_ROWS, TRAIN_LINES = 3000, 300_000
#: Share of the loss that good documents have: calling a good one bad costs more.
GOOD_SHARE = 0.6
#: Pull of all weights towards 0.
PULL = 1e-4

NAMES = "upper symbols pipes marks digits exclaims length word_length repeated_line repeated_words sentence_end accents few_words neighbours_equal".split()


def _class_table() -> np.ndarray:
    """Bits of a code point: 1 capital, 2 letter, 4 symbol, 8 pipe, 16 other mark, 32 digit, 64 exclamation mark."""
    out = np.zeros(0x3000 + 1, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        out[code] = c.isupper() + 2 * c.isalpha() + 4 * (c in "#*$%&<>~^_=+@\\{}[]") + 8 * (c == "|") + 32 * c.isdigit() + 64 * (c in "!?")
        if not (out[code] or c.isspace()):
            out[code] = 16
    out[0x3000] = 2
    return out


_TABLE: list[np.ndarray] = []


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x len(NAMES)) and lengths of the lines that aren't blank; of a text without any: one empty line."""
    if not _TABLE:
        _TABLE.append(_class_table())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((1, len(NAMES)), np.float32), np.ones(1)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[0][np.minimum(codes, 0x3000)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = lambda bit: np.add.reduceat((kinds & bit) != 0, starts, dtype=np.int64)
    out = np.zeros((len(lines), len(NAMES)), np.float32)
    letters = np.maximum(count(2), 1)
    out[:, 0] = count(1) / letters
    for k, bit in enumerate((4, 8, 16, 32, 64), 1):
        out[:, k] = np.minimum(10 * count(bit) / sizes, 3)
    out[:, 6] = np.log1p(sizes) / 5
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        out[i, 7] = min((sizes[i] - n + 1) / n / 10, 3)
        out[i, 8] = line in seen
        seen.add(line)
        out[i, 9] = 1 - len(set(words)) / n
        out[i, 10] = line.rstrip()[-1] in ".!?:;\"'”»)"
        out[i, 12] = n < 3
        out[i, 13] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[:, 11] = np.add.reduceat((codes > 127) & ((kinds & 2) != 0), starts, dtype=np.int64) / letters
    return out, sizes.astype(float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, first and last marks, and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.zeros((len(own), 3), np.float32)
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = 1
    return np.hstack([own, before, after, ends])


COLUMNS = 3 * len(NAMES) + 3


class Chains:
    """Documents' lines side by side, longest document first, so that step t touches a prefix of the documents."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.array([int(np.searchsorted(-self.lengths, -t, side="left")) for t in range(steps)])
        self.rows = [begins[:n] + t for t, n in enumerate(self.active)]

    def marginals(self, node: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """p(good) of each row, the sum of p(label, next label) over documents by weight 1, and log Z by document.

        node: evidence for good against bad of each row. link: 2 x 2 scores of neighbouring labels.
        """
        steps, pair = len(self.rows), np.exp(link)
        ahead, scale = [], np.zeros(len(self.lengths))
        for t, rows in enumerate(self.rows):
            good = np.clip(node[rows], -30, 30)
            local = np.stack([np.exp(-np.maximum(good, 0)), np.exp(np.minimum(good, 0))], axis=1)
            scale[: len(rows)] += np.maximum(good, 0)
            now = local if t == 0 else local * (ahead[-1][: len(rows)] @ pair)
            total = now.sum(axis=1, keepdims=True)
            scale[: len(rows)] += np.log(total[:, 0])
            ahead.append(now / total)
        out, pairs = np.zeros(len(node)), np.zeros((len(self.lengths), 2, 2))
        behind = np.zeros((0, 2))
        for t in range(steps - 1, -1, -1):
            rows, n = self.rows[t], len(behind)
            back = np.ones((len(rows), 2))
            if n:
                after = self.rows[t + 1]
                good = np.clip(node[after], -30, 30)
                local = np.stack([np.exp(-np.maximum(good, 0)), np.exp(np.minimum(good, 0))], axis=1) * behind
                both = ahead[t][:n, :, None] * pair[None] * local[:, None, :]
                pairs[:n] += both / both.sum(axis=(1, 2), keepdims=True)
                back[:n] = local @ pair.T
            both = ahead[t] * back
            out[rows] = both[:, 1] / both.sum(axis=1)
            behind = back / back.sum(axis=1, keepdims=True)
        return out, pairs, scale


class LineField:
    def __init__(self, weights: np.ndarray, link: np.ndarray):
        self.weights, self.link = weights, link

    @classmethod
    def fit(cls, documents: list[np.ndarray], labels: np.ndarray, steps: int = 250, rate: float = 0.05) -> LineField:
        """Maximum likelihood of each line having its document's label, by Adam. Without both classes: no evidence but the share of label 1."""
        labels = np.asarray(labels, float)
        weights, link = np.zeros(COLUMNS), np.zeros((2, 2))
        if not len(labels) or labels.min() == labels.max():
            share = float(labels.mean()) if len(labels) else 0.5
            weights[-1] = np.log((share + 0.01) / (1.01 - share))
            return cls(weights, link)
        lengths = np.array([len(x) for x in documents])
        rows = np.concatenate([with_neighbours(x) for x in documents]).astype(float)
        chains = Chains(lengths)
        # a document counts once, however many lines it has
        share = np.where(labels == 1, GOOD_SHARE / labels.sum(), (1 - GOOD_SHARE) / (1 - labels).sum()) / np.sqrt(lengths)
        per_row, target = np.repeat(share, lengths), np.repeat(labels, lengths)
        by_chain = share[chains.order]
        same = labels[chains.order].astype(int)
        links = (chains.lengths - 1) * by_chain
        wanted = np.array([[links[same == 0].sum(), 0], [0, links[same == 1].sum()]])
        theta = np.zeros(COLUMNS + 4)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            p, pairs, _ = chains.marginals(rows @ theta[:COLUMNS], theta[COLUMNS:].reshape(2, 2))
            down = np.concatenate([rows.T @ (per_row * (p - target)), ((pairs * by_chain[:, None, None]).sum(axis=0) - wanted).ravel()]) + PULL * theta
            first, second = 0.9 * first + 0.1 * down, 0.99 * second + 0.01 * down**2
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:COLUMNS], theta[COLUMNS:].reshape(2, 2))

    def scores(self, documents: list[str]) -> list[float]:
        parts = [line_features(x) for x in documents]
        if not parts:
            return []
        node = np.concatenate([with_neighbours(f) @ self.weights for f, _ in parts])
        lengths = np.array([len(f) for f, _ in parts])
        p, _, _ = Chains(lengths).marginals(node, self.link)
        weight = np.concatenate([w for _, w in parts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return (np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)).tolist()


def fit(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS) -> LineField:
    """Features are made where the texts are; one task trains on those of 2 x rows whole documents, of TRAIN_LINES lines in all at most."""
    sample = labelled_sample(docs, labels, "quality", keep, rows)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "f": [line_features(x)[0].tobytes() for x in batch["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, said = [], []
        for batch in batches:
            found += [np.frombuffer(f, np.float32).reshape(-1, len(NAMES)) for f in batch["f"]]
            said += batch["y"].tolist()
        field = LineField.fit(found, np.array(said))
        yield pd.DataFrame({"value": [*field.weights, *field.link.ravel()]})

    made = materialise(sample.mapInPandas(make, "doc_id long, y int, f binary"), "lines")
    made = whole_rows(made, made.select("doc_id", "y", F.expr(f"octet_length(f) div {4 * len(NAMES)}").alias("n")), TRAIN_LINES)
    learned = made.repartition(1).sortWithinPartitions("doc_id", "y", "f").mapInPandas(learn, "value double").collect()
    values = np.array([r["value"] for r in learned])
    return LineField(values[:COLUMNS], values[COLUMNS:].reshape(2, 2)) if len(values) else LineField.fit([], np.empty(0))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores every whole text; returns doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(doc_id as text) mod folds isn't held; at most rows of each class and
    TRAIN_LINES lines train the field, which has a fixed size. Null and empty texts score as one empty line does;
    without labels of both classes all documents score by the share of label 1. Repeated rows score alike; null
    ids are kept, with held_out false; further columns are left out; an empty table gives no rows. No shuffle.
    """
    spark = prepare(docs.sparkSession).sparkContext
    field = fit(docs, labels, remainder(F.col("doc_id"), folds) != held, rows)
    shared = spark.broadcast((field.weights, field.link))

    def each(batch: list[str]) -> list[tuple[float]]:
        return [(x,) for x in LineField(*shared.value).scores(batch)]

    out = beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", each, "score double")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

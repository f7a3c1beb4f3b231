"""Encoding and decoding whole documents (op 7) and counting their tokens (op 10)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import beside, prepare, texts


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digests: bool = True) -> DataFrame:
    """Ids of every whole text and the bytes they decode to.

    Ids come from the linear-time walk in bpe.py. Returns doc_id, n_tokens, and with digests the SHA-256 of
    the decimal ids joined by blanks and of the decoded bytes; without them ids ARRAY<INT> and decoded BINARY.
    Null and empty texts have no tokens. Rows are independent: repeated rows, ties in doc_id and further
    columns change nothing; an empty table gives no rows. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    ranks_path = ranks_path or bpe.public_path("byte_bpe_50k.tiktoken")
    pattern = pattern or bpe.public_pattern()

    def each(batch: list[str]) -> list[tuple]:
        coder = bpe.encoder(ranks_path, pattern)
        names, out = coder.names, []
        for text in batch:
            ids = np.frombuffer(coder.encode(text), dtype="<u4").tolist()
            back = coder.decode(ids)
            if digests:
                out.append((len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            else:
                out.append((len(ids), ids, back))
        return out

    schema = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", each, schema)


@lru_cache(maxsize=2)
def prove_alone(vocabulary_path: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """Offline: the vocabulary strings that a tokenizers file's merges turn into one token, and its special strings.

    A string is kept only if its bytes, merged step by step, end as exactly one token. Strings that aren't
    whole UTF-8 never equal a pre-token and are left out.
    """
    import json

    from tokenizers import Tokenizer

    with open(vocabulary_path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
    order = {bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" "))): i for i, m in reversed(list(enumerate(spec["model"]["merges"])))}
    order |= {b: -1 for b in ranks if len(b) == 1}
    alone = set()
    for b in ranks:
        if len(bpe.merge(b, order)) == 1:
            try:
                alone.add(b.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    special = tuple(x["content"] for x in spec["added_tokens"])
    assert Tokenizer.from_file(vocabulary_path).get_vocab_size() >= len(ranks)
    return frozenset(alone), special


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by its rule, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_COUNTERS: dict[str, bpe.Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as the tokenizers library counts them without added special tokens.

    The strings that stand alone are proved once on the driver (at most one vocabulary, 50 thousand strings)
    and sent with the task. Special strings inside a text count as one token, the library's default.
    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null and empty texts have 0 bytes and
    tokens. Rows are independent; further columns are left out; an empty table gives no rows; no shuffle.
    """
    spark = prepare(docs.sparkSession).sparkContext
    vocabulary_path = vocabulary_path or bpe.public_path("byte_bpe_50k.json")
    pattern = pattern or bpe.public_pattern()
    proved = spark.broadcast(prove_alone(vocabulary_path))

    def each(batch: list[str]) -> list[tuple[int, int]]:
        if vocabulary_path not in _COUNTERS:
            from tokenizers import Tokenizer

            alone, special = proved.value
            model = Tokenizer.from_file(vocabulary_path).model
            _COUNTERS[vocabulary_path] = bpe.Counter(alone, pattern, special, lambda piece: len(model.tokenize(as_letters(piece))))
        counter = _COUNTERS[vocabulary_path]
        return [(len(x.encode("utf-8")), counter.count(x)) for x in batch]

    out = beside(texts(docs.select("doc_id", "text")), ["doc_id"], "text", each, "n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


_LETTERS = {v: k for k, v in byte_letters().items()}


def as_letters(piece: str) -> str:
    return "".join(map(_LETTERS.__getitem__, piece.encode("utf-8")))

"""The ten training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, components, extraction, fingerprint, lines, nearjoin, packing, perplexity, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = [None, "", " ", "\n\n", "a", "the cat", "x" * 30_000, "word " * 4_000, "naïve café 漢字 😀 ½ ٣\x1c\x85 end", "<|endoftext|> a <|endoftext|>", "a\n\na\n", "'s 't  two   blanks\t\ttabs\r\n"]


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and special texts, one repeated row and one row without an id or anything else."""
    base = documents(spark, ODD)
    return base.unionByName(base.filter("doc_id = 5")).unionByName(spark.createDataFrame([(None,) * 6], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, words=600):
    rnd = random.Random(seed)
    stock = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8))) for _ in range(words)]
    return [" ".join(rnd.choice(stock) for _ in range(rnd.randrange(20, 80))).capitalize() + "." for _ in range(n)]


# 7 and 10: tokens


def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.read_ranks(bpe.public_path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    return plain, Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))


def test_encoding_is_the_library_s_and_round_trips(spark, odd, none):
    plain, _ = libraries()
    got = {r["doc_id"]: r for r in tokens.encode_documents(odd).collect()}
    assert tokens.encode_documents(odd).count() == len(ODD) + 2 and tokens.encode_documents(none).count() == 0
    for i, text in enumerate(ODD):
        ids = plain.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_linear_walk_equals_plain_merging():
    coder = bpe.encoder(bpe.public_path("byte_bpe_50k.tiktoken"), bpe.public_pattern())
    rnd = random.Random(3)
    for _ in range(1500):
        piece = bytes(rnd.choice(b"ab theing\x80\xc3\xa9\xff") for _ in range(rnd.randrange(1, 40)))
        assert coder.bpe.encode(piece) == bpe.merge(piece, coder.bpe.ranks)
        assert bpe.merged_length(piece * 3, coder.bpe.ranks) == len(bpe.merge(piece * 3, coder.bpe.ranks))


def test_fast_pattern_equals_the_public_one():
    pieces, rnd = bpe.Pieces(bpe.public_pattern()), random.Random(4)
    for _ in range(2000):
        text = "".join(rnd.choice("ab'stll  \n\t.,!?12é²½ß_-\xa0\x0b—") for _ in range(rnd.randrange(60)))
        assert pieces.common(text) and pieces.fast(text) == pieces.every(text)


def test_counts_are_the_library_s(odd, none):
    _, library = libraries()
    got = {r["doc_id"]: r for r in tokens.count_tokens(odd).collect()}
    for i, text in enumerate(ODD):
        assert got[i]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids) and got[i]["n_bytes"] == len((text or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 512)
    assert tokens.count_tokens(none).count() == 0
    alone, special = tokens.prove_alone(bpe.public_path("byte_bpe_50k.json"))
    assert special == ("<|endoftext|>",) and " the" in alone


# 3: packing


def check_packed(out, docs, capacity=1024):
    _, library = libraries()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    for i, text in docs:
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_and_tight(spark, none):
    texts = [*ODD, *prose(1, 150)]
    out = packing.pack_documents(documents(spark, texts)).collect()
    total = sum(r["length"] for r in out)
    assert check_packed(out, list(enumerate(texts))) <= -(-total // 1024) + 1
    assert packing.pack_documents(none).count() == 0
    small = packing.pack_documents(documents(spark, texts), group_rows=20).collect()
    assert check_packed(small, list(enumerate(texts))) <= -(-total // 1024) + 4
    twice = documents(spark, ["a b c"]).unionByName(documents(spark, ["a b c"]))
    assert packing.pack_documents(twice).count() == 2


def fewest(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_bounds_never_pass_the_optimum():
    rnd = random.Random(5)
    for _ in range(150):
        sizes = np.array([rnd.randrange(1, 41) for _ in range(rnd.randrange(1, 9))])
        bins, places, filled = packing.best_fit_decreasing(sizes, 40)
        assert filled.max() <= 40 and packing.lower_bound(sizes, 40) <= fewest(sizes.tolist(), 40) <= len(filled)
    assert packing.lower_bound(np.array([21] * 7), 40) == 7 and packing.lower_bound(np.array([14] * 6), 40) == 3


# 4: lines


def test_lines_against_sql_and_counts(spark, odd, none):
    import duckdb

    texts = ["menu\nown 0", "own 1\n menu ", "menu\nmenu\nx", "", None, "menu", "legal\nz", "legal"] * 2
    df = documents(spark, texts)
    got = lines.dedupe_lines(df, min_sites=3).select("doc_id", "n_lines", "n_removed", "text")
    d = df.toPandas()
    wanted = duckdb.sql(lines.ORACLE.format(documents="d", min_sites=3) + "SELECT doc_id, n_lines, n_removed, text FROM d").fetchall()
    assert sorted(tuple(r) for r in got.collect() if r["text"] is not None) == sorted(wanted)
    assert [r["n_lines"] for r in got.collect() if r["text"] is None] == [0, 0]
    assert lines.dedupe_lines(odd).count() == len(ODD) + 2 and lines.dedupe_lines(none).count() == 0
    assert lines.dedupe_lines(odd).columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_removed"]


CLASHING = "row u n sig size grp bin place root count block pos line line_key key score bits kept held_out predicted n_lines n_removed class_id rep v m a b words".split()


def test_columns_of_clashing_names_do_no_harm(spark):
    texts = [*prose(22, 30), None, ""]
    docs = documents(spark, texts).select("*", *[F.lit("odd").alias(c) for c in CLASHING])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("odd"))
    n = len(texts)
    assert lines.dedupe_lines(docs).select("n_lines").distinct().count() == 2
    assert nearjoin.near_duplicates(docs).count() == n and nearjoin.keep_one(docs).columns == docs.columns
    assert packing.pack_documents(docs).count() == n and tokens.count_tokens(docs).count() == n and tokens.encode_documents(docs).count() == n
    assert perplexity.quality_rules(docs).count() == n and perplexity.keep_good(docs).columns == docs.columns
    assert quality.score_quality(docs, labels).count() == n and toxicity.keep_clean(docs, labels).columns == docs.columns
    assert fingerprint.fingerprint_edits(docs).count() == n


def test_line_spread_near_the_threshold_is_exact(spark):
    rows = [(k, "common line", "en", f"s{k}", 0, "") for k in range(9)] + [(100 + k, "wide line", "en", f"s{k}", 0, "") for k in range(10)]
    got = lines.dedupe_lines(spark.createDataFrame(rows, SCHEMA), min_sites=10)
    assert got.filter("text = 'common line'").count() == 9 and got.filter("text = 'wide line'").count() == 1


# 9: near duplicates


def brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent, links = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if (u == 0) or len(sets[a] & sets[b]) / u >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [(i, top(i), links[i]) for i in range(len(texts))]


def near_texts():
    rnd = random.Random(6)
    out = []
    for base in prose(7, 25):
        words = base.split()
        out.append(base)
        for _ in range(rnd.choice((0, 1, 6))):
            edit = list(words)
            for _ in range(rnd.randrange(0, 3)):
                edit[rnd.randrange(len(edit))] = rnd.choice(("zz", "yy"))
            out.append(" ".join(edit))
    return out + [None, "", " ", "a b", "a b", "a b c", *prose(8, 3)[:1] * 3]


@pytest.mark.parametrize("block", [400, 7])
def test_near_duplicates_equal_brute_force(spark, none, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "BLOCK_TEXTS", block)
    texts = near_texts()
    got = nearjoin.near_duplicates(documents(spark, texts).repartition(5))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute(texts)
    kept = nearjoin.keep_one(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(texts)})
    assert nearjoin.near_duplicates(none).count() == 0


def test_matrix_and_single_verification_agree():
    rnd = random.Random(9)
    sets = [np.unique(np.array([rnd.randrange(40) for _ in range(30)], np.uint64)) for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    many = nearjoin.verify(left, right, sets, 0.5)
    one = [nearjoin.verify(left[k : k + 1], right[k : k + 1], sets, 0.5)[0] for k in range(len(left))]
    assert many.tolist() == one


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7), (5, 5), (2, 1)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 1), (8, 8), (9, 8)]


# 5: language model


def test_kneser_ney_sums_to_one_and_counts_are_exact(spark):
    texts = prose(10, 40) + [None, ""]
    keys, counts = perplexity.count_grams(documents(spark, texts))
    wanted = Counter(int(g) for t in texts for g in perplexity.grams(t or ""))
    del wanted[0]
    assert {k: c for k, c in zip(keys.tolist(), counts.tolist()) if k} == dict(wanted)
    model = perplexity.KneserNey.fit(keys, counts)
    for context in (int(keys[len(keys) // 2]) // 64, 12345, 0):
        assert abs((2.0 ** model.log2(np.arange(64) + 64 * context)).sum() - 1) < 1e-4
    assert model.bits(texts[0]) < model.bits("QX#ZJ§ 88%% VVKQ")


def slow_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_equal_a_plain_count_and_verdicts_hold(spark, odd, none):
    rnd = random.Random(11)
    for _ in range(300):
        text = "".join(rnd.choice(("a ", "b ", "c\n", "# ", "a\n", "\t")) for _ in range(rnd.randrange(60)))
        assert perplexity.base_rules(text) == slow_rules(text)
    good = prose(12, 300)
    noisy = good + ["%% ".join(x.upper().split()) for x in prose(13, 6)]
    out = {r["doc_id"]: r for r in perplexity.quality_rules(documents(spark, noisy)).collect()}
    assert sum(out[i]["kept"] for i in range(300)) >= 295 and not any(out[i]["kept"] for i in range(300, 306))
    assert perplexity.quality_rules(odd).count() == len(ODD) + 2 and perplexity.quality_rules(none).count() == 0
    assert perplexity.keep_good(documents(spark, noisy)).count() == sum(r["kept"] for r in out.values())


def test_bands_of_both_tiers(spark):
    cases = [(k, 0.0, 100) for k in (-4.2, -3.8, 3.8, 4.2)] + [(0.0, k, 100) for k in (-8.2, -7.8, 4.8, 5.2)] + [(0.0, None, 100)]
    m = "named_struct('bits', 2 + k * 0.5 / 20, 'n_symbols_all', 400L, 'n_words', 50L, 'n_repeat_words', 0L)"
    rows = spark.createDataFrame(cases, "k double, w double, n long").selectExpr("k", "w", "'en' AS lang", f"{m} AS __m", "9 + w * 2.0 / 10 AS __word_bits", "n AS __n_tokens")
    limits = spark.createDataFrame([("en", 2.0, 9.0, 0.5, 2.0)], "__lang string, __middle double, __word_middle double, __width double, __word_width double")
    got = [r["__kept"] for r in perplexity.judged(rows, limits).orderBy("k", "w").collect()]
    assert sorted(got) == [False] * 4 + [True] * 5 and {r["k"] for r in perplexity.judged(rows, limits).filter("not __kept and w = 0").collect()} == {-4.2, 4.2}


@pytest.mark.parametrize("unit", [32_000_000, 900])
def test_word_bits_equal_a_plain_count(spark, odd, monkeypatch, unit):
    """However the texts are cut into units, a word's bits come from its count in all of them, without the occurrence itself."""
    monkeypatch.setattr(perplexity, "UNIT_CHARS", unit)
    texts = [*prose(23, 40, words=80), "naïve café 漢字 x1 x1 x1", "", None, "!!", prose(23, 1, words=80)[0]]
    docs = documents(spark, texts).repartition(3)
    keys, counts = perplexity.count_grams(docs)
    model = perplexity.KneserNey.fit(keys, counts)
    _, got = perplexity.scored(docs, ["doc_id", "lang"])
    every = Counter(w for t in texts for w in re.findall(r"\w+", t or ""))
    total, having = sum(every.values()), Counter(every.values())
    cut = perplexity.discounts_of(*[having[k] for k in (1, 2, 3, 4)])
    free = sum(cut[min(c, 3)] for c in every.values()) / total
    spelled = lambda w: float(model.bits(w) * (len(w) + 1))
    assert np.allclose(model.spelling(list(every)), [spelled(w) for w in every], atol=1e-3)
    for r in got.collect():
        words = re.findall(r"\w+", texts[r["doc_id"]] or "")
        assert r["__n_tokens"] == len(words)
        if words:
            p = [max(every[w] - 1 - cut[min(every[w] - 1, 3)], 0) / total + free * 2 ** -spelled(w) for w in words]
            assert abs(r["__word_bits"] + np.mean(np.log2(p))) < 1e-3
        else:
            assert r["__word_bits"] is None


# 1 and 8: classifiers


def labelled(spark, bad, n=300):
    texts = prose(14, n, words=60)
    texts = [bad(t) if i % 4 == 0 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark, lambda t: " | ".join(t.upper().split()))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    assert quality.score_quality(odd, labels).filter("score between 0 and 1").count() == len(ODD) + 2
    assert quality.score_quality(none, labels).count() == 0 and quality.score_quality(odd, labels.limit(0)).count() == len(ODD) + 2


def test_marginals_equal_brute_force():
    from itertools import product

    rnd = np.random.default_rng(1)
    lengths = np.array([1, 3, 4])
    node, link = rnd.normal(size=8), rnd.normal(size=(2, 2))
    got, _, scale = quality.Chains(lengths).marginals(node, link)
    at = 0
    for k, n in enumerate(lengths):
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(node[at + t] * y[t] for t in range(n)) + sum(link[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        assert np.isclose(scale[list(quality.Chains(lengths).order).index(k)], np.log(total))
        at += n


def test_toxicity_and_unseen_misspellings(spark, odd, none):
    docs, labels = labelled(spark, lambda t: t.replace(" ", " moronic ", 1) + " such blockheads")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    new = documents(spark, [prose(15, 1, words=60)[0] + " moronics blockheadz moroniic"])
    assert toxicity.score_toxicity(new, labels.limit(0)).count() == 1
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.word("blockheadz") > 3 * abs(model.word("zzzzqqqq"))
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD) + 2 and toxicity.score_toxicity(none, labels).count() == 0


def test_gradients_are_finite_differences():
    rnd = np.random.default_rng(2)
    n, width = 12, 9
    rows, cols = np.repeat(np.arange(n), 5), rnd.integers(0, width, 5 * n)
    labels = rnd.integers(0, 2, n).astype(float)
    loss = toxicity.Loss(rows, cols, rnd.random(5 * n), labels, rnd.random(n), width)
    table, out, bias, e = rnd.normal(size=(width, 3)), rnd.normal(size=3), 0.3, 1e-6
    pull, head, lift = loss.gradients(table, out, bias)
    for j in range(width):
        for k in range(3):
            up, down = table.copy(), table.copy()
            up[j, k] += e
            down[j, k] -= e
            assert abs((loss.value(up, out, bias) - loss.value(down, out, bias)) / (2 * e) - pull[j] * out[k]) < 1e-6
    for k in range(3):
        step = np.eye(3)[k] * e
        assert abs((loss.value(table, out + step, bias) - loss.value(table, out - step, bias)) / (2 * e) - head[k]) < 1e-6
    assert abs((loss.value(table, out, bias + e) - loss.value(table, out, bias - e)) / (2 * e) - lift) < 1e-6
    half = loss.only(np.arange(width) % 2 == 0)
    assert np.allclose(half.gradients(table[::2], out, bias)[0], loss.gradients(np.where(np.arange(width)[:, None] % 2 == 0, table, 0), out, bias)[0][::2])


def test_scores_are_means_of_embeddings():
    rnd = np.random.default_rng(3)
    model = toxicity.SubwordModel(rnd.normal(size=toxicity.BUCKETS).astype(np.float32), 0.2)
    text = "Naïve idiot, idiot! ab x 漢字 " + "long" * 40

    def value(word):
        rows, sizes = toxicity.word_rows([word])
        assert len(rows) == sizes[0] == 1 + sum(max(0, len(word) + 2 - n + 1) for n in (3, 4, 5, 6))
        return model.values[rows].mean()

    words = Counter(re.findall(r"\w+", text.lower()))
    mean = sum(value(w) * c**0.5 for w, c in words.items()) / (sum(c**0.5 for c in words.values()) + toxicity.PAD)
    wanted = 1 / (1 + np.exp(-np.clip(toxicity.SCALE * mean + 0.2, -50, 50)))
    rows, weights = toxicity.bag(text)
    assert np.allclose(model.scores([text, "", text]), [wanted, 1 / (1 + np.exp(-0.2)), wanted], rtol=1e-4)
    assert np.isclose((model.values[rows] * weights).sum(), mean, rtol=1e-4)
    both, _ = toxicity.word_rows(["idiot", "zz"])
    assert both.tolist() == [*toxicity.word_rows(["idiot"])[0], *toxicity.word_rows(["zz"])[0]]


def test_training_is_shared_fairly():
    from quillspark.llm import common

    assert common.fair_share([3, 4], 7) is None and common.fair_share([100, 2, 3], 15) == 10 and common.fair_share([9, 9, 9], 9) == 3


def test_training_takes_whole_rows(spark):
    from quillspark.llm import common

    sizes = {i: 5 + i % 7 for i in range(60)} | {60: 900, 61: 1}
    rows = [(i, i % 2) for i in sizes]
    sample = spark.createDataFrame(rows, "doc_id long, y int")
    n = spark.createDataFrame([(i, y, sizes[i]) for i, y in rows], "doc_id long, y int, n long")
    assert common.whole_rows(sample, n, 10_000) is sample
    got = [(r["doc_id"], r["y"]) for r in common.whole_rows(sample, n, 200).collect()]
    for y in (0, 1):
        own = sum(sizes[i] for i, k in got if k == y)
        assert 100 - 12 < own <= 100
    assert (60, 0) not in got and 10 < len(got) < 62


def test_one_long_text_leaves_the_others_in_training(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_LINES", 400)
    docs, labels = labelled(spark, lambda t: " | ".join(t.upper().split()), 120)
    long = documents(spark, ["x", "Good line here.\n" * 5000]).filter("doc_id = 1").withColumn("doc_id", F.lit(500).cast("long"))
    more = spark.createDataFrame([(500, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs.unionByName(long), labels.unionByName(more)).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


# 2: pages

PARA = "Water rose in the night, slowly at first, then faster, and the gates held until morning came to the town. "


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PARA}<p>{PARA}</article><footer>f</footer>", f"T {PARA.strip()} {PARA.strip()}"),
        (f"<div class='menu'><p>{PARA}</p></div><div id=c><p>{PARA * 3}</p><p>b &lt;\n c</p></div><div class='comments'><p>{PARA * 9}</p></div>", f"{(PARA * 3).strip()}"),
        (f"<article><p>{PARA}</p><form><p>{PARA}</p></form><script>var a='<p>';</script><aside>{PARA}</aside><p>Short one.</p></article>", f"{PARA.strip()} Short one."),
        (f"<article><p>a&#x41;&nbsp;b<br>c</p><p>{PARA}</p><p>cut <b", f"aA b c {PARA.strip()} cut"),
    ],
)
def test_pages(html, wanted):
    got = extraction.main_text(html)
    assert got == wanted or (wanted and "b <" in got and got.startswith(wanted))


def gold_page(seed):
    """A page of known main text amid menus, notices, adverts, comments and forms, and that text."""
    rnd = random.Random(seed)
    sentence = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(8, 20))).capitalize() + rnd.choice((".", ", " + rnd.choice(WORDS) + "."))
    blocks, gold = [], []
    for k in range(rnd.randrange(3, 9)):
        text = " ".join(sentence() for _ in range(rnd.randrange(2, 5)))
        shown = text.replace(" ", rnd.choice((" ", "\n  ")), 3)
        kind = rnd.choice(("p", "p", "p", "h2", "list"))
        if kind == "list" and k:
            items = [sentence() for _ in range(2)]
            blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            gold += items
        else:
            kind = "p" if kind == "list" else kind
            blocks.append(f"<{kind}>{shown}</{kind}>")
            gold.append(text)
    noise = [
        "<nav><ul><li><a href=/>Home</a><li><a href=/n>News, all of it</a></ul></nav>", f"<div class='cookie-consent'><p>{sentence()}</p></div>", f"<aside><p>{sentence()} {sentence()}</p></aside>",
        f"<div class=advert><p>{sentence()}</p></div>", f"<div id=comments><div class=comment><p>{sentence()} {sentence()} {sentence()}</p></div></div>", "<form><label>Mail</label><input><button>Go</button></form>",
        f"<script>var a = '<p>{sentence()}</p>';</script>", f"<footer><p>{sentence()}</p></footer>", "<style>p { margin: 0 }</style>", f"<div class='share-links'><a href=x>{sentence()}</a></div>",
    ]
    rnd.shuffle(noise)
    at = rnd.randrange(len(noise))
    inner, outer = noise[:2], noise[2:]
    for x in inner:
        blocks.insert(rnd.randrange(len(blocks) + 1), x)
    box = rnd.choice(("<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<div><div id=story>{}</div></div>"))
    return "<html><head><title>t</title></head><body>" + "".join(outer[:at]) + box.format("".join(blocks)) + "".join(outer[at:]) + "</body></html>", " ".join(gold)


WORDS = "water night gate town slowly morning river stone bridge field lamp winter letter window garden silver market road engine paper".split()


def test_pages_of_known_text():
    wrong = [seed for seed in range(150) if (p := gold_page(seed)) and extraction.main_text(p[0]) != p[1]]
    assert not wrong


LINKS = "<ul><li><a href=x>One story</a><li><a href=y>Other story here</a></ul>"


@pytest.mark.parametrize(
    ("html", "paragraphs"),
    [
        (f"<main><div><p>{PARA * 2}</p><p>{PARA}</p></div>{LINKS}<div>Posted by Bob: nice read.</div></main>", 3),
        (f"<main><article><p>{PARA * 2}</p><p>{PARA}</p></article><h3>More stories</h3>{LINKS}</main>", 3),
        (f"<article><p>{PARA}</p><p class='social-history'>{PARA}</p><div class='notice'>{PARA}</div><p>{PARA}</p><h3>More</h3>{LINKS}<div class='comments'><p>{PARA}</p></div></article>", 3),
        (f"<article><p>{PARA}</p><p class='search-results-explained'>{PARA}</p><p class='search-results-explained'>Short.</p><div class='related-work-links'>{LINKS}</div></article>", 2),
        (f"<main><article><div class='banner-history'><p>{PARA}</p><p>{PARA}</p></div></article><div class='related-posts'><p>{PARA}</p></div></main>", 2),
    ],
)
def test_only_the_article_is_kept_and_all_of_it(html, paragraphs):
    assert extraction.main_text(html) == " ".join([PARA.strip()] * paragraphs)


def test_depth_changes_nothing():
    """What hides its inside hides it at any depth, and a page takes linear time."""
    deep = "<div>" * 3000 + "menu words, many of them, that nobody wants to read here" + "</div>" * 3000
    assert extraction.main_text(f"<nav>{deep}</nav><div><p>{PARA}</p></div>") == PARA.strip()
    assert extraction.main_text("<span>" * 50_000 + "x" + "</b>" * 50_000) == "x"


def test_page_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>", "y"), (2, "u", "<div>" * 3000 + "deep", "z")]
    got = {r["page_id"]: r for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["n_chars"] == 0 and got[2]["text"] == "deep" and None in got
    schema = "page_id long, url string, html string"
    assert extraction.extract_pages(spark.createDataFrame([], schema)).count() == 0
    long = f"<article>{f'<p>{PARA}</p>' * 20_000}</article>"
    same = extraction.extract_pages(spark.createDataFrame([(1, "u", long)] * 3 + [(1, "u", "")], schema)).collect()
    assert sorted(r["n_chars"] for r in same) == [0] + [20_000 * len(PARA) - 1] * 3


# 6: digests


def test_ranks_follow_each_window_s_entropy():
    rnd = random.Random(16)
    data = bytes(rnd.choice(b"abcdefgh ijk\n") for _ in range(400))
    got = fingerprint.ranks(np.frombuffer(data, np.uint8))
    width = fingerprint.WINDOW
    for i in range(0, len(data) - width + 1, 5):
        h = -sum(c / width * log2(c / width) for c in Counter(data[i : i + width]).values())
        assert abs(got[i] - (1000 - abs(int(h * 1000 / log2(width)) - fingerprint.USUAL))) <= 1


def test_digests_don_t_depend_on_neighbours():
    items = [t.encode() for t in [*prose(17, 20), " ".join(prose(18, 12)), "", "x", "short text"]]
    alone = [fingerprint.digests([x])[0] for x in items]
    assert all((a == b).all() for a, b in zip(fingerprint.digests(items), alone, strict=True))
    long = items[20]
    other = " ".join(prose(19, 12)).encode()
    half = long[: len(long) // 2] + other[: len(long) // 2]
    near, far = (fingerprint.likeness(alone[20], fingerprint.digests([x])[0]) for x in (half, other))
    assert fingerprint.likeness(alone[20], alone[20]) == 1 and near > 0.3 > far


@pytest.mark.parametrize("range_rows", [20_000, 7])
def test_edits_follow_the_order_of_ids(spark, none, range_rows):
    texts = [*prose(20, 30), None, "", "a"]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(documents(spark, texts).repartition(6), range_rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, u = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == fingerprint.shown(fingerprint.digests([t.encode()])[0])
        assert 0 <= got[i]["near_next"] <= 1
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_digests_of_odd_rows(spark, odd):
    assert fingerprint.fingerprint_edits(odd).count() == len(ODD) + 2
    same = documents(spark, ["one text of some words"]).unionByName(documents(spark, ["one text of some words"])).repartition(2)
    assert [r["near_next"] for r in fingerprint.fingerprint_edits(same, 1).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("size", [70, 130, 260, 520, 1030, 4000])
def test_half_of_a_text_is_recognised_at_every_length(size):
    own, other = (" ".join(prose(seed, 80))[:size].encode() for seed in (31, 32))
    half = own[: size - size // 2] + other[: size // 2]
    a, b, c = fingerprint.digests([own, half, other])
    assert fingerprint.likeness(a, b) > 0.2 > fingerprint.likeness(a, c)


# ids that pandas would round

BIG = [2**60 + 1, None, 2**60 + 3]


def test_large_ids_beside_a_null_stay_whole(spark):
    texts = ["first text of a few words here", "second text with other words in it", "third text that is not like them"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "e") for i, t in zip(BIG, texts, strict=True)], SCHEMA).coalesce(1)
    labels = spark.createDataFrame([(2**60 + 1, 1, 0), (2**60 + 3, 0, 1)], "doc_id long, quality int, toxic int")
    order = lambda rows: sorted(rows, key=lambda x: x or 0)
    made = {
        "op1": quality.score_quality(docs, labels), "op3": packing.pack_documents(docs), "op4": lines.dedupe_lines(docs), "op5": perplexity.quality_rules(docs),
        "op6": fingerprint.fingerprint_edits(docs), "op7": tokens.encode_documents(docs), "op8": toxicity.score_toxicity(docs, labels),
        "op9": nearjoin.near_duplicates(docs), "op10": tokens.count_tokens(docs), "one": nearjoin.keep_one(docs), "prints": fingerprint.fingerprint_texts(docs),
        "good": perplexity.keep_good(docs.unionByName(docs)).unionByName(docs), "clean": toxicity.keep_clean(docs, labels.limit(0)),
    }
    for name, out in made.items():
        assert order({r["doc_id"] for r in out.collect()}) == order(BIG), name
    assert order(r["class_id"] for r in made["op9"].collect()) == order(BIG) and made["one"].count() == 3
    pages = spark.createDataFrame([(i, "u", f"<p>{t}</p>") for i, t in zip(BIG, texts, strict=True)], "page_id long, url string, html string").coalesce(1)
    assert order(r["page_id"] for r in extraction.extract_pages(pages).collect()) == order(BIG)


def test_repeated_rows_are_no_hot_key(spark):
    docs = documents(spark, ["a b c d e f", "g h i j k l"])
    many = docs
    for _ in range(4):
        many = many.unionByName(many)
    got = nearjoin.near_duplicates(many).collect()
    assert len(got) == 32 and {r["n_links"] for r in got} == {15} and nearjoin.keep_one(many).count() == 2
    assert nearjoin.whole_texts(many).count() == 2


# the pipeline


def test_pipeline_runs_and_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    texts = prose(21, 120) + near_texts()[:20]
    documents(spark, texts).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, odd, none):
    import corpus_pipeline

    labels = [(i, 1, int(i % 9 == 0)) for i in range(90)]
    for name, rows in (("odd", odd.unionByName(documents(spark, prose(24, 60)).withColumn("doc_id", F.col("doc_id") + 100))), ("none", none)):
        folder = str(tmp_path / name)
        rows.withColumn("n_lines", F.lit("kept")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, make in corpus_pipeline.STAGES[:-1]:
            out = make(spark, docs, folder)
            assert out.columns == docs.columns, stage
            assert (out.count() == 0) == (name == "none") and out.filter("n_lines <> 'kept'").count() == 0, stage
        assert (corpus_pipeline.run(spark, folder).count() == 0) == (name == "none")

"""Operators 11 to 13 against plain versions of their contracts."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import md5, sha256

import numpy as np
import pytest

from quillspark.llm import mixing, periodic, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "the cat", "x" * 30_000, "word " * 4_000, "naïve café 漢字 😀 ½ ٣\x1c\x85 end", "a\n\na\n", "two   blanks\t\ttabs\r\n"]


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "e") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and special texts, one repeated row and one row without an id or anything else."""
    base = documents(spark, ODD)
    return base.unionByName(base.filter("doc_id = 5")).unionByName(spark.createDataFrame([(None,) * 6], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 11: mixing


def plain_targets(sizes, cycle=(3, 1, 2), share=Fraction(3, 2), most=2):
    """The contract word by word: share by weight, stop at most times the size, share the excess again."""
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = dict.fromkeys(sizes, Fraction(0)), share * sum(sizes.values()), set(sizes)
    while open_ and left > 0:
        per = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += per * weight[s]
        left = Fraction(0)
        for s in [s for s in open_ if target[s] >= most * sizes[s]]:
            left += target[s] - most * sizes[s]
            target[s] = Fraction(most * sizes[s])
            open_.remove(s)
    return target


def plain_mix(rows, most=2):
    """(doc_id, source, size) to the words taken of each: a sequential fair queue."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target, queue, served = plain_targets(sizes), [], Counter()
    key = lambda r: (r[1] is None, r[1] or "", md5(f"mix:{'' if r[0] is None else r[0]}".encode()).digest(), (r[0] is not None, r[0] or 0), r[2])
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))
    for p in range(most):
        for i in order:
            _, s, n = rows[i]
            if n:
                begun = served[s]
                served[s] += n
                queue.append(((begun + n) / float(target[s]), s is None, s or "", begun, i))
    left, taken = sum(sizes.values()) * 3 // 2, [0] * len(rows)
    for *_, i in sorted(queue):
        got = min(left, rows[i][2])
        taken[i] += got
        left -= got
    return {i: (r[0], r[2], sizes[r[1]], round(float(target[r[1]]), 6), taken[i]) for i, r in enumerate(rows)}


def mixed(df):
    return sorted(map(repr, ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())))


def corpus(seed, n=400):
    rnd = random.Random(seed)
    sources = [rnd.choice(["a", "a", "a", "a", "b", "c", "d", "é", "z", None]) for _ in range(n)]
    return ["w " * rnd.choice([0, 1, 3, 10, 40, 300]) for _ in range(n)], sources


@pytest.mark.parametrize("rows", [mixing.BUCKET_ROWS, 7])
def test_the_mix_is_a_sequential_fair_queue(spark, monkeypatch, rows):
    """With small buckets and ranges too, so that the budget's end is found by descending."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    if rows < 100:
        monkeypatch.setattr(mixing, "RANGES", 3)
    texts, sources = corpus(1)
    docs = documents(spark, texts, sources)
    wanted = plain_mix([(i, s, len(t.split())) for i, (t, s) in enumerate(zip(texts, sources, strict=True))])
    out = mixing.mix(docs)
    assert mixed(out) == sorted(map(repr, wanted.values()))
    assert mixed(mixing.mix(docs.repartition(7))) == mixed(out)


def test_targets_are_met_within_a_document(spark):
    texts, sources = corpus(2, 600)
    got, most = mixing.mix(documents(spark, texts, sources)).collect(), {}
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == total * 3 // 2 and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in set(sources):
        own = [r for r in got if r["source"] == s]
        most[s] = abs(sum(r["taken"] for r in own) - own[0]["target"])
        assert most[s] <= 2 * 300


def test_the_stream_is_the_mix_in_order(spark):
    texts, sources = corpus(3, 200)
    docs = documents(spark, texts, sources)
    rows = mixing.stream(docs).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += r["taken"]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == dict(taken)


def test_a_mix_of_odd_rows(spark, odd, none):
    assert mixing.mix(none).count() == 0 and mixing.stream(none).count() == 0
    rows = [(i, f"s{i % 3}", len(WORD.findall(t or ""))) for i, t in enumerate(ODD)] + [(5, "s2", 2), (None, None, 0)]
    assert mixed(mixing.mix(odd)) == sorted(map(repr, plain_mix(rows).values()))
    blank = documents(spark, ["", None, " "])
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mix(blank.withColumnRenamed("extra", "taken")).count() == 3
    big = spark.createDataFrame([((1 << 60) + 1, "a b c", "s"), (None, "d", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in mixing.mix(big).collect()} == {(1 << 60) + 1, None}


# 12: spelling variants


def edits(a, b):
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(count):
    near = {w: [v for v in count if edits(w, v)] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), count[w], len(near[w]), count.get(form[w]) or 0) for w in count)


def grouped(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def misspelt(seed, n):
    """Words and their edits, with counts over five powers of ten; short alphabets make crowds."""
    rnd, count = random.Random(seed), {}
    for _ in range(n):
        w = "".join(rnd.choice(rnd.choice(["etao", "abcdeftiré", "xqz÷×ÿ"])) for _ in range(rnd.randrange(6, 10)))
        for _ in range(rnd.randrange(1, 8)):
            count.setdefault(w, 5 ** rnd.randrange(1, 8) + rnd.randrange(3))
            k, c = rnd.randrange(len(w)), rnd.choice("etaorinéÿz")
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])
    return {w: c for w, c in count.items() if len(w) >= 5}


@pytest.mark.parametrize("crowd", [variants.CROWD, 2])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(variants, "CROWD", crowd)
    count = misspelt(4, 250) | {"漢字漢字漢字": 9, "漢字漢字漢": 60, "":7}
    out = variants.group_variants(spark.createDataFrame(list(count.items()), "word string, n long"))
    assert grouped(out) == plain_groups(count)
    assert any(r[1] and r[2] != r[1] for r in grouped(out))  # chains of forms


def test_an_edit_flips_two_bits_at_most(spark):
    count = misspelt(5, 60)
    masks = {r["word"]: (r["band0"], r["band1"], r["band2"]) for r in variants.banded(spark.createDataFrame([(w,) for w in count], "word string")).collect()}
    for w, bits in masks.items():
        for k, letters in enumerate(variants.BANDS):
            assert bits[k] == sum(1 << i for i, c in enumerate(letters) if w.count(c) % 2)
        for v, other in masks.items():
            if edits(w, v):
                assert sum((a ^ b).bit_count() for a, b in zip(bits, other, strict=True)) <= 2 and any(a == b for a, b in zip(bits, other, strict=True))


def plain_words(rows):
    count, lower = Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}


def test_the_query_over_documents(spark, odd, none):
    rnd = random.Random(6)
    stock = ["".join(rnd.choice("etaoinÀéÉÿ÷") for _ in range(rnd.randrange(4, 9))) for _ in range(150)]
    texts = [" ".join(rnd.choice(stock).upper() if rnd.random() < 0.2 else rnd.choice(stock) for _ in range(300)) + "'d\nx1y" for _ in range(60)]
    got = grouped(variants.spelling_variants(documents(spark, texts)))
    wanted = plain_groups(plain_words(enumerate(texts)))
    assert got == wanted and len(got) > 100
    assert variants.spelling_variants(none).count() == 0
    rows = [*enumerate(ODD), (5, ODD[5]), (None, None)]
    assert grouped(variants.spelling_variants(odd)) == plain_groups(plain_words(rows))


# 13: periodic runs


def plain_runs(ids):
    """For every period, all maximal stretches; of equal stretches the smallest period stays."""
    n, found = len(ids), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences():
    rnd = random.Random(7)
    for _ in range(400):
        letters, n = rnd.choice([1, 2, 3, 10, 100]), rnd.randrange(0, 160)
        ids = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4)):  # stretches that go round, some broken, some inside others
            if n > 8:
                a, p = rnd.randrange(n), rnd.randrange(1, 1 + n // 5)
                for i in range(a + p, min(n, a + p * rnd.randrange(2, 9) + rnd.randrange(p + 1))):
                    ids[i] = ids[i - p]
        yield ids
    yield [0] * 3000
    yield ([0] * 7 + [1]) * 300 + [2] + ([0] * 7 + [1]) * 300
    fib = [0], [0, 1]
    while len(fib[1]) < 2000:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]


@pytest.mark.parametrize("reach", [periodic.REACH, 8])
def test_runs_are_those_of_every_period(monkeypatch, reach):
    monkeypatch.setattr(periodic, "REACH", reach)
    some = 0
    for ids in sequences():
        got = periodic.find_runs(np.array(ids, np.int64))
        assert got == plain_runs(ids)
        some += len(got)
    assert some > 500


def test_a_long_period_in_a_long_text():
    rnd = random.Random(8)
    once = [rnd.randrange(50_000) for _ in range(30_000)]
    ids = np.array([rnd.randrange(50_000) for _ in range(1000)] + once * 5 + once[:77] + [50_000], np.int64)
    assert periodic.find_runs(ids) in ([(1000, 150_077, 30_000)], [(999, 150_078, 30_000)])


def plain_digest(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), -1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and n and h >= 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *numbers, sha256(told.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_digests_over_documents(spark, odd, none):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["a", "b", "c d", "é\n", "long word"]) for _ in range(rnd.randrange(0, 300))) for _ in range(120)]
    got = sorted(tuple(r) for r in periodic.run_digests(documents(spark, texts)).collect())
    assert got == [plain_digest(i, t) for i, t in enumerate(texts)]
    small = odd.filter("doc_id is null or doc_id not in (7)")  # 4,000 equal words take the plain version long
    rows = [(i, t) for i, t in [*enumerate(ODD), (5, ODD[5]), (None, None)] if i != 7]
    assert sorted(map(repr, (tuple(r) for r in periodic.run_digests(small).collect()))) == sorted(repr(plain_digest(i, t)) for i, t in rows)
    assert [(r["n_runs"], r["length"], r["period"]) for r in periodic.run_digests(odd.filter("doc_id = 7")).collect()] == [(1, 4000, 1)]
    assert periodic.run_digests(none).count() == 0 and periodic.run_digests(none).columns[:3] == ["doc_id", "n_runs", "start"]


def test_the_operator_gives_runs_and_collapsed_texts(spark, odd):
    rows = spark.createDataFrame([(None, "x a b a b a b a b y y y y y y", "mine"), ((1 << 60) + 1, None, "mine")], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    assert got[None]["collapsed"] == "x a b y" and [tuple(r) for r in got[None]["runs"]] == [(1, 8, 2), (9, 6, 1)]
    assert got[(1 << 60) + 1]["runs"] == [] and got[(1 << 60) + 1]["collapsed"] == ""
    assert [r["_made"] for r in periodic.periodic_runs(rows.withColumnRenamed("runs", "_made")).collect()] == ["mine"] * 2
    assert periodic.periodic_runs(odd).columns == [*odd.columns, "runs", "collapsed"] and periodic.periodic_runs(odd).count() == len(ODD) + 2

"""Shared runs, assignment in order and similar sets, against brute force."""

import random

from quillspark.operators import attribution as B
from quillspark.operators import sets as E

STOP = {"the", "and"}


def longest(a, b):
    """The longest run that two texts share."""
    return max((n for n in range(len(a) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), default=0)


def test_shared_runs_are_the_longest(spark):
    rnd = random.Random(11)
    texts = {i: "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 40))) for i in range(25)}
    anchors = {f"x{i}": "".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 5, 9, 20]))) for i in range(15)}
    anchors |= {f"p{i}": texts[i][3:30] + "c" * rnd.randrange(6) for i in range(25)}
    flat = lambda t: " ".join(t.lower().split())
    wanted = {(a, i, longest(flat(x), flat(t))) for a, x in anchors.items() for i, t in texts.items() if flat(x) and longest(flat(x), flat(t)) >= 0.6 * len(flat(x))}
    got = B.shared_runs(spark.createDataFrame(list(anchors.items()), "anchor string, text string"), spark.createDataFrame(list(texts.items()), "id int, text string"))
    assert {(r["anchor"], r["id"], r["run"]) for r in got.collect()} == wanted and len(wanted) > 40


def test_an_anchor_survives_a_reformatted_sentence(spark):
    anchors = spark.createDataFrame([("d", "D3", "maturity is assessed in Section 9 of this document"), ("e", "D3", ""), ("f", "D5", "maturity is assessed in Section 9 of this document")], "anchor string, kind string, text string")
    texts = spark.createDataFrame([(1, "D3", "Maturity  is\nassessed in Section 9, of this -> x"), (2, "D3", "section document of maturity assessed this in 9 is"), (3, "D3", None)], "id int, kind string, text string")
    assert [(r["anchor"], r["id"]) for r in B.shared_runs(anchors, texts, on=["kind"]).collect()] == [("d", 1)]


def in_order(pairs):
    taken, out = set(), []
    for p in sorted({x[0] for x in pairs}):
        free = next((f for f in sorted(y for x, y in pairs if x == p) if f not in taken), None)
        if free is not None:
            taken.add(free)
            out.append((p, free))
    return out


def test_assignment_in_rounds_is_the_one_in_order(spark):
    rnd = random.Random(12)
    for most in (3, 30):
        groups = {g: {(rnd.randrange(40), rnd.randrange(most)) for _ in range(60)} for g in range(6)}
        groups[6] = {(i, j) for i in range(12) for j in range(12)}  # everybody wants the same ones
        df = spark.createDataFrame([(g, p, p, f, f) for g, own in groups.items() for p, f in own], "grp int, planted_pos int, planted int, found_pos int, found int")
        got = sorted((r["grp"], r["planted"], r["found"]) for r in B.match_in_order(df, ["grp"]).collect())
        assert got == sorted((g, *x) for g, own in groups.items() for x in in_order(own))


def test_planted_items_are_reached_once(spark):
    defects = spark.createDataFrame([("d1", 1, "D3", 10, 20, None), ("d2", 2, "D3", None, None, "the gate opens at noon"), ("d3", 3, "D5", 10, 20, None), ("d4", 4, "D3", None, None, None), ("d5", 5, "D3", 15, 16, None)], "defect string, pos int, kind string, first int, last int, anchor string")
    findings = spark.createDataFrame([("f1", 1, "D3"), ("f2", 2, "D3"), ("f3", 3, "D8")], "finding string, pos int, kind string")
    evidence = spark.createDataFrame([("f1", "x", 15), ("f1", "The gate opens at noon, it says", None), ("f2", None, 12), ("f3", "y", 15)], "finding string, text string, line int")
    pairs, told = B.attribution_scores(defects, findings, evidence)
    assert sorted(map(tuple, pairs.collect())) == [("d1", "f1")]  # f1 is the first that reaches d1, d2 and d5; f2 reaches d1 alone
    assert told.first().asDict() == {"wanted": 5, "scorable": 4, "hit": 1, "findings": 3, "recall": 0.25, "precision": 1 / 3}


def stock(seed, n):
    rnd = random.Random(seed)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "xyz"]
    return [(f"g{rnd.randrange(3)}", i, " ".join(["the", *rnd.choices(words[: rnd.choice([3, 8, 24])], k=rnd.randrange(0, 7))])) for i in range(n)]


def words(text):
    return set(text.split()) - STOP


def test_similar_pairs_are_those_of_all_pairs(spark):
    rows = stock(13, 120)
    for least in (0.34, 0.5, 0.6, 1.0):
        over = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
        wanted = {(g, i, j) for g, i, s in rows for h, j, t in rows if g == h and i < j and over(words(s), words(t)) >= least}
        got = E.similar_pairs(spark.createDataFrame(rows, "grp string, id int, text string"), "grp", least).collect()
        assert {(r["grp"], r["a"], r["b"]) for r in got} == wanted and len(got) == len(wanted)
        lone = {i for g, i, s in rows[:60] if words(s) and not any(h == g and over(words(s), words(t)) >= least for h, _, t in rows[60:])}
        out, inputs = (spark.createDataFrame(x, "grp string, id int, text string") for x in (rows[:60], rows[60:]))
        assert {r["id"] for r in E.orphans(out, inputs.select("grp", "text"), least, ["grp"]).collect()} == lone


def test_pairs_of_owners(spark):
    rnd = random.Random(14)
    rows = [(i, rnd.randrange(4), rnd.randrange(5), f"owner{rnd.choice('abc')} unit", f"cap{rnd.randrange(30)} store") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, section int, grp int, owner string, capability string")
    every = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[3] != b[3])
    pairs, n = E.owner_pairs(df, 5000)
    assert n == len(every) and sorted(map(tuple, pairs.collect())) == every
    pairs, n = E.owner_pairs(df, 100)
    near = [(a, b) for a, b in every if rows[a][2] == rows[b][2] or rows[a][4] == rows[b][4]]
    assert n == len(every) and sorted(map(tuple, pairs.collect())) == near[:100]
    one = df.withColumn("section", df["section"] * 0)
    assert E.owner_pairs(one)[1] == 0 and E.owner_pairs(one)[0].count() == 0

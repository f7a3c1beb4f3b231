"""The model boundary, panels, the report and the way back into a register."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark import provider as M
from quillspark.plans import agents, register
from quillspark.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Counting:
    """Answers from a rule; what it was asked is kept beside it, in a file, because tasks run elsewhere."""

    def __init__(self, path, rule, name="counting"):
        self.path, self.rule, self.name = str(path), rule, name

    def ask(self, system, user):
        with open(self.path, "a") as f:
            f.write(user.replace("\n", " ") + "\n")
        return self.rule(system, user)

    def asked(self):
        try:
            return open(self.path).read().splitlines()
        except FileNotFoundError:
            return []


def prompts(spark, *users):
    return spark.createDataFrame([(i, "s", u) for i, u in enumerate(users)], "id int, system string, user string").coalesce(1)


def fails(system, user):
    raise OSError("down")


def test_known_answers_are_not_asked_again(spark, tmp_path):
    p = Counting(tmp_path / "log", lambda s, u: u.upper())
    for users in (("a", "b", "a"), ("b", "c")):
        got = M.ask_cached(prompts(spark, *users), p, str(tmp_path / "cache")).orderBy("id").collect()
        assert [r["answer"] for r in got] == [u.upper() for u in users] and {r["status"] for r in got} == {"ok"}
    assert sorted(p.asked()) == ["a", "b", "c"]
    down = Counting(tmp_path / "log2", fails, "down")
    got = M.ask_cached(prompts(spark, "a"), down, str(tmp_path / "cache")).collect()
    assert [(r["answer"], r["status"]) for r in got] == [(None, "failed")] and "down" in got[0]["error"]


def test_an_endpoint_that_never_answers_is_given_up(spark, tmp_path):
    down = Counting(tmp_path / "log", fails)
    many = prompts(spark, *map(str, range(40))).repartition(8)
    got = M.ask_guarded(many, down, attempts=1).collect()
    assert len(got) == 40 and {r["error"] for r in got} == {"endpoint given up"} and len(down.asked()) == 4
    up = Counting(tmp_path / "log2", lambda s, u: "x")
    assert M.ask_guarded(many, up).filter("answer = 'x'").count() == 40


def test_embedding_tries_again_and_says_what_failed(spark):
    def embed(texts):
        if "bad" in texts:
            raise OSError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bad"), (4, None)], "id int, text string")
    got = {r["id"]: (r["embedding"], r["error"]) for r in M.embed_all(rows, embed, batch=1, pause=0.01).collect()}
    assert got == {1: ([2.0, 1.0], None), 2: ([2.0, 1.0], None), 3: (None, "OSError: no"), 4: (None, None)}


def test_budget_grows_until_the_reply_is_whole():
    seen = []

    def ask(system, user, budget):
        seen.append(budget)
        if budget < 9000:
            raise M.Truncated
        return "whole"

    assert M.Escalating("m", ask).ask("s", "u") == "whole" and seen == [1000, 3000, 9000]


def test_catalogue_falls_back_and_counts_passes(spark, tmp_path):
    full = json.dumps({n: [] for n in agents.FULL_LISTS})
    small = json.dumps({n: [] for n in agents.FULL_LISTS[:3]})
    p = Counting(tmp_path / "log", lambda s, u: "{broken" if u.startswith("bad") else full if u.startswith("good") else small)
    sections = spark.createDataFrame([("d", 1, "good"), ("d", 2, "poor"), ("d", 3, "bad")], "slug string, position int, text string")
    read = agents.catalogue(sections, p, runs=2)
    told = {(r["position"], r["pass"]): (r["answer"] is not None, r["degraded"]) for r in read.collect()}
    assert told == {(1, 1): (True, False), (1, 2): (True, False), (2, 1): (True, True), (2, 2): (True, True), (3, 1): (False, False), (3, 2): (False, False)}
    assert {r["position"]: (r["passes"], r["full_passes"], r["short"]) for r in agents.passes_of(read, 2).collect()} == {1: (2, 2, False), 2: (2, 0, False), 3: (0, 0, True)}


def test_panels_are_graded_blind(spark, tmp_path):
    questions = spark.createDataFrame([(1, "why?"), (2, "how?")], "qid int, question string")
    told = agents.panel(questions, "The text.", {n: Counting(tmp_path / n, lambda s, u, n=n: f"says {len(n)}", n) for n in ("alpha", "be")})
    judge = Counting(tmp_path / "judge", lambda s, u: "5" if "says 5" in u else "1", "judge")
    got = agents.graded(told, judge).collect()
    assert {(r["qid"], r["model"], r["grade"]) for r in got} == {(q, m, g) for q in (1, 2) for m, g in (("alpha", "5"), ("be", "1"))}
    assert {r["label"] for r in got} == {"Reader A", "Reader B"} and not any("alpha" in x for x in judge.asked())
    rows = spark.createDataFrame([(1, "c", "p")], "id int, comment string, passage string")
    p = Counting(tmp_path / "two", lambda s, u: "met" if "shown" in s or "show" in s else "wanted")
    assert tuple(agents.outcome_first(rows, p).first())[:3] == (1, "wanted", "met") and "p" not in p.asked()[0].split()


def test_report_and_write_back(spark):
    findings = spark.createDataFrame([("D2", "D", "flood", False, "flood model"), ("D10", "D", "pump", False, "pump"), ("C1", "C", "siren", True, "siren")], "id string, class string, title string, absence boolean, term string")
    lexicon = spark.createDataFrame([("pump", "motor")], "term string, variant string")
    old = spark.createDataFrame([(1, "The flood model"), (2, "a pump")], "line_no int, text string")
    new = spark.createDataFrame([(1, "The flood model"), (2, "a motor, new")], "line_no int, text string")
    claims = spark.createDataFrame([("D2", "Done", "n"), ("D10", "", "n")], "id string, status string, note string")
    coverage = spark.createDataFrame([("o1", "flood model is missing", "unmet"), ("o2", "flood model", "met")], "key string, text string, verdict string")
    synthesis = spark.createDataFrame([("s1", "the flood model again")], "key string, text string")
    clusters = spark.createDataFrame([("c1", 1, 2.0, "flood model"), ("c2", 2, 1.0, "doors")], "cluster string, rank int, strength double, text string")
    got = register.report(findings, lexicon, old, new, claims, coverage, synthesis, clusters)
    rows = {k: [tuple(r) for r in v.orderBy("place").collect()] for k, v in got.items() if "place" in v.columns}
    assert [(r[0], r[5]) for r in rows["disputed"]] == [("D2", "DISPUTED"), ("D10", "UNCLAIMED CHANGE")]
    assert [r[0] for r in rows["open"]] == ["C1", "D2"] and [r[1:] for r in rows["converging"]] == [("D2", "D", 2)]
    assert [(r[0], r[3]) for r in rows["corroborated"]] == [("D2", 1)] and [r["cluster"] for r in got["novel"].collect()] == ["c2"]
    sheet = spark.createDataFrame([(2, "D2", "x"), (3, "D10", ""), (4, "E9", "")], "_row int, id string, note string")
    states = spark.createDataFrame([("D2", "UNCHANGED", None), ("D10", "CHANGED", "+1 -1")], "id string, state string, detail string")
    lines = spark.createDataFrame([("D2", "new", 7), ("D10", "old", 4)], "id string, side string, line_no int")
    cells = register.matrix(sheet, states, "id", "v1", "v2", lines)
    out = register.write_back(sheet, cells, "found", before="note").collect()
    assert [r["found"] for r in out] == ["Not addressed. Text carrying this comment is identical in v2 (v2: line 7)", "Text changed between v1 and v2 — review against the comment (v1: line 4) [+1 -1 lines]", ""]
    assert [r["note"] for r in out] == ["x", "", ""]


def test_small_files(spark, tmp_path):
    assert files.read_rows(spark, str(tmp_path / "none.csv"), "a string, b string").count() == 0
    (tmp_path / "x.csv").write_text('a,c\n"1\n2",3\n')
    assert [tuple(r) for r in files.read_rows(spark, str(tmp_path / "x.csv"), "a string, b string").collect()] == [("1\n2", None)]
    files.replace_file(str(tmp_path / "f.json"), "{}")
    assert (tmp_path / "f.json").read_text() == "{}" and not (tmp_path / "f.json.tmp").exists()
    manifest = spark.createDataFrame([("d", "a" * 64, "b" * 64, 9)], "slug string, source_sha256 string, text_sha256 string, text_lines int")
    assert files.provenance(manifest, "d") == f"d: source {'a' * 12}, text {'b' * 12}, 9 lines"
    log = M.call_log(spark.createDataFrame([("k", "ok", "x" * 5000, None)], "key string, status string, answer string, error string"))
    assert len(log.first()["raw"]) == 4000 and log.select(F.col("status")).first()[0] == "ok"

"""Attacks on findings, terms from nomination to report, and vectors that are kept."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.plans import adversarial as V
from quillspark.provider import embed_cached

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests on their path


class Scripted:
    name = "scripted"

    def __init__(self, by):
        self.by = by

    def ask(self, system, user):
        lens = next(n for n, s in V.LENSES.items() if s == system)
        for key, replies in self.by.items():
            if key in user:
                told = replies[lens]
                if "refused" in user and isinstance(told, list):
                    told = told[1]
                told = told[0] if isinstance(told, list) else told
                if isinstance(told, Exception):
                    raise told
                return told if isinstance(told, str) else json.dumps(told)


def reply(refuted, evidence="", gap="g", reason="r"):
    return {"refuted": refuted, "evidence": evidence, "gap_addressed": gap, "reason": reason}


def test_findings_under_attack(spark):
    no, yes = reply(False), reply(True, "pumps START at\nnine")
    by = {
        "alpha": {"search": yes, "rebuttal": yes, "materiality": reply(True)}, "beta every pump": {"search": yes, "rebuttal": yes, "materiality": no}, "gamma": {"search": no, "rebuttal": no, "materiality": no},
        "delta": {"search": reply(True, "invented"), "rebuttal": no, "materiality": no}, "epsilon": {"search": [reply(True, "invented"), no], "rebuttal": TimeoutError("x"), "materiality": no},
        "zeta": {"search": [reply(True, ""), yes], "rebuttal": reply(True, "It is described in Section 4"), "materiality": "no json"}, "eta": {"search": reply(True, "pumps start", gap=" "), "rebuttal": no, "materiality": no},
    }
    rows = [(k, f"The {k} duty", "unmet", "missing") for k in by]
    chunks = spark.createDataFrame([("c1", "The pumps start at nine."), ("c2", "It is described in Section 4.")], "chunk_id string, text string")
    got = {r["id"]: r for r in V.verify(spark.createDataFrame(rows, "id string, requirement string, verdict string, reason string"), chunks, Scripted(by), 4, stop_after=100).collect()}
    assert {k: (r["status"], r["refutations"], r["lens_failures"], r["immaterial"]) for k, r in got.items()} == {
        "alpha": ("refuted", 2, "", True), "beta every pump": ("contested", 2, "", False), "gamma": ("confirmed", 0, "", False), "delta": ("contested", 0, "search", False),
        "epsilon": ("contested", 0, "rebuttal", False), "zeta": ("contested", 1, "rebuttal", False), "eta": ("contested", 0, "search", False),
    }
    assert got["beta every pump"]["universal"] and got["alpha"]["search_evidence"] == "pumps START at\nnine"


class Nominator:
    name = "n"

    def ask(self, system, user):
        if "silent" in user:
            raise TimeoutError
        return json.dumps({"terms": [{"term": t, "quote": q} for t, q in (("Surge bus", "the surge bus"), ("surge BUS", "Surge bus carries"), ("gate", "the gate"), ("lone", "lone"), ("flux", "never said"), (" ", "x"))]})


def test_terms_from_nomination_to_report(spark):
    docs = spark.createDataFrame([("d", "# Parts\nthe surge bus moves\nSurge bus carries the gate.\nthe gate\nlone word flux flux\n# Later\nA gate is a\ndoor. " + "silent " * 3), ("e", "nothing here")], "slug string, text string")
    terms, read = V.nominate(docs, Nominator(), stop_after=100)
    assert {r["slug"]: (r["of"], r["answered"]) for r in read.collect()} == {"d": (2, 1), "e": (1, 1)}
    got = [tuple(r) for r in V.undefined_terms(docs, terms).select("slug", F.lower("term"), "uses").collect()]
    assert got == [("d", "surge bus", 2)]


def test_vectors_are_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def embed(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    path = str(tmp_path / "vectors")
    first = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed_cached(first, embed, "m", path, tries=1).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None}
    more = spark.createDataFrame([(5, "aa"), (6, "ccc"), (7, "bad")], "id int, text string")
    told = {r["id"]: (r["embedding"], r["error"]) for r in embed_cached(more, embed, "m", path, batch=1, tries=1).collect()}
    assert told[5] == ([2.0, 1.0], None) and told[6] == ([3.0, 1.0], None) and told[7][0] is None and "refused" in told[7][1]
    said = [t for f in log.iterdir() for t in f.read_text().split("\n")]
    assert sorted(said) == ["aa", "b", "bad", "ccc"]
    assert embed_cached(more.filter("id = 5"), embed, "other", path, tries=1).count() == 1 and sum(f.read_text() == "aa" for f in log.iterdir()) >= 1


class Judge:
    name = "judge"

    def ask(self, system, user):
        if "fails" in user:
            raise TimeoutError
        if "garbled" in user:
            return "no json"
        verdict = "partial" if "AS THEY STAND" in user else "unclear" if "escalate" in user else "addressed" if "+a new rule" in user else "not_addressed"
        return json.dumps({"verdict": verdict, "rationale": user.split("\n\n")[1].split("\n")[0], "quote": "q"})


def test_a_matrix_is_adjudicated(spark):
    from quillspark.plans import adjudication as D

    old = ["# Top", "1 Scope", "same words", "2 Rules", "old rule", "2.1 Detail", "detail", "3 Gone", "x", "4 Moved", "text"]
    new = ["# Top", "1 Scope", "same words", "2 Rules", "a new rule", "2.1 Detail", "detail", "3 Moved", "text", "4 Added", "y"]
    rows = [("a", "§1", "c"), ("b", "§2, Table", "c"), ("c", "§2.1 and §1", "c"), ("d", "§3", "c"), ("e", "§4", "c"), ("f", "All", "c"), ("g", "§1", " "), ("h", "§2", "escalate"), ("i", "§2", "fails"), ("j", "§9.9", "c"), ("k", "§1, §2", "garbled"), ("l", "§2.1.5", "c")]
    number = lambda t: spark.createDataFrame(list(enumerate(t, 1)), "line_no int, text string")
    got = {r["id"]: r for r in D.adjudicate(spark.createDataFrame(rows, "id string, section string, comment string"), number(old), number(new), Judge(), stop_after=100).collect()}
    assert {k: (r["verdict"], r["basis"]) for k, r in got.items()} == {
        "a": ("not_addressed", "UNCHANGED"), "b": ("addressed", "DIFF"), "c": ("not_addressed", "UNCHANGED"), "d": ("addressed", "WIDE+UNLOCATABLE"), "e": ("not_addressed", "UNCHANGED"), "f": ("addressed", "WIDE"), "g": (None, "SKIPPED"),
        "h": ("partial", "ESCALATED"), "i": ("unclear", "ERROR"), "j": ("addressed", "WIDE+UNLOCATABLE"), "k": ("unclear", "ERROR"), "l": ("not_addressed", "UNCHANGED"),
    }
    assert got["e"]["rationale"] == "nothing has changed in §4 is now §3" and got["b"]["rationale"] == "WHAT CHANGED"

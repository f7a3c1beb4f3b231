"""The pointer grammar by cases: what is named, whether a table or page is, whether more is named than listed."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pointers as P

S, A = "section", "appendix"


def sections(*numbers):
    return [(S, n) for n in numbers]


def appendices(*numbers):
    return [(A, n) for n in numbers]


CASES = [
    ("Section 14 and Appendix F", [(S, "14"), (A, "f")]),
    ("Sections 6.4, 7.4 and 11.2", sections("6.4", "7.4", "11.2")),
    *[(t, sections("5", "6", "7")) for t in ("Sections 5, 6, and 7", "Sections 5, 6, or 7")],
    *[(t, sections("5", "7")) for t in ("Sections 5 and/or 7", "Sections 5/7", "Section 5 (runtime) and 7 (failover)", "5 and Section 7")],
    ("Appendices A, B, and C", appendices("a", "b", "c")),
    ("Sections 5 to 8", sections("5", "6", "7", "8")), ("Sections 5.2–5.4", sections("5.2", "5.3", "5.4")), ("Sections 5 to Section 8", sections("5", "6", "7", "8")),
    ("Appendices A to C", appendices("a", "b", "c")),
    *[(t, sections("2", "3", "4")) for t in (
        "Sections 2 through to 4", "Sections 2 thru 4", "Sections 2 up to 4", "between Sections 2 and 4", "Sections 2‑4", "Sections 2−4", "Sections 2 — 4",
        "Sections 2--4", "Sections 2 thru to 4", "Sections 2..4", "Sections 2…4", "Sections 2 ... 4")],
    ("Sections 3.1 to 4.2", sections("3", "4")), ("Sections 4a to 4c", sections("4a", "4b", "4c")), ("Sections 3.1a–3.1c", sections("3.1a", "3.1b", "3.1c")),
    ("Section 3 - see also 5", sections("3", "5")), ("Section 3 to Appendix C", [(S, "3"), (A, "c")]),
    ("Appendices I and II", appendices("i", "ii")), ("Appendices II to IV", appendices("ii", "iii", "iv")),
    *[(t, appendices("a")) for t in ("Section A.1", "Clause A.1", "§A.1", "Appendix A.1")],
    ("§4.2", sections("4.2")), ("clause 7", sections("7")), ("Ch. 3", sections("3")),
    *[(t, sections("3.1")) for t in ("Subsection 3.1", "sub-section 3.1", "Sec. 3.1", "Sect. 3.1", "SECTION 3.1", "Sec 3.1", "sect 3.1", "Section 03.1")],
    ("Section 3.0", sections("3")), ("Sections 4a and 3.16a", sections("4a", "3.16a")), ("Sections 4A and 4b", sections("4a", "4b")),
    ("Section 2024", sections("2024")), ("the 2024 roadmap, Section 3", sections("3")), ("appendix b", appendices("b")), ("Annex c and Appendix D", [("annex", "c"), (A, "d")]),
    ("Appendices A and C", appendices("a", "c")), ("Annex 3", [("annex", "3")]), ("Appendix B and a later note", appendices("b")), ("Appendix C1", []),
    ("Section 5, requirement R-012", sections("5")), ("Section 5 of the 2024 plan", sections("5")), ("Sections 2, 2 and 3", sections("2", "3")),
    *[(t, []) for t in ("the delivery plan", "Load test report", "above", "cross-section 12", "the intersection of 4 reaches", "", None, "the annex")],
]
#: A word for another kind of thing owns the number behind it: (target, keys, other).
OWNED = [
    ("Sections 2 (Table 4) and 5", sections("2", "5"), True), ("Sections 2 (p. 4) and 5 (p. 9)", sections("2", "5"), True), ("Section 2, Figure 1, and 5", sections("2", "5"), True),
    ("Sections 4 (step 2) and 5", sections("4", "5"), False), ("Section 4 (Version history) and 5", sections("4", "5"), False), ("Section 1 (Line protection) and 3", sections("1", "3"), False),
    ("Section 1, second paragraph, and 3.1", sections("1", "3.1"), True), ("Section 2, Tables 4 to 6, and 7", sections("2", "7"), True), ("Section 5, step 3", sections("5"), False),
    *[(t, [], True) for t in ("Table 4", "Figure 2", "page 12", "pp. 12", "paragraph 3", "para 4", "Fig. 2")],
    ("Section 3, Table 4", sections("3"), True), ("Table 4 of Section 3", sections("3"), True),
]
#: More is named than is listed.
MORE = [
    ("Sections 7 to 3", sections("7", "3")), ("Sections 1 to 500", sections("1", "500")), ("Sections 4a to 7", sections("4a", "7")), ("Sections 4a to 5b", sections("4a", "5b")),
    ("Appendices C to A", appendices("c", "a")), ("Sections 1 to " + "9" * 5000, sections("1", "9" * 5000)),
    *[(t, sections("2")) for t in ("Section 2 onwards", "Section 2 et seq.", "Section 2 ff.", "Section 2 and following")], ("Sections 2, 3 etc.", sections("2", "3")),
]


def test_pointers(spark):
    wanted = [(t, k, False, False) for t, k in CASES] + [(t, k, o, False) for t, k, o in OWNED] + [(t, k, False, True) for t, k in MORE]
    df = spark.createDataFrame([(i, w[0]) for i, w in enumerate(wanted)], "id int, target string")
    got = {r["id"]: r["p"] for r in df.select("id", P.pointed(F.col("target")).alias("p")).collect()}
    wrong = [(w, got[i]) for i, w in enumerate(wanted) if ([tuple(k) for k in got[i]["keys"]], got[i]["other"], got[i]["more"]) != w[1:]]
    assert not wrong
    both = {k["number"] for k in spark.range(1).select(P.pointed(F.lit("Appendices I to V"))["keys"]).first()[0]}
    assert {"i", "ii", "iii", "iv", "v", "j", "u"} <= both
    assert len(spark.range(1).select(P.pointed(F.lit("Sections 1 to 201"))["keys"]).first()[0]) == 201


@pytest.mark.parametrize("good", [True, False])
def test_bare_pointers(spark, good):
    told = {
        True: ["Section 14 and Appendix F", "Sections 5, 6, and 7", "§4.2; §5", "Appendices I to IV", "between Sections 2 and 4", ""],
        False: ["Tables 4 and 5 of the calibration section", "Section 4.2 of the ICD", "the calibration section (2 tables)", "Section 2 onwards", "Section 5, R-012", "Section 2 * 3"],
    }[good]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r[0] for r in df.select(P.bare(F.col("t"))).collect()} == {good}


def test_what_headings_say_they_are(spark):
    told = [
        ("## 03.1 Scope", (S, "3.1"), (S, "3.1")), ("3.1Drift limits", (S, "3.1"), None), ("**4a.** Limits", (S, "4a"), (S, "4a")), ("3D flood twin design", (S, "3"), None),
        ("Appendix B: Data", (A, "b"), (A, "b")), ("Annex 3", ("annex", "3"), ("annex", "3")), ("Appendix IV - Plans", (A, "iv"), (A, "iv")), ("2024 roadmap", None, None),
        ("| Section 7. End", (S, "7"), (S, "7")), ("Open issues", None, None), ("", None, None), (None, None, None), ("5.0 Five", (S, "5"), (S, "5")),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(told)], "id int, t string")
    rows = df.select("id", P.heading_place(F.col("t")).alias("a"), P.heading_place(F.col("t"), strict=True).alias("b")).orderBy("id").collect()
    got = [(r["a"] and tuple(r["a"]), r["b"] and tuple(r["b"])) for r in rows]
    assert got == [t[1:] for t in told]


def test_one_place_by_two_names(spark):
    key = lambda kind, number: F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("number"))
    pairs = [((A, "ii"), (A, "2"), True), ((A, "1"), (A, "i"), True), ((S, "1"), (S, "i"), False), ((A, "c"), (A, "d"), False), ((S, "5"), (S, "5"), True), ((A, "b"), ("annex", "b"), False)]
    got = spark.range(1).select(*[P.same(key(*a), key(*b)).alias(f"c{i}") for i, (a, b, _) in enumerate(pairs)]).first()
    assert list(got) == [w for *_, w in pairs]
    below = spark.range(1).select(P.under(key(S, "5"), key(S, "5.1")), P.under(key(S, "5"), key(S, "51")), P.under(key(S, "5.1"), key(S, "5")), P.under(key(A, "ii"), key(A, "2"))).first()
    assert list(below) == [True, False, False, True]


def test_numerals_there_and_back(spark):
    rows = spark.range(1, 90).select("id", P.numeral(F.col("id")).alias("x")).select("id", "x", P.roman(F.col("x")).alias("n")).collect()
    assert all(r["n"] == r["id"] for r in rows) and {r["id"]: r["x"] for r in rows}[49] == "xxxxix"
    odd = spark.createDataFrame([(x,) for x in ("", "iiii", "vx", "iix", "c", "b", "XIV")], "x string")
    assert [r[0] for r in odd.select(P.roman(F.col("x"))).collect()] == [0, 0, 0, 0, 0, 0, 14]


def test_sections_of_a_cell(spark):
    cell = F.lit("Updated Table 5, row 12 on 3 May; see Section 4.2, §3 and 7.1.2 and section 4.2")
    assert list(spark.range(1).select(P.section_signs(cell), P.sections_named(cell)).first()) == [["3"], ["4.2", "3", "7.1.2"]]
    assert list(spark.range(1).select(P.section_signs(F.lit(None)), P.sections_named(F.lit("Updated Table 5, row 12 on 3 May; see Section 4.2"))).first()) == [[], ["4.2"]]

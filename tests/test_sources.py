"""Readers and writers: the same rows through every format."""

import json

from quillspark.sources import files, office
from quillspark.streaming import verdicts


def test_workbook_round_trip_and_fixed_bytes(spark, tmp_path):
    df = spark.createDataFrame([("1", "a & b"), ("2", "<c>")], "id string, note string")
    a, b = tmp_path / "a.xlsx", tmp_path / "b.xlsx"
    files.write_xlsx(df, str(a), "S")
    files.write_xlsx(df, str(b), "S")
    assert a.read_bytes() == b.read_bytes()
    back = office.read_register(spark, str(a))
    assert [tuple(r) for r in back.orderBy("_row").collect()] == [(2, "1", "a & b"), (3, "2", "<c>")]
    lines, status = office.extract(a.read_bytes(), "a.xlsx")
    assert status == "ok" and lines[1:] == ["id | note", "1 | a & b", "2 | <c>"]


def test_delimited_register_keeps_record_numbers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿id;note\n1;"x;y"\n\n3;\n', encoding="utf-8")
    back = office.read_register(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in back.orderBy("_row").collect()] == [(2, "1", "x;y"), (4, "3", "")]


def test_annotate_keeps_filled_cells(spark):
    register = spark.createDataFrame([(2, "a", "old"), (3, "b", ""), (5, "c", "")], "_row int, id string, note string")
    values = spark.createDataFrame([(2, "new"), (5, "n5")], "_row int, value string")
    assert [r["note"] for r in files.annotate(register, values, "note").orderBy("_row").collect()] == ["old", "", "n5"]
    assert [r["note"] for r in files.annotate(register, values, "note", True).orderBy("_row").collect()] == ["new", "", "n5"]
    assert files.insert_column(register, "x", "note").columns == ["_row", "id", "x", "note"]


def test_results_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps({"id": "1", "model": "m", "verdict": "met"}), "{broken", json.dumps({"id": "2", "model": "m", "verdict": "unmet"})]))
    good, bad = files.read_results(spark, str(tmp_path / "in"), "id string, model string, verdict string")
    good, bad = good.cache(), bad
    assert good.count() == 2
    out = str(tmp_path / "out")
    assert files.append_new(good, out, ["id", "model"]) == 2 and files.append_new(good, out, ["id", "model"]) == 0


def test_stream_adds_each_key_once(spark, tmp_path):
    source = tmp_path / "s"
    source.mkdir()
    row = {"id": "1", "model": "m", "verdict": "met", "doc": "d", "doc_sha256": "x", "ts": "2024-01-01T00:00:00Z"}
    for k in range(2):
        (source / f"{k}.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"id": f"n{k}"}) + "\n")
        verdicts.resume_into(verdicts.verdict_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "c"), ["id", "model"]).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["1", "n0", "n1"]


def test_questions_and_salvage():
    assert files.load_questions("1. a\n   b\n2) c") == ["a b", "c"] and files.load_questions("x\ny") == ["x", "y"]
    assert files.salvage('{"quotes": ["a \\"b\\"", "c"], "answer": "cut o') == (['a "b"', "c"], "")
    assert files.salvage('{"quotes": ["see [3] here", "two"], "answer": "x') == (["see [3] here", "two"], "")
    assert files.salvage('{"answer": "yes ", "quotes": ["one", " "]} and more') == (["one"], "yes") and files.salvage("nothing") == ([], "")


def test_reports_hold_every_row(spark):
    df = spark.range(2500).selectExpr("id", "concat('a|', id) AS note")
    assert files.html_table(df).count("<tr>") == 2501 and files.markdown_table(df).count("\n") == 2501
    assert files.markdown_table(df, 3).endswith("2497 more")


def test_documents_say_what_was_not_read(tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *t: "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t)
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('One', '  ', 'Two')}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {w}>{p('n', '')}</w:footnotes>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p(' ')}</w:hdr>")
    raw = (tmp_path / "a.docx").read_bytes()
    assert office.extract(raw, "a.docx") == (["One", "Two"], "ok") and office.beside(raw, "a.docx") == ["footnotes:1"] and office.beside(b"x", "a.txt") == []


def test_sheets_as_a_data_source(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    from quillspark.sources import ooxml

    ooxml.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for name, sheet, rows in (("a.xlsx", "S", [("1", "x"), ("2", "")]), ("b.xlsx", "T", [("3", "y & z")])):
        files.write_xlsx(spark.createDataFrame(rows, "id string, note string"), str(folder / name), sheet)
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:tbl><w:tr>{cell(a)}{cell('v')}</w:tr></w:tbl>" for a in "pq") + "</w:body></w:document>")
    (folder / "d.xlsx").write_bytes(b"PK broken")
    (folder / "e.txt").write_text("no office file")
    df = spark.read.format("ooxml_sheet").load(str(folder))
    rows = sorted((r["path"].rsplit("/", 1)[1], r["sheet"] or "", r["_row"] or 0, r["cells"] or [], r["status"].split(":")[0]) for r in df.collect())
    assert rows == [
        ("a.xlsx", "S", 1, ["id", "note"], "ok"), ("a.xlsx", "S", 2, ["1", "x"], "ok"), ("a.xlsx", "S", 3, ["2", ""], "ok"), ("b.xlsx", "T", 1, ["id", "note"], "ok"), ("b.xlsx", "T", 2, ["3", "y & z"], "ok"),
        ("c.docx", "table 1", 1, ["p", "v"], "ok"), ("c.docx", "table 2", 1, ["q", "v"], "ok"), ("d.xlsx", "", 0, [], "failed"),
    ]
    assert df.rdd.getNumPartitions() == 5
    one = df.filter(F.col("sheet") == "T")
    assert one.filter("status = 'ok'").count() == 2 and one.rdd.getNumPartitions() < 5
    assert spark.read.format("ooxml_sheet").option("sheet", "S").load(str(folder / "a.xlsx")).count() == 3
    (tmp_path / "none").mkdir()
    assert spark.read.format("ooxml_sheet").load(str(tmp_path / "none")).count() == 0


def test_aliases_of_components(spark, tmp_path):
    forms = {
        "map.yaml": "components:\n  Sensor Fabric: {aliases: [SF, 'sensor-fabric']}\n  Hydrology:\n", "list.yaml": "- name: Sensor Fabric\n  aliases: [SF]\n- name: ''\n- just text\n- {name: Other, aliases: [sf]}\n", "plain.yaml": "Gate: {aliases: ['The  Gate!']}\n",
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
    got = {n: {r["alias"]: r["canonical"] for r in files.load_aliases(spark, str(tmp_path / n)).collect()} for n in (*forms, "none.yaml")}
    assert got["map.yaml"] == {"sensor fabric": "sensor fabric", "sf": "sensor fabric", "hydrology": "hydrology"} and got["plain.yaml"] == {"gate": "gate", "the gate": "gate"}
    assert got["list.yaml"] == {"sensor fabric": "sensor fabric", "sf": "other", "other": "other"} and got["none.yaml"] == {}


def test_denied_phrases_in_a_tree(spark, tmp_path):
    from quillspark.operators.sections import deny_phrases

    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / "a.txt").write_text("We met the Blue\nheron project. The blue-heron project again.")
    (tree / "sub" / "b.txt").write_text("codename")
    (tree / "c.docx").write_bytes(b"PK broken")
    denied = deny_phrases(spark.createDataFrame([("blue heron project",), ("Codename",), ("never said here",), ("codename",)], "phrase string"))
    got = sorted((r["path"].rsplit("/", 1)[1], r["n"] or 0, r["hits"] or 0, r["status"].split(":")[0]) for r in files.unsafe_files(spark, str(tree), denied).collect())
    assert got == [("a.txt", 3, 2, "ok"), ("b.txt", 1, 1, "ok"), ("c.docx", 0, 0, "failed")]

"""Text and tables of office files, as Spark data sources over binary files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _root(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def document_lines(archive: zipfile.ZipFile) -> list[str]:
    """A line for each paragraph that has text or a formula."""
    out = []
    for p in _root(archive, "word/document.xml").iter(f"{W}p"):
        text = "".join(x.text or "" for x in p.iter() if x.tag in (f"{W}t", f"{M}t"))
        if text.strip():
            out.append(text)
    return out


def unread_parts(archive: zipfile.ZipFile) -> list[str]:
    """Parts of a document that hold text beside its body, with the number of their paragraphs that do: they aren't read, so nothing may be called absent from them."""
    beside = re.compile(r"word/((?:footnotes|endnotes|comments)|(?:header|footer)\d*)\.xml")
    out = []
    for name in sorted(filter(beside.fullmatch, archive.namelist())):
        count = sum(any((t.text or "").strip() for t in p.iter(f"{W}t")) for p in _root(archive, name).iter(f"{W}p"))
        if count:
            out.append(f"{beside.fullmatch(name)[1]}:{count}")
    return out


def slide_lines(archive: zipfile.ZipFile) -> list[str]:
    """Slides by number, each under a banner."""
    numbers = sorted(int(m[1]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for n in numbers:
        out.append(f"########## slide {n} ##########")
        for p in _root(archive, f"ppt/slides/slide{n}.xml").iter(f"{A}p"):
            text = "".join(t.text or "" for t in p.iter(f"{A}t"))
            if text.strip():
                out.append(text)
    return out


def _shared(archive: zipfile.ZipFile) -> list[str]:
    name = "xl/sharedStrings.xml"
    return ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in _root(archive, name).iter(f"{S}si")] if name in archive.namelist() else []


def sheets(archive: zipfile.ZipFile) -> list[tuple[str, list[tuple[int, dict[int, str]]]]]:
    """(name, rows) of each sheet; a row is its physical number and the cells by column number."""
    shared = _shared(archive)
    targets = {r.get("Id"): r.get("Target") for r in _root(archive, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _root(archive, "xl/workbook.xml").iter(f"{S}sheet"):
        path = targets[sheet.get(f"{R}id")].lstrip("/")
        rows = []
        for row in _root(archive, path if path.startswith("xl/") else f"xl/{path}").iter(f"{S}row"):
            cells = {}
            for c in row.iter(f"{S}c"):
                place = 0
                for letter in re.match("[A-Z]*", c.get("r") or "")[0]:
                    place = place * 26 + ord(letter) - 64
                value = c.find(f"{S}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                else:
                    text = "" if value is None or value.text is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[place or len(cells) + 1] = text
            rows.append((int(row.get("r") or len(rows) + 1), cells))
        out.append((sheet.get("name"), rows))
    return out


def sheet_lines(archive: zipfile.ZipFile) -> list[str]:
    out = []
    for name, rows in sheets(archive):
        out.append(f"########## sheet {name} ##########")
        for _, cells in rows:
            line = [cells.get(k, "") for k in range(1, max(cells, default=0) + 1)]
            while line and not line[-1].strip():
                line.pop()
            if line:
                out.append(" | ".join(line))
    return out


def document_tables(archive: zipfile.ZipFile) -> list[list[list[str]]]:
    """Cells of each top-level table; a cell over several columns fills its place and leaves the others blank."""
    out = []
    for table in _root(archive, "word/document.xml").find(f"{W}body").findall(f"{W}tbl"):
        rows = []
        for tr in table.findall(f"{W}tr"):
            row = []
            for tc in tr.findall(f"{W}tc"):
                span = tc.find(f"{W}tcPr/{W}gridSpan")
                row.append("\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in tc.findall(f"{W}p")).strip())
                row += [""] * (int(span.get(f"{W}val")) - 1 if span is not None else 0)
            rows.append(row)
        out.append(rows)
    return out


def kind_of(content: bytes, path: str) -> str:
    """By content first: zip files are office files, by their parts; others are delimited text."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else "pptx" if any(n.startswith("ppt/") for n in names) else "unknown"
    return "pdf" if content[:4] == b"%PDF" else "delimited" if path.lower().endswith((".csv", ".tsv")) else "text"


def extract(content: bytes, path: str) -> tuple[list[str], str]:
    """Lines and status of a file; a failure is a status, never text."""
    try:
        kind = kind_of(content, path)
        if kind in ("docx", "pptx", "xlsx"):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                return {"docx": document_lines, "pptx": slide_lines, "xlsx": sheet_lines}[kind](archive), "ok"
        if kind in ("pdf", "unknown"):
            return [], f"unsupported: {kind}"
        return content.decode("utf-8-sig").splitlines(), "ok"
    except Exception as e:
        return [], f"failed: {type(e).__name__}"


def beside(content: bytes, path: str) -> list[str]:
    """What of a file wasn't read; empty for files of other kinds and for those that can't be read at all."""
    try:
        if kind_of(content, path) != "docx":
            return []
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return unread_parts(archive)
    except Exception:
        return []


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes, source_sha256, status, lines and unread parts of every file; a file is one row's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [(bytes(c), p) for c, p in zip(batch["content"], batch["path"], strict=True)]
            got = [extract(*f) for f in files]
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["length"], "source_sha256": batch["source_sha256"], "status": [s for _, s in got], "lines": [x for x, _ in got], "unread": [beside(*f) for f in files]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("source_sha256")).mapInPandas(run, "path string, bytes long, source_sha256 string, status string, lines array<string>, unread array<string>")


def register_rows(content: bytes, path: str, sheet: str | None = None, table: int | None = None) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Headers and (row number, cells) of a register in any of three formats."""
    kind = kind_of(content, path)
    if kind == "xlsx":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            found = sheets(archive)
        rows = next((r for n, r in found if sheet in (None, n)), [])
        width = max((max(c, default=0) for _, c in rows), default=0)
        body = [(n, [c.get(k, "") for k in range(1, width + 1)]) for n, c in rows]
    elif kind == "docx":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            found = document_tables(archive)
        if table is None and len(found) != 1:
            raise ValueError(f"{len(found)} tables: name one")
        body = list(enumerate(found[table or 0], 1))
    else:
        text = content.decode("utf-8-sig")
        try:
            dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
        except csv.Error:
            dialect = csv.excel
        body = [(n, r) for n, r in enumerate(csv.reader(io.StringIO(text), dialect), 1)]
    body = [(n, r) for n, r in body if any(x.strip() for x in r)]
    return ([x.strip() for x in body[0][1]], body[1:]) if body else ([], [])


def read_register(spark: SparkSession, path: str, sheet: str | None = None, table: int | None = None) -> DataFrame:
    """A register by header names, with _row, the physical row number. Missing cells are empty, never null.

    Two columns of one name are refused. The file is parsed where Spark reads it; only the header's names come to the driver.
    """
    first = spark.read.format("binaryFile").load(path).orderBy("path").limit(1)

    def names_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"headers": [register_rows(bytes(c), p, sheet, table)[0] for c, p in zip(batch["content"], batch["path"], strict=True)]})

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, p in zip(batch["content"], batch["path"], strict=True):
                rows = register_rows(bytes(c), p, sheet, table)[1]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=["_row", "cells"])

    files = first.select("content", "path")
    headers = files.mapInPandas(names_of, "headers array<string>").first()["headers"]
    names = [h or f"column_{k}" for k, h in enumerate(headers, 1)]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("the register has two columns of one name")
    rows = files.mapInPandas(rows_of, "_row int, cells array<string>")
    return rows.select("_row", *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])

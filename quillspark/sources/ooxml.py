"""Sheets and tables of office files as a Spark data source: spark.read.format("ooxml_sheet").load(path)."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from quillspark.sources import office

#: status is ok, or failed and why: a file or sheet that can't be read is one row with nulls, never missing.
SCHEMA = "path string, sheet string, _row int, cells array<string>, status string"


@dataclass
class Part(InputPartition):
    """A sheet of a workbook, all tables of a document, or what is wrong with a file."""

    path: str
    sheet: str | None = None
    name: str | None = None
    wrong: str | None = None


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _files(path: str) -> list[str]:
    """All files of path that may be office files, in order; a file that is named is taken whatever it is called."""
    from pyarrow import fs

    scheme = m[0] if (m := re.match(r"\w+:/+", path)) else ""
    system, inner = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if scheme and path.endswith(inner) else "file://" if scheme.startswith("file") else scheme
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".xlsm", ".docx")))


def _column(reference: str | None) -> int:
    place = 0
    for letter in re.match("[A-Z]*", reference or "")[0]:
        place = place * 26 + ord(letter) - 64
    return place


def sheet_rows(archive: zipfile.ZipFile, name: str) -> Iterator[tuple[int, list[str]]]:
    """Physical row number and cells of a sheet's part, row by row: the part is never held as a whole."""
    shared = office._shared(archive)
    last = 0
    with archive.open(name) as stream:
        for _, element in ET.iterparse(stream):
            if element.tag != f"{office.S}row":
                continue
            cells: dict[int, str] = {}
            for c in element.iter(f"{office.S}c"):
                value = c.find(f"{office.S}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{office.S}t"))
                else:
                    text = "" if value is None or value.text is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[_column(c.get("r")) or len(cells) + 1] = text
            last = int(element.get("r") or last + 1)
            yield last, [cells.get(k, "") for k in range(1, max(cells, default=0) + 1)]
            element.clear()


class SheetReader(DataSourceReader):
    """One partition for each sheet or document; equalities on path and sheet take the others off before anything is read."""

    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], {k: options[k] for k in ("sheet",) if k in options}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("sheet",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in _files(self.path):
            if self.wanted.get("path", path) != path:
                continue
            try:
                with _open(path) as file, zipfile.ZipFile(file) as archive:
                    names = archive.namelist()
                    if "xl/workbook.xml" in names:
                        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in office._root(archive, "xl/_rels/workbook.xml.rels")}
                        for sheet in office._root(archive, "xl/workbook.xml").iter(f"{office.S}sheet"):
                            part = targets[sheet.get(f"{office.R}id")]
                            out.append(Part(path, sheet.get("name"), part if part.startswith("xl/") else f"xl/{part}"))
                    elif "word/document.xml" in names:
                        out += [Part(path, f"table {k}", str(k)) for k in range(1, len(office.document_tables(archive)) + 1)]
                    else:
                        out.append(Part(path, wrong="failed: no office file"))
            except Exception as e:
                out.append(Part(path, wrong=f"failed: {type(e).__name__}"))
        return [p for p in out if p.wrong or self.wanted.get("sheet", p.sheet) == p.sheet] or [Part(self.path, wrong="")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.wrong is not None:
            if partition.wrong:
                yield partition.path, None, None, None, partition.wrong
            return
        try:
            with _open(partition.path) as file, zipfile.ZipFile(file) as archive:
                rows = enumerate(office.document_tables(archive)[int(partition.name) - 1], 1) if partition.name.isdigit() else sheet_rows(archive, partition.name)
                for number, cells in rows:
                    yield partition.path, partition.sheet, number, cells, "ok"
        except Exception as e:
            yield partition.path, partition.sheet, None, None, f"failed: {type(e).__name__}"


class SheetSource(DataSource):
    """path: a file or a folder that pyarrow's file systems open (local, object stores, HDFS); sheet: only sheets of this name. A store that only
    Spark opens is read by office.read_files()."""

    @classmethod
    def name(cls) -> str:
        return "ooxml_sheet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with equalities pushed into it."""
    spark.dataSource.register(SheetSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

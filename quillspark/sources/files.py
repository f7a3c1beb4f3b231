"""Configuration, results and exports as files (2.A, 2.B)."""

from __future__ import annotations

import json
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

try:
    import yaml
except ImportError:  # only the YAML readers and writers need it
    yaml = None
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBLIGATION = "id string, modality string, subject string, text string, source_ref string, scope string, section string, locator string"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a corpus file; roles are a closed set and there is one anchor."""
    docs = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("documents", [])
    roles = {"anchor", "requirements", "draft", "reference"}
    if bad := [d for d in docs if d.get("role") not in roles]:
        raise ValueError(f"unknown role: {bad[0].get('role')}")
    if sum(d["role"] == "anchor" for d in docs) != 1:
        raise ValueError("a corpus has exactly one anchor")
    return spark.createDataFrame([tuple(d.get(k) for k in ("slug", "path", "role", "sha256", "note")) for d in docs], "slug string, path string, role string, sha256 string, note string")


def load_obligations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): items without a text are rejected, with a reason."""
    items = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    items = items.get("obligations", []) if isinstance(items, dict) else items
    names = [x.split()[0] for x in OBLIGATION.split(", ")]
    every = spark.createDataFrame([tuple(None if i.get(n) is None else str(i[n]) for n in names) for i in items], OBLIGATION)
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return every.filter(~empty), every.filter(empty).withColumn("reason", F.lit("no text"))


def load_pairs(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A lexicon, components or aliases: one row for each key and value."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = [(str(k), str(v)) for k, own in data.items() for v in (own if isinstance(own, list) else [own])]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias and canonical name of a file of components: a mapping of names, a list of entries with name and aliases, or either under components.

    Names are in lower case, aliases without marks; a name is an alias of itself; of two entries with one alias the later one counts. No file: no rows."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None
    if isinstance(data, dict):
        data = data.get("components", data)
    entries = [{"name": k, **(v if isinstance(v, dict) else {})} for k, v in data.items()] if isinstance(data, dict) else [x for x in data or [] if isinstance(x, dict)]
    rows: dict[str, str] = {}
    for entry in entries:
        name = str(entry.get("name") or "").strip().lower()
        for alias in [name, *map(str, entry.get("aliases") or [])] if name else []:
            if clean := " ".join(re.sub("[^a-z0-9 ]", " ", alias.lower()).split()):
                rows[clean] = name
    return spark.createDataFrame(list(rows.items()), "alias string, canonical string")


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term a line; what follows # is a comment."""
    term = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(term.alias("term")).filter("term <> ''")


def load_questions(text: str) -> list[str]:
    """A numbered list with wrapped lines joined; without numbers, a question a line."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not any(re.match(r"\d+[.)]\s", x) for x in lines):
        return lines
    out: list[str] = []
    for x in lines:
        if m := re.match(r"\d+[.)]\s+(.*)", x):
            out.append(m[1])
        elif out:
            out[-1] += " " + x
    return out


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): JSON lines by a schema; those that can't be read are rows of their own."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select("_bad")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, as text by the names of schema; no file is no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = [x.split()[0] for x in schema.split(", ")]
    return found.select(*[F.col(f"`{n}`") if n in found.columns else F.lit(None).cast("string").alias(n) for n in names])


def load_rows(spark: SparkSession, path: str, root: str, schema: str) -> DataFrame:
    """The items under root of a reviewer's YAML file (ground truth, references, a map, answers), with the fields of schema."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    items = data.get(root, []) if isinstance(data, dict) else data
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def replace_file(path: str, text: str) -> None:
    """A file as a whole or not at all: written beside, then renamed."""
    beside = Path(f"{path}.tmp")
    beside.write_text(text, encoding="utf-8")
    beside.replace(path)


def provenance(manifest: DataFrame, slug: str) -> str:
    """The header that says which text a report is about, with both hashes."""
    r = manifest.filter(F.col("slug") == slug).first()
    if r is None:
        raise ValueError(f"{slug} isn't in the manifest")
    return f"{slug}: source {r['source_sha256'][:12]}, text {r['text_sha256'][:12]}, {r['text_lines']} lines"


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key isn't there yet; Spark's commit makes the append whole or nothing."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti")
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    return count


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet, CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": writer.option("header", True).csv, "json": writer.json}[kind](path)


def write_yaml(df: DataFrame, path: str, root: str) -> None:
    """A reviewer's file of few rows."""
    Path(path).write_text(yaml.safe_dump({root: [r.asDict(recursive=True) for r in df.toLocalIterator()]}, sort_keys=False, allow_unicode=True), encoding="utf-8")


def numbered(df: DataFrame, order: list, prefix: str) -> DataFrame:
    """Ids by position: D5-001, D5-002 and so on."""
    from quillspark.operators.aggregates import ranked

    return ranked(df, order, "_n").withColumn("id", F.format_string(f"{prefix}-%03d", "_n")).drop("_n")


def annotate(register: DataFrame, values: DataFrame, column: str, overwrite: bool = False) -> DataFrame:
    """Sets one column by physical row; filled cells stay unless overwrite."""
    new = values.select("_row", F.col("value").alias("_value"))
    old = F.nullif(F.trim(F.col(f"`{column}`")), F.lit(""))
    value = F.coalesce(F.col("_value"), old) if overwrite else F.coalesce(old, F.col("_value"))
    joined = register.join(new, "_row", "left")
    return joined.select(*[F.coalesce(value, F.lit("")).alias(c) if c == column else F.col(f"`{c}`") for c in register.columns])


def insert_column(register: DataFrame, name: str, before: str, value="") -> DataFrame:
    """A new column before another one."""
    out = []
    for c in register.columns:
        out += ([F.lit(value).alias(name)] if c == before else []) + [F.col(f"`{c}`")]
    return register.select(*out)


#: The same rows give the same bytes.
FIXED_TIME = (1980, 1, 1, 0, 0, 0)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A workbook of one sheet with inline strings; rows stream from the cluster one partition at a time."""

    def letters(n: int) -> str:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    def row(n: int, cells: list) -> str:
        return f'<row r="{n}">' + "".join(f'<c r="{letters(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape("" if c is None else str(c))}</t></is></c>' for k, c in enumerate(cells, 1)) + "</row>"

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kinds = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    app = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{app}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{app}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(zipfile.ZipInfo(name, FIXED_TIME), content)
        with archive.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml", FIXED_TIME), "w") as out:
            out.write(f'{head}<worksheet xmlns="{main}"><sheetData>{row(1, df.columns)}'.encode())
            for n, r in enumerate(df.toLocalIterator(), 2):
                out.write(row(n, list(r)).encode())
            out.write(b"</sheetData></worksheet>")


def markdown_table(df: DataFrame, most: int | None = None) -> str:
    """A report's table: every row, or the first most of them and how many more there are."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    rows = df.toLocalIterator() if most is None else iter(df.limit(most).collect())
    out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    left = 0 if most is None else df.count() - most
    return "\n".join(out + ([f"\n… {left} more"] if left > 0 else []))


def html_table(df: DataFrame) -> str:
    """Every row of a table."""
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in row) + "</tr>"
    return "<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in df.toLocalIterator()) + "</table>"


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """One Markdown file, a section for each table."""
    Path(path).write_text("\n\n".join(f"## {k}\n\n{markdown_table(v)}" for k, v in parts.items()) + "\n", encoding="utf-8")


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)


def unescaped(x: str) -> str:
    """A string as JSON reads it; one that JSON refuses stays as it is."""
    try:
        return json.loads(f'"{x}"')
    except ValueError:
        return x


def salvage(raw: str) -> tuple[list[str], str]:
    """Quotes and answer of a reply whose JSON may be broken.

    The reply is read as a run of strings; one with a colon behind it is a key, and those behind a key are its values.
    """
    values: dict[str, list[str]] = {}
    key = ""
    for text, colon in _STRING.findall(raw):
        if colon:
            key = unescaped(text)
        else:
            values.setdefault(key, []).append(unescaped(text))
    quotes = [q for q in values.get("quotes", []) if q.strip()]
    return quotes, next(iter(values.get("answer", [])), "").strip()


def unsafe_files(spark: SparkSession, path: str, denied: DataFrame) -> DataFrame:
    """C14: path, n, digest and hits of phrases of a denylist (n, digest) in all files of a tree, whatever they are, and status: a file that can't be read
    is a row too, as nothing may be called absent from it."""
    from quillspark.operators.closure import denied_phrases
    from quillspark.sources.office import read_files

    read = read_files(spark, path).select(F.col("path").alias("slug"), "status", F.array_join("lines", "\n").alias("text"))
    found = denied_phrases(read.filter("status = 'ok'"), denied).select(F.col("slug").alias("path"), "n", "digest", "hits", F.lit("ok").alias("status"))
    bad = read.filter("status <> 'ok'").select(F.col("slug").alias("path"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("hits"), "status")
    return found.unionByName(bad)

"""Workbooks and word-processor files as rows: both are ZIP archives of XML, read with the standard library.

One task reads whole files; rows leave it file by file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CELLS = "sheet string, row int, col int, ref string, value string"
MERGED = "sheet string, r1 int, c1 int, r2 int, c2 int"
PARTS = "pos int, type string, level int, content string, cells array<array<string>>"


def place(ref: str) -> tuple[int, int]:
    """Row and column (from 1) of a cell reference."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits), col


def read_workbook(content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Cells and merged ranges of all sheets with two rows and two columns or more."""
    cells, merged = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for title, name in zip(titles, sheets):
            root, own = ElementTree.fromstring(z.read(name)), []
            for c in root.iter(f"{_S}c"):
                value = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else None)
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                if text is not None:
                    own.append((title, *place(c.get("r")), c.get("r"), text))
            if len({c[1] for c in own}) < 2 or len({c[2] for c in own}) < 2:
                continue
            cells += own
            for m in root.iter(f"{_S}mergeCell"):
                first, last = (m.get("ref") + ":" + m.get("ref")).split(":")[:2]
                merged.append((title, *place(first), *place(last)))
    return cells, merged


def read_document(content: bytes) -> list[tuple]:
    """Paragraphs first, then tables, of a word-processor file: pos, type, level, content, cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()

    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.search(r"(?i)heading\s*(\d)", style.get(f"{_W}val") or "") if style is not None else None
        if text(p):
            out.append(("heading" if level else "paragraph", int(level[1]) if level else None, text(p), None))
    for t in body.findall(f"{_W}tbl"):
        rows = [[text(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        out.append(("table", None, "\n".join(" ".join(r) for r in rows), rows))
    return [(i, *x) for i, x in enumerate(out)]


def _each(spark: SparkSession, root: str, glob: str, schema: str, read) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    got = read(content)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue  # no readable archive: a defined result, no rows
                if got:
                    yield pd.DataFrame([(path, *r) for r in got], columns=["file", *names])

    return files.mapInPandas(rows, f"file string, {schema}")


def cells(spark: SparkSession, root: str) -> DataFrame:
    """file and CELLS of all workbooks under root."""
    return _each(spark, root, "*.xlsx", CELLS, lambda b: read_workbook(b)[0])


def merged_ranges(spark: SparkSession, root: str) -> DataFrame:
    return _each(spark, root, "*.xlsx", MERGED, lambda b: read_workbook(b)[1])


def word_elements(spark: SparkSession, root: str) -> DataFrame:
    """file and PARTS of all word-processor files under root."""
    return _each(spark, root, "*.docx", PARTS, read_document)


def sheet_markdown(rows: DataFrame) -> DataFrame:
    """rows (file, sheet, row, col, value) -> file, sheet, markdown: each sheet as a pipe table in order."""
    wide = rows.groupBy("file", "sheet", "row").agg(F.max("col").alias("width"), F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    full = wide.join(wide.groupBy("file", "sheet").agg(F.max("width").alias("all")), ["file", "sheet"])
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), "all"), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(""))), " | "), F.lit(" |"))
    lines = full.select("file", "sheet", "row", line.alias("line"))
    return lines.groupBy("file", "sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("markdown"))

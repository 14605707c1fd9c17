"""Excel workbooks as a Spark source.

``binaryFile`` lists and reads the files; each file is parsed on an executor
with the standard library (an .xlsx file is a zip of XML parts).  Output is
one row per sheet row: (source_path, row_id, cells, error) where ``cells``
maps the header text to the cell text and ``row_id`` is the 0-based data row,
the id every other operator uses; blank sheet rows keep their number.  A file
that cannot be read gives one row with its message in ``error``.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# XML namespaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_COL = re.compile(r"([A-Z]+)")
OUT_SCHEMA = "source_path string, row_id bigint, cells map<string,string>, error string"


def _col_index(ref: str) -> int:
    n = 0
    for ch in _COL.match(ref).group(1):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _rich_text(node) -> str:
    """Text of a string item: its own and its runs', without phonetic hints."""
    parts = [*node.findall(f"{_MAIN}t"), *node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(t.text or "" for t in parts)


def _cell_text(c, shared: list[str]) -> str | None:
    kind = c.get("t")
    if kind == "inlineStr":
        inline = c.find(f"{_MAIN}is")
        return None if inline is None else _rich_text(inline)
    v = c.find(f"{_MAIN}v")
    if v is None:
        return None
    return shared[int(v.text)] if kind == "s" else v.text


def _sheet_part(z: zipfile.ZipFile, sheet: int) -> str:
    """Zip entry of the ``sheet``-th sheet in workbook order (by file name
    where the book does not say)."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        sheets = ET.fromstring(z.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
        targets = {r.get("Id"): r.get("Target") for r in
                   ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        target = targets[sheets[sheet - 1].get(_RELATION)]
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return f"xl/worksheets/sheet{sheet}.xml"


def read_xlsx_rows(data: bytes, sheet: int = 1) -> list[tuple[int, list[str | None]]]:
    """(row number, cell texts) of the rows of one sheet (the first by default)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_rich_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        root = ET.fromstring(z.read(_sheet_part(z, sheet)))
    rows, number = [], 0
    for row in root.iter(f"{_MAIN}row"):
        number = int(row.get("r") or number + 1)
        cells: dict[int, str | None] = {}
        at = -1
        for c in row.findall(f"{_MAIN}c"):  # a cell without a reference follows the one before
            at = _col_index(c.get("r")) if c.get("r") else at + 1
            cells[at] = _cell_text(c, shared)
        rows.append((number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
    return rows


def _headers(first: list[str | None], width: int) -> list[str]:
    """One distinct name per column: a repeated header gets ``.1``, ``.2`` ...,
    a column without one ``col<position>``."""
    names: list[str] = []
    for i in range(width):
        name = first[i] if i < len(first) and first[i] is not None else f"col{i}"
        unique, n = name, 0
        while unique in names:
            n += 1
            unique = f"{name}.{n}"
        names.append(unique)
    return names


def _sheet_rows(path: str, content: bytes) -> list[tuple]:
    rows = read_xlsx_rows(content)
    if not rows:
        return []
    top, first = rows[0]
    header = _headers(first, max(len(r) for _, r in rows))
    return [(path, number - top - 1, dict(zip(header, row + [None] * (len(header) - len(row)))), None)
            for number, row in rows[1:]]


def _parse_batches(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                out = _sheet_rows(path, bytes(content))
            except Exception as problem:  # a damaged file, of any kind: reported, not fatal
                out = [(path, None, None, f"{type(problem).__name__}: {problem}")]
            yield pd.DataFrame(out, columns=["source_path", "row_id", "cells", "error"]).astype(
                {"row_id": "Int64"})


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInPandas(_parse_batches, OUT_SCHEMA)


def workbook_errors(rows: DataFrame) -> DataFrame:
    """The files that could not be read, with the message."""
    return rows.where(F.col("error").isNotNull()).select("source_path", "error")


def workbook_table(rows: DataFrame, columns: dict[str, str], day=None) -> DataFrame:
    """Project header names to column names; ``day`` is a column or a literal.
    Unreadable files are in ``workbook_errors``."""
    sel = [F.col("cells")[h].alias(c) for h, c in columns.items()]
    out = rows.where(F.col("error").isNull()).select("source_path", "row_id", *sel)
    if day is not None:
        out = out.withColumn("dia", day if not isinstance(day, (int, str)) else F.lit(day))
    return out

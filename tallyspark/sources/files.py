"""Readers of statement files: CSV in three encodings, and xlsx without further libraries.

The rows come with their ordinals: __source_row__ (1-based data row) and __file_row__.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.ordinals import ranked
from tallyspark.sources import headers

ENCODINGS = ("utf-8-sig", "gbk", "latin1")
LARGE = 64 << 20  # bytes from which on a CSV is read by the executors
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_CELL = re.compile(r"([A-Z]+)(\d+)")
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def check(path: str) -> str:
    """The file's kind; missing and unsupported files fail when the plan is built."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".csv", ".xlsx"):
        raise ValueError(f"unsupported file format: {kind or path}")
    return kind


def sniff(path: str) -> str:
    """The first encoding that reads the file; of a large one, its first LARGE characters."""
    for name in ENCODINGS:
        try:
            with open(path, encoding=name) as file:
                for _ in range(LARGE >> 20):
                    if not file.read(1 << 20):
                        break
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"cannot decode {path}")


def csv_rows(path: str) -> Iterator[list[str]]:
    import csv

    with open(path, encoding=sniff(path), newline="") as file:
        yield from csv.reader(file)


def _column(letters: str) -> int:
    out = 0
    for c in letters:
        out = 26 * out + ord(c) - 64
    return out - 1


def xlsx_rows(path: str, expand: bool = True) -> list[list[str | None]]:
    """The first sheet's cells as text; merged boxes repeat their first cell."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        target = "worksheets/sheet1.xml"
        if "xl/_rels/workbook.xml.rels" in names and first is not None:
            for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
                if relation.get("Id") == first.get(_RELATION):
                    target = relation.get("Target").removeprefix("/xl/")
        sheet = ElementTree.fromstring(book.read(f"xl/{target}"))
    rows: list[list[str | None]] = []
    for row in sheet.findall("m:sheetData/m:row", _NS):
        at = int(row.get("r", len(rows) + 1)) - 1
        while len(rows) <= at:
            rows.append([])
        for k, cell in enumerate(row.findall("m:c", _NS)):
            found = _CELL.match(cell.get("r", ""))
            i = _column(found[1]) if found else k
            value = cell.find("m:v", _NS)
            text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) or None
            if cell.get("t") == "s" and text is not None:
                text = shared[int(text)]
            rows[at] += [None] * (i + 1 - len(rows[at]))
            rows[at][i] = text
    for box in sheet.findall("m:mergeCells/m:mergeCell", _NS) if expand else []:
        (a, b), (c, d) = [(x[1], int(x[2])) for x in _CELL.finditer(box.get("ref", ""))]
        top = rows[b - 1][_column(a)] if b <= len(rows) and _column(a) < len(rows[b - 1]) else None
        for r in range(b - 1, min(d, len(rows))):
            rows[r] += [None] * (_column(c) + 1 - len(rows[r]))
            rows[r][_column(a) : _column(c) + 1] = [top] * (_column(c) + 1 - _column(a))
    return rows


def structure_of(path: str) -> headers.TableStructure:
    """The header found in a file."""
    plain = xlsx_rows(path, expand=False)[: headers.SCANNED_ROWS] if check(path) == ".xlsx" else None
    return headers.detect(preview(path), plain)


def preview(path: str, rows: int = headers.SCANNED_ROWS) -> list[list]:
    """The first rows, for header detection."""
    if check(path) == ".xlsx":
        return xlsx_rows(path)[:rows]
    out = []
    for row in csv_rows(path):
        out.append(row)
        if len(out) == rows:
            break
    return out


def load(spark: SparkSession, path: str, structure: headers.TableStructure | None = None) -> DataFrame:
    """A statement file as text columns with row ordinals; blank lines are not rows.

    A CSV of LARGE bytes or more is read by the executors, see `load_large_csv`.
    """
    kind = check(path)
    structure = structure or structure_of(path)
    names, first = list(structure.columns), structure.skiprows + structure.header_rows
    if kind == ".csv" and os.path.getsize(path) >= LARGE:
        return load_large_csv(spark, path, names, first, sniff(path))
    rows = xlsx_rows(path, expand=False)[first:] if kind == ".xlsx" else _after(csv_rows(path), first)
    schema = T.StructType([T.StructField("__source_row__", T.LongType()), T.StructField("__file_row__", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    data = []
    for k, row in enumerate(rows):
        if any(headers._clean(c) for c in row):
            cells = [(c if c not in ("", None) else None) for c in row[: len(names)]]
            data.append((len(data) + 1, first + k + 1, *cells, *[None] * (len(names) - len(cells))))
    return spark.createDataFrame(data, schema)


def _after(rows: Iterator[list], skipped: int) -> list[list]:
    for _ in range(skipped):
        next(rows, None)
    return list(rows)


def load_large_csv(spark: SparkSession, path: str, columns: list[str], skipped: int, encoding: str = "utf-8-sig") -> DataFrame:
    """A CSV too large for one task: the executors split it by lines, and ordinals come from each line's place in its file.

    Cells can't hold line breaks here.  Lines before the data (skipped) are counted as they are in the file.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("__bytes"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__place"))
    at = ranked(lines, ["__block", "__place"], "__at").where(F.col("__at") >= skipped)

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: bytes(x).decode(encoding, "replace").removesuffix("\r"))

    cells = F.from_csv(decoded("__bytes"), _ddl(columns), {"mode": "PERMISSIVE"})
    rows = at.select("__at", cells.alias("__c"))
    for_each = [F.when(F.trim(F.col("__c")[c]) != "", F.col("__c")[c]).alias(c) for c in columns]
    rows = rows.select((F.col("__at") + 1).alias("__file_row__"), *for_each)
    filled = F.lit(False)
    for c in columns:
        filled = filled | F.col(f"`{c}`").isNotNull()
    out = ranked(rows.where(filled), ["__file_row__"], "__source_row__")
    return out.select((F.col("__source_row__") + 1).alias("__source_row__"), "__file_row__", *[F.col(f"`{c}`") for c in columns])


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)

"""Report tables to files: one Parquet or CSV folder each, or one xlsx workbook for small reports."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import text

LONGEST_SHEET_NAME = 31
MOST_ROWS = 1_048_575


def safe(df: DataFrame) -> DataFrame:
    """Text columns guarded against formulas and control characters; numbers and dates as they are."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            col = F.when(col.isNull(), None).otherwise(text.clean_excel_string(col))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            col = text.clean_excel_string(F.to_json(col))
        out.append(col.alias(f.name))
    return df.select(*out)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table to folder/name, in parallel, whatever its size."""
    for name, df in tables.items():
        writer = safe(df).write.mode("overwrite")
        writer.parquet(f"{folder}/{name}") if kind == "parquet" else writer.csv(f"{folder}/{name}", header=True)


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:LONGEST_SHEET_NAME] or "Sheet"


def column_format(name: str, kind: T.DataType) -> str:
    """pct, date, text or money: how a column's numbers are shown."""
    if re.search("率|占比|percent|ratio", name, re.IGNORECASE):
        return "pct"
    if isinstance(kind, (T.DateType, T.TimestampType)) or re.search("日期|date", name, re.IGNORECASE):
        return "date"
    if isinstance(kind, T.StringType) or re.search("编号|账号|凭证|_id$", name, re.IGNORECASE):
        return "text"
    return "money"


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet per table; a table longer than a sheet fails rather than being cut."""
    sheets = []
    for name, df in tables.items():
        rows = safe(df).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold; use write_tables")
        sheets.append((sheet_name(name), [df.columns, *[list(r) for r in rows]]))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/relationships">{links}</Relationships>')
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r}">{"".join(_cell(v) for v in row)}</row>' for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f"<c><v>{value}</v></c>"

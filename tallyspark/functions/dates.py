"""Dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; each with the shape that a text must have, as the parser alone is too lenient.
FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyy年M月d日", r"^\d{4}年\d{1,2}月\d{1,2}日$"),
)
EXCEL_DAYS = (1, 100_000)


def parse_date(value: Column, first_format: str | None = None) -> Column:
    """The day in a cell, or null: an Excel serial number, else the formats in order, else a timestamp's day."""
    text = F.trim(value)
    number = text.try_cast("double")
    serial = F.when(number.between(*EXCEL_DAYS), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")))
    tried = [F.try_to_timestamp(text, F.lit(first_format)).cast("date")] if first_format else []
    for pattern, shape in FORMATS:
        tried.append(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("date")))
    tried.append(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d"), F.try_to_timestamp(text).cast("date")))
    return F.coalesce(serial, *tried)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)

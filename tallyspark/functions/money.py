"""Money as Column expressions: DECIMAL yuan, and BIGINT li (1 yuan = 10 000 li)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: meanings of direction cells ------------------------------------------
BANK_SIGNS = {
    "贷": 1, "贷方": 1, "收": 1, "收入": 1, "来账": 1, "收款": 1, "入": 1, "转入": 1, "存入": 1, "进": 1,
    "CREDIT": 1, "C": 1, "CR": 1, "INCOME": 1, "IN": 1,
    "借": -1, "借方": -1, "支": -1, "支出": -1, "往账": -1, "付": -1, "出": -1, "转出": -1, "取出": -1, "退": -1, "付款": -1,
    "DEBIT": -1, "D": -1, "DR": -1, "EXPENSE": -1, "OUT": -1,
}
JOURNAL_SIGNS = {
    "借": 1, "借方": 1, "收": 1, "收入": 1, "来账": 1, "收款": 1, "入": 1, "转入": 1, "存入": 1, "进": 1,
    "DEBIT": 1, "D": 1, "DR": 1, "INCOME": 1, "IN": 1,
    "贷": -1, "贷方": -1, "支": -1, "支出": -1, "往账": -1, "付": -1, "出": -1, "转出": -1, "取出": -1, "退": -1, "付款": -1,
    "CREDIT": -1, "C": -1, "CR": -1, "EXPENSE": -1, "OUT": -1,
}
SYMBOLS = r"[¥$￥€£₩\s]"
CURRENCY_CODES = r"(?i)JP¥|CNY|USD|EUR|GBP|JPY|KRW"
THOUSANDS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．，－", "0123456789.,-"
# ----------------------------------------------------------------------------------------

INVISIBLE = "[ ​-‏ - 　﻿­]"


def decimal(value: Column) -> Column:
    """The number in a text, or null."""
    return value.try_cast("decimal(38,18)")


def to_decimal(value: Column) -> Column:
    """Yuan with 2 places, halves away from zero; 0 for what is no number."""
    return F.coalesce(F.round(decimal(value), 2), F.lit(0)).cast("decimal(20,2)")


def to_li(value: Column) -> Column:
    """Li of a yuan amount, halves away from zero; 0 for what is no number."""
    return F.coalesce((F.round(decimal(value), 4) * F.lit(10_000)).cast("bigint"), F.lit(0).cast("bigint"))


def from_li(li: Column) -> Column:
    return F.round(li.cast("decimal(38,4)") / F.lit(10_000), 2).cast("decimal(20,2)")


def amounts_match(a: Column, b: Column, tolerance_li: int = 100) -> Column:
    return F.abs(a - b) <= F.lit(tolerance_li)


def compare_amounts(a: Column, b: Column) -> Column:
    return F.signum(a - b).cast("int")


def normalize_amount_text(value: Column) -> Column:
    """An amount's text in plain digits; null if its commas don't part thousands."""
    text = F.translate(F.regexp_replace(value, INVISIBLE, ""), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(F.regexp_replace(text, CURRENCY_CODES, ""), SYMBOLS, "")
    return F.when(~text.contains(","), text).when(text.rlike(THOUSANDS), F.replace(text, F.lit(","), F.lit("")))


def clean_amount(value: Column, suffix_sign: bool = True) -> Column:
    """Yuan with 2 places of an amount cell: 0.00 if empty, null if unreadable.

    One pair of ASCII brackets about the whole cell turns the sign; any other bracket makes the
    cell unreadable.  With suffix_sign, CR and 贷 at the end turn it as well, DR and 借 don't.
    """
    text = F.trim(value)
    empty = value.isNull() | (text == "") | (F.lower(text) == "nan")
    bracketed = text.rlike(r"(?s)^\(.*\)$")
    text = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    sign = F.when(bracketed, -1).otherwise(1)
    if suffix_sign:
        sign = sign * F.when(text.rlike(r"((?i:CR)|贷)$"), -1).otherwise(1)
        text = F.trim(F.regexp_replace(text, r"((?i:CR|DR)|贷|借)$", ""))
    number = F.round(decimal(normalize_amount_text(text)), 2)
    return F.when(empty, F.lit(0)).otherwise(number * sign).cast("decimal(20,2)")


def direction_sign(value: Column, source: str) -> Column:
    """1 for money in, -1 for money out, null for an unknown word."""
    signs = {"bank": BANK_SIGNS, "journal": JOURNAL_SIGNS}.get(source)
    if signs is None:
        raise ValueError(f"unknown source: {source}")
    pairs = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
    return F.try_element_at(pairs, F.upper(F.trim(value)))


def source_amount(value: Column, source: str, suffix_sign: bool = True) -> Column:
    """An amount whose CR/DR/借/贷 suffix is read from the source's side."""
    plain = clean_amount(value, suffix_sign=False)
    if not suffix_sign:
        return plain
    suffix = F.regexp_extract(F.trim(value), r"(?i)(CR|DR|借|贷)\s*$", 1)
    body = clean_amount(F.regexp_replace(F.trim(value), r"(?i)(CR|DR|借|贷)\s*$", ""), suffix_sign=False)
    return F.when(suffix == "", plain).otherwise((body * direction_sign(suffix, source)).cast("decimal(20,2)"))


def round_decimal(value: Column, places: int = 2) -> Column:
    """The number in a text to so many places, halves away from zero, as a double; 0.0 for what is no number."""
    return F.coalesce(F.round(decimal(value), places).cast("double"), F.lit(0.0))


def restored_number(value: Column) -> Column:
    """The number in a cell that may have commas, as a double; null if there is none."""
    plain = F.replace(F.trim(value), F.lit(","), F.lit(""))
    return F.when((plain != "") & (F.lower(plain) != "nan"), plain.try_cast("double"))


def bucket_counts(li: Column, prefix: str = "bucket") -> list[Column]:
    """Counts of amounts in [0,100), [100,1k), [1k,10k), [10k,100k), [100k,...) yuan."""
    edges = [0, 100, 1_000, 10_000, 100_000]
    size = F.abs(li)
    out = []
    for i, low in enumerate(edges):
        inside = size >= low * 10_000
        if i + 1 < len(edges):
            inside &= size < edges[i + 1] * 10_000
        out.append(F.count_if(inside).alias(f"{prefix}_{i}"))
    return out

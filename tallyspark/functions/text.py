"""Text functions: native expressions where Spark has them, Arrow functions for the rest."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words and character maps ---------------------------------------------
FULL_WIDTH = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
NOISE_WORDS = [
    "收到", "支付", "转账", "往来款", "往来", "汇款", "电汇", "网银", "网转", "银转", "转帐", "付款", "收款", "入账", "出账", "交易",
    "资金", "款项", "结算", "清算", "汇划", "划款", "扣款", "退款", "银行", "账户", "账号", "对公", "对私", "个人", "企业", "公司",
    "有限公司", "有限责任公司", "股份公司", "股份有限公司",
]
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
TROUBLESOME = "[​-‏ - ﻿­]"
CATEGORIES = (("对方户名", ("户名", "客户名称", "对方名称")), ("账号", ("账号", "帐号")), ("卡号", ("卡号",)))
TYPE_NAMES = {
    "exact_1to1": "精确一对一", "tolerance_date": "日期容差", "amount_difference": "明显微小金额差异", "batch_aggregation": "批量聚合",
    "continuous_summary_group": "连续摘要整组", "combination_dfs": "组合求和", "daily_total": "日总额", "monthly_total": "月总额",
    "cross_month_total": "跨月多对多",
}
# ----------------------------------------------------------------------------------------

LONGEST_CELL = 32_000


def cell_text(value: Column) -> Column:
    """Trimmed text of a cell; '' for null, nan and none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text)


def normalize_summary(value: Column) -> Column:
    """Half-width, lower case, without serial numbers of 8 digits or more, noise words and spare spaces."""
    text = F.lower(F.translate(cell_text(value), FULL_WIDTH, HALF_WIDTH))
    text = F.regexp_replace(text, r"[0-9]{8,}", "")
    for word in NOISE_WORDS:  # in this order
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_excel_string(value: Column) -> Column:
    """A cell without control characters, with a guard before formulas, cut at the sheet's limit."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), ILLEGAL, ""), TROUBLESOME, "")
    text = F.when(text.rlike(r"^[\t\r]") | text.rlike(r"^ *[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(F.length(text) > LONGEST_CELL, F.concat(F.substring(text, 1, LONGEST_CELL), F.lit("..."))).otherwise(text)


def critical_category(label: Column) -> Column:
    out = None
    for name, words in CATEGORIES:
        hit = F.lit(False)
        for word in words:
            hit = hit | label.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def type_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), kind)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 85, "高").when(score >= 70, "中").otherwise("低")


def redact_sensitive(value: Column) -> Column:
    """Paths, tokens, key parameters and long digit runs masked."""
    text = F.regexp_replace(value, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer ***")
    text = F.regexp_replace(text, r"(?i)\b(api[_-]?key|key|token|secret|password)=([^&\s#]+)", "$1=***")
    text = F.regexp_replace(text, r"([A-Za-z]:\\[^\s]+|/(?:home|Users|root|tmp|var)/[^\s]+)", "[path]")
    return F.regexp_replace(text, r"\d{8,}", "********")


def sanitize_url(value: Column) -> Column:
    """scheme://host:port/path of a URL."""
    return F.regexp_extract(F.regexp_replace(value, r"//[^/@]*@", "//"), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+[^?#]*)", 1)


def bigrams(text: Column) -> Column:
    size = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(size >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram sets of two texts; 0 if either has none."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


_KEPT = re.compile("[^0-9a-z一-鿿]")


def plain(text: str | None) -> str:
    """NFKC, case-folded, only digits, Latin letters and Han characters."""
    text = unicodedata.normalize("NFKC", text or "").casefold().strip()
    return "" if text in ("nan", "none", "null") else _KEPT.sub("", text)


@lru_cache(maxsize=200_000)
def similarity(a: str | None, b: str | None) -> int:
    """0 to 100: the better of the matching-block ratio and the bigram Dice coefficient."""
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0
    if a == b:
        return 100
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    best = 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0
    blocks = difflib.SequenceMatcher(None, a, b)
    if blocks.real_quick_ratio() > best and blocks.quick_ratio() > best:  # bounds that are had at once
        best = max(best, blocks.ratio())
    return round(100 * best)


@F.pandas_udf(T.IntegerType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = similarity(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="int32")


def _category(label: str) -> str | None:
    return next((name for name, words in CATEGORIES if any(w in label for w in words)), None)


def _by_category(fields: dict[str, str] | None) -> dict[str, set[str]]:
    """Plain values of account fields by category."""
    own: dict[str, set[str]] = {}
    for label, value in (fields or {}).items():
        if (kind := _category(label)) and plain(value):
            own.setdefault(kind, set()).add(plain(value))
    return own


def signals(bank: dict[str, str] | None, journal: dict[str, str] | None) -> list[str]:
    """Of each category that both sides have, whether their values agree; never a value itself."""
    b, j = _by_category(bank), _by_category(journal)
    return [f"{kind}:{'相同' if b[kind] & j[kind] else '不同'}" for kind in sorted(b.keys() & j.keys())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_signals(bank: pd.Series, journal: pd.Series) -> pd.Series:
    return pd.Series([signals(dict(a) if a is not None else {}, dict(b) if b is not None else {}) for a, b in zip(bank, journal, strict=True)], dtype=object)


def evidence(bank: dict[str, str] | None, journal: dict[str, str] | None) -> tuple[int, list[str], list[str]]:
    """Local score 0-100 of two records' labelled texts, the labels that support it, and categories in conflict."""
    scores: dict[str, int] = {}
    for left, a in sorted((bank or {}).items()):
        for right, b in sorted((journal or {}).items()):
            label = left if left == right else f"{left}/{right}"
            scores[label] = max(scores.get(label, 0), similarity(a, b))
    best = sorted(scores.values(), reverse=True)[:3]
    local = round(0.6 * best[0] + 0.4 * sum(best) / len(best)) if best else 0
    b, j = _by_category(bank), _by_category(journal)
    conflicts = sorted(k for k in b if k in j and not b[k] & j[k])
    return local, sorted(k for k, v in scores.items() if v >= 60), conflicts


EVIDENCE = T.StructType(
    [T.StructField("local", T.IntegerType()), T.StructField("supporting", T.ArrayType(T.StringType())), T.StructField("conflicts", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(EVIDENCE)
def text_evidence(bank: pd.Series, journal: pd.Series) -> pd.DataFrame:
    known: dict[tuple, tuple] = {}
    rows = []
    for a, b in zip(bank, journal, strict=True):
        a, b = dict(a) if a is not None else {}, dict(b) if b is not None else {}
        key = (tuple(sorted(a.items())), tuple(sorted(b.items())))
        if key not in known:
            known[key] = evidence(a, b)
        rows.append(known[key])
    return pd.DataFrame(rows, columns=["local", "supporting", "conflicts"])


def text_score(local: Column, model: Column | None = None) -> Column:
    """0-30 of a local score 0-100, and of a semantic model's score where there is one."""
    combined = local.cast("double")
    if model is not None:
        combined = F.when(model.isNull(), combined).otherwise(F.bround(0.4 * local + 0.6 * model))
    return F.least(F.greatest(F.bround(0.3 * combined).cast("int"), F.lit(0)), F.lit(30))

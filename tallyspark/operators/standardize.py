"""Raw text tables to a standardised ledger, with rejected rows on the side.

A raw table has text columns and its rows' ordinals: __source_row__ (1-based, before any
filter) and __file_row__.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.functions.ordinals import checkpoints, ranked

# --- fixed values: words of summary rows ------------------------------------------------
SUMMARY_KEYWORDS = ["合计", "累计", "小计", "总计", "大计", "本期", "本日", "本月", "本年", "本季", "日计", "月计", "年计", "季计", "结转", "期初", "期末"]
SUMMARY_LABELS = [
    "本日合计", "本日累计", "本日发生额", "本日余额", "本日结存", "本日小计",
    "本旬合计", "本旬累计", "本旬发生额", "本旬余额", "本旬结存", "本旬小计",
    "本月合计", "本月累计", "本月发生额", "本月余额", "本月结存", "本月小计",
    "本季合计", "本季累计", "本季发生额", "本季余额", "本季结存", "本季小计",
    "本年合计", "本年累计", "本年发生额", "本年余额", "本年结存", "本年小计",
    "本期合计", "本期累计", "本期发生额", "本期余额", "本期结存", "本期小计",
    "日计", "月计", "季计", "年计", "期计", "日结", "月结", "季结", "年结", "合计", "累计", "总计", "小计", "大计", "发生额", "余额", "结存",
    "本页合计", "本页累计", "本页小计", "过次页", "承前页", "期初余额", "期末余额", "期初结存", "期末结存", "年初余额", "年末余额", "年初结存", "年末结存",
    "月初余额", "月末余额", "月初结存", "月末结存", "结转下年", "结转下期", "结转下月", "上年结转", "上期结转", "上月结转", "上年结余", "上期结余",
    "承前余额", "结转余额", "当前合计", "当前累计", "当前余额",
]
DATE_WORDS = ["日期", "date", "记账时间", "time", "交易日期"]
VOUCHER_WORDS = ["凭证", "voucher", "凭证号", "凭证编号"]
# ----------------------------------------------------------------------------------------

BLANK_DATE, BAD_DATE, BAD_AMOUNT, BAD_DIRECTION, DROPPED_SUMMARY = "空日期行", "日期解析失败", "金额解析失败", "方向解析失败", "被丢弃的汇总行"
MODES = ("debit_credit", "single_amount_with_direction", "signed_amount")


class TooManyBadAmounts(ValueError):
    """More than half of the amounts cannot be read."""


@dataclass(frozen=True)
class ColumnMapping:
    """Which raw column holds what."""

    date: str
    mode: str = "signed_amount"
    amount: str | None = None
    debit: str | None = None
    credit: str | None = None
    direction: str | None = None
    summary: str | None = None
    voucher: str | None = None
    balance: str | None = None
    auxiliary: tuple[str, ...] = field(default=())

    def required(self) -> list[str]:
        """Which columns the mode needs."""
        needed = {"debit_credit": ("debit", "credit"), "single_amount_with_direction": ("amount", "direction"), "signed_amount": ("amount",)}
        if self.mode not in needed:
            raise ValueError(f"unknown mode: {self.mode}")
        return ["date", *needed[self.mode]]

    def missing(self) -> list[str]:
        """Names of required columns that aren't mapped."""
        return [n for n in self.required() if not getattr(self, n)]


def _cell(name: str | None) -> Column:
    return text.cell_text(F.col(f"`{name}`")) if name else F.lit("")


def found_columns(raw: DataFrame, mapping: ColumnMapping) -> tuple[str | None, str | None]:
    """Date and voucher columns: the mapped ones, else the first whose name holds a word, words in their order."""

    def first(words: list[str]) -> str | None:
        names = [c for c in raw.columns if not c.startswith("__")]
        return next((c for w in words for c in names if w in c.lower().strip()), None)

    return mapping.date or first(DATE_WORDS), mapping.voucher or first(VOUCHER_WORDS)


def skip_title_rows(raw: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Drops leading rows among the first five that are nearly empty (journals with date and voucher columns)."""
    if not all(found_columns(raw, mapping)):
        return raw
    names = [c for c in raw.columns if not c.startswith("__")]
    filled = sum((F.when(_cell(n) != "", 1).otherwise(0) for n in names), F.lit(0))
    title = (filled <= 2) & (filled / max(1, len(names)) < 0.3)
    first = raw.where(F.col("__source_row__") <= 5).where(~title).agg(F.min("__source_row__").alias("__from"))
    return raw.join(F.broadcast(first), F.col("__source_row__") >= F.coalesce("__from", F.lit(6))).drop("__from")


def filled_dates(raw: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Adds __date: the raw date cell, or for a continuation row with content the last one above.

    The last date is looked up in blocks of rows: within the block, and from the blocks
    before by the much smaller table of each block's last date.
    """
    content = F.lit(False)
    for name in (mapping.summary, mapping.voucher, mapping.debit, mapping.credit, mapping.amount, mapping.direction, mapping.balance):
        if name:
            content = content | (_cell(name) != "")
    own = F.when(_cell(mapping.date) != "", _cell(mapping.date))
    rows = raw.withColumn("__own", own).withColumn("__block", F.floor(F.col("__source_row__") / 100_000))
    last = rows.where("__own is not null").groupBy("__block").agg(F.max_by("__own", "__source_row__").alias("__last"))
    blocks = rows.select("__block").distinct().join(last, "__block", "left")
    before = blocks.withColumn("__before", F.last("__last", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(F.broadcast(before.drop("__last")), "__block")
    within = F.last("__own", ignorenulls=True).over(Window.partitionBy("__block").orderBy("__source_row__").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__above", F.coalesce(within, "__before"))
    return rows.withColumn("__date", F.when(F.col("__own").isNotNull(), F.col("__own")).when(content, F.col("__above"))).drop("__own", "__block", "__before", "__above")


def amount_columns(mapping: ColumnMapping, source: str) -> tuple[Column, Column]:
    """(yuan, error kind) of a row by the mapping's mode."""
    if mapping.mode == "debit_credit":
        debit, credit = (F.when(_cell(n) == "", F.lit(0)).otherwise(money.clean_amount(_cell(n))) for n in (mapping.debit, mapping.credit))
        amount = credit - debit if source == "bank" else debit - credit
        return amount.cast("decimal(20,2)"), F.when(amount.isNull(), BAD_AMOUNT)
    cell = _cell(mapping.amount)
    if mapping.mode == "single_amount_with_direction":
        if not mapping.direction:
            raise ValueError("a direction column is needed")
        number = F.when(cell != "", money.clean_amount(cell))
        sign = money.direction_sign(_cell(mapping.direction), source)
        return (F.abs(number) * sign).cast("decimal(20,2)"), F.when(number.isNull(), BAD_AMOUNT).when(sign.isNull(), BAD_DIRECTION)
    number = F.when(cell != "", money.source_amount(cell, source))
    return number, F.when(number.isNull(), BAD_AMOUNT)


def standardize(raw: DataFrame, mapping: ColumnMapping, source: str, gate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ledger, parse_errors) of a raw table.

    The ledger's rec_id is each row's place by date, amount and source row.  parse_errors has
    kind, row, value, source.  With gate, more than half unreadable amounts among dated rows
    fail at once.
    """
    if source not in ("bank", "journal"):
        raise ValueError(f"unknown source: {source}")
    if missing := mapping.missing():
        raise ValueError(f"columns not mapped: {', '.join(missing)}")
    checkpoints(raw.sparkSession)
    rows = skip_title_rows(raw, mapping) if source == "journal" else raw
    voucher, summary = _cell(mapping.voucher), _cell(mapping.summary)
    if source == "journal":
        day, number = found_columns(raw, mapping)
        keyword = F.lower(_cell(day)).rlike("|".join(SUMMARY_KEYWORDS))
        rows = rows.where(~((_cell(number) == "") & (_cell(day) != "") & keyword))
    label = summary.isin(SUMMARY_LABELS) & (voucher == "")
    rows = rows.withColumn("__label", label)
    rows = filled_dates(rows.where(~F.col("__label")), mapping).unionByName(rows.where("__label").withColumn("__date", F.lit(None).cast("string")))
    amount, wrong = amount_columns(mapping, source)
    rows = rows.withColumn("__day", dates.parse_date(F.col("__date"))).withColumn("__amount", amount).withColumn("__wrong", wrong)
    rows = rows.checkpoint()  # parsed once, for the gate, the ledger and the errors
    kind = (
        F.when(F.col("__label"), DROPPED_SUMMARY)
        .when(F.coalesce("__date", F.lit("")) == "", BLANK_DATE)
        .when(F.col("__day").isNull(), BAD_DATE)
        .otherwise(F.col("__wrong"))
    )
    value = F.when(F.col("__label"), summary).when(F.col("__day").isNull(), F.col("__date")).otherwise(_cell(mapping.amount or mapping.debit))
    rows = rows.withColumn("__kind", kind)
    errors = rows.where("__kind is not null").select(F.col("__kind").alias("kind"), F.col("__source_row__").alias("row"), value.alias("value"), F.lit(source).alias("source"))
    if gate:
        seen = rows.where("__day is not null and not __label").agg(F.count("*").alias("n"), F.count_if(F.col("__kind").isNotNull()).alias("bad")).first()
        if seen["n"] and 2 * seen["bad"] > seen["n"]:
            raise TooManyBadAmounts(f"{seen['bad']} of {seen['n']} amounts cannot be read")
    balance = F.when(_cell(mapping.balance) != "", money.clean_amount(_cell(mapping.balance)))
    labels = [n for n in (mapping.summary, *mapping.auxiliary) if n]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), _cell(n).alias("value")) for n in dict.fromkeys(labels)]) if labels else None
    aux = F.map_from_entries(F.filter(pairs, lambda x: x["value"] != "")) if labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ledger = rows.where("__kind is null").select(
        F.col("__day").alias("date"), F.col("__amount").alias("amount"),
        (F.col("__amount") * 10_000).cast("bigint").alias("amount_li"), text.clean_excel_string(summary).alias("summary"),
        balance.alias("balance"), (balance * 10_000).cast("bigint").alias("balance_li"), voucher.alias("voucher_no"), aux.alias("aux"),
        F.lit(source).alias("source"), F.col("__source_row__").alias("original_idx"), F.col("__file_row__").alias("original_file_row"),
    )
    return ranked(ledger, ["date", "amount_li", "original_idx"], "rec_id").select("rec_id", *ledger.columns), errors


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("source", "kind").agg(F.count("*").alias("n"))

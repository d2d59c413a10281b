"""Daily and monthly statistics, running balances, and checks of stated balances.

A statement has one row per transaction, but far fewer days; windows over all days run on
the per-day aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.functions.scoring import expense, income

# --- fixed values: words of rows that state an opening balance --------------------------
OPENING_WORDS = ["上期结转", "期初余额", "年初余额", "月初余额", "期初", "结转"]
# ----------------------------------------------------------------------------------------


def daily(side: DataFrame, prefix: str = "") -> DataFrame:
    """Per day: rows, income and its rows, expense and its rows, net, and the last stated balance."""
    li = F.col("amount_li")
    out = side.groupBy("date").agg(
        F.count("*").alias(f"{prefix}rows"), F.count_if(li > 0).alias(f"{prefix}income_n"), F.sum(income(li)).alias(f"{prefix}income_li"),
        F.count_if(li < 0).alias(f"{prefix}expense_n"), F.sum(expense(li)).alias(f"{prefix}expense_li"), F.sum(li).alias(f"{prefix}net_li"),
        F.max_by("balance_li", F.when(F.col("balance_li").isNotNull(), F.col("original_idx"))).alias(f"{prefix}balance_li"),
    )
    return out


def calendar(stats: DataFrame) -> DataFrame:
    """All days from the first to the last."""
    ends = stats.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("date"))


def _filled(column: str, order: str = "date") -> Column:
    return F.last(column, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def daily_table(bank: DataFrame, journal: DataFrame) -> DataFrame:
    """Each calendar day's figures of both sides, zero where there are none, balances carried forward."""
    both = daily(bank, "bank_").join(daily(journal, "journal_"), "date", "full_outer")
    out = calendar(both).join(both, "date", "left")
    for c in out.columns:
        if c.endswith("balance_li"):
            out = out.withColumn(c, _filled(c))
        elif c != "date":
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def monthly_table(days: DataFrame) -> DataFrame:
    """daily_table rolled up by month: sums, and each month's last balances."""
    sums = [c for c in days.columns if c != "date" and not c.endswith("balance_li")]
    last = [c for c in days.columns if c.endswith("balance_li")]
    return days.groupBy(dates.month_key(F.col("date")).alias("month")).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in last]
    )


def stated_opening(raw: DataFrame, date: str, summary: str, balance: str) -> DataFrame:
    """One row (stated): the balance of a raw table's first undated row whose summary says that it is the opening one, in li; null if there is none."""
    cell = lambda name: text.cell_text(F.col(f"`{name}`"))
    amount = F.when(cell(balance) != "", money.clean_amount(cell(balance), suffix_sign=False))
    rows = raw.where(dates.parse_date(cell(date)).isNull() & cell(summary).rlike("|".join(OPENING_WORDS)) & amount.isNotNull())
    return rows.agg(F.min_by((amount * 10_000).cast("bigint"), F.col("__source_row__")).alias("stated"))


def opening_balance(side: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """One row (opening_li): a stated opening balance, else the first balance less all movements up to its row; null without any balance.

    stated: one row (stated), see `stated_opening`; a ledger itself has no undated rows.
    """
    if stated is None:
        stated = side.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("stated"))
    rows = side.where("date is not null")
    # only days up to the first balance matter: the running sum is over days, then within that day
    first = rows.where("balance_li is not null").agg(F.min(F.struct("date", "original_idx", "balance_li")).alias("f")).select("f.*")
    before = rows.join(
        F.broadcast(first.select(F.col("date").alias("__d"), F.col("original_idx").alias("__i"))),
        F.struct("date", "original_idx") <= F.struct(F.col("__d").alias("date"), F.col("__i").alias("original_idx")),
    )
    moved = before.agg(F.sum("amount_li").alias("moved"))
    derived = first.crossJoin(moved).agg(F.max(F.col("balance_li") - F.coalesce("moved", F.lit(0))).alias("derived"))  # one row by one row
    return stated.crossJoin(derived).select(F.coalesce("stated", "derived").alias("opening_li"))


def running(side: DataFrame, opening_li: int = 0) -> DataFrame:
    """Per calendar day: net and the recalculated balance before and after."""
    days = daily(side).select("date", "net_li")
    out = calendar(days).join(days, "date", "left").withColumn("net_li", F.coalesce("net_li", F.lit(0)))
    total = F.sum("net_li").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("balance_li", F.lit(opening_li) + total)
    return out.withColumn("previous_li", F.col("balance_li") - F.col("net_li"))


def continuity(side: DataFrame) -> DataFrame:
    """Days whose stated balance isn't the last stated one plus the movements since."""
    days = daily(side).select("date", "net_li", F.col("balance_li").alias("stated_li"))
    by = Window.orderBy("date")
    days = days.withColumn("moved", F.sum("net_li").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = days.where("stated_li is not null").withColumn("base", F.col("stated_li") - F.col("moved"))
    rows = rows.withColumn("expected_li", F.lag("base").over(by) + F.col("moved"))
    return rows.where("expected_li is not null and expected_li <> stated_li").select(
        "date", "expected_li", "stated_li", (F.col("stated_li") - F.col("expected_li")).alias("off_li")
    )


def balance_diff(bank: DataFrame, journal: DataFrame, bank_opening: int = 0, journal_opening: int = 0) -> DataFrame:
    """Recalculated balances of both sides day by day, and what kind of difference there is."""
    b = running(bank, bank_opening).select("date", F.col("net_li").alias("bank_net_li"), F.col("balance_li").alias("bank_li"))
    j = running(journal, journal_opening).select("date", F.col("net_li").alias("journal_net_li"), F.col("balance_li").alias("journal_li"))
    out = b.join(j, "date", "full_outer").withColumn("diff_li", F.coalesce("bank_li", F.lit(0)) - F.coalesce("journal_li", F.lit(0)))
    kind = F.when(F.col("bank_li").isNull() | F.col("journal_li").isNull(), "缺失记录").when(F.col("bank_net_li") == F.col("journal_net_li"), "时间序错误").otherwise("金额错误")
    return out.withColumn("kind", kind).withColumn("is_diff", F.col("diff_li") != 0)


def side_totals(side: DataFrame, name: str) -> DataFrame:
    li = F.col("amount_li")
    return side.agg(
        F.lit(name).alias("side"), F.count("*").alias("n"), F.sum(li).alias("net_li"), F.count_if(li > 0).alias("income_n"),
        F.sum(income(li)).alias("income_li"), F.count_if(li < 0).alias("expense_n"), F.sum(expense(li)).alias("expense_li"),
    )

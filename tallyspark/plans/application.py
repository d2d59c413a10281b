"""From two statement files to report tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig
from tallyspark.operators import balances, precheck, selection
from tallyspark.operators.standardize import ColumnMapping, standardize
from tallyspark.plans import reports
from tallyspark.plans.reconcile import Reconciliation, reconcile
from tallyspark.sources import files, headers


@dataclass
class Input:
    """A side's file and the user's own choices for it; what is None is found out."""

    path: str
    mapping: ColumnMapping | None = None
    skiprows: int | None = None
    header_rows: int | None = None


def opened(spark: SparkSession, given: Input) -> dict:
    """A side's raw rows, its header and its mapping."""
    rows = files.preview(given.path)
    structure = headers.adopted(files.structure_of(given.path), rows, given.skiprows, given.header_rows)
    mapping = given.mapping or headers.auto_mapping(list(structure.columns))
    return {"path": given.path, "structure": structure, "mapping": mapping, "raw": files.load(spark, given.path, structure)}


def run(
    spark: SparkSession, bank: Input, journal: Input, config: ReconConfig | None = None, scorer: Callable | None = None, warned: Callable[[DataFrame], bool] | None = None
) -> dict[str, DataFrame]:
    """All report tables.  A blocking check raises precheck.Blocked; with warnings, warned(items) may return False to stop."""
    config = (config or ReconConfig()).checked()
    selection.checkpoints(spark)
    sides = {"bank": opened(spark, bank), "journal": opened(spark, journal)}
    precheck.require(precheck.mapping_item(spark, sides))  # without its columns a table cannot be standardised
    for name, side in sides.items():
        ledger, side["errors"] = standardize(side["raw"], side["mapping"], name)
        side["ledger"] = ledger.checkpoint()
    items = precheck.require(precheck.checks(spark, sides))
    if warned is not None and items.where(F.col("status") == precheck.WARN).count() and not warned(items):
        raise precheck.Blocked("stopped at a warning")
    done = reconcile(sides["bank"]["ledger"], sides["journal"]["ledger"], config, scorer)
    return tables(spark, done, sides, items, config)


def tables(spark: SparkSession, done: Reconciliation, sides: dict[str, dict], items: DataFrame, config: ReconConfig) -> dict[str, DataFrame]:
    b, j = sides["bank"]["ledger"], sides["journal"]["ledger"]
    days = balances.daily_table(b, j)
    openings = {}
    for name, s in sides.items():
        m = s["mapping"]
        stated = balances.stated_opening(s["raw"], m.date, m.summary, m.balance) if m.summary and m.balance else None
        openings[name] = balances.opening_balance(s["ledger"], stated).first()["opening_li"]
    opening = opening_check(spark, openings)
    out = {
        "核对汇总": reports.kpis(done).unionByName(opening_kpis(opening)), "输入预检查": items, "每日统计": days, "月度统计": balances.monthly_table(days),
        "匹配明细": reports.group_table(done), "匹配组成明细": reports.member_table(done), "明显微小错报": reports.trivial_table(done),
        "待人工复核": reports.review_table(done), "银行未达": reports.unmatched_raw(sides["bank"]["raw"], done.bank), "日记账未达": reports.unmatched_raw(sides["journal"]["raw"], done.journal),
        "运行参数": parameters(spark, config), "余额差异明细": balances.balance_diff(b, j, openings["bank"] or 0, openings["journal"] or 0),
        "余额连续性异常": balances.continuity(b).withColumn("side", F.lit("bank")).unionByName(balances.continuity(j).withColumn("side", F.lit("journal"))),
        "解析异常明细": sides["bank"]["errors"].unionByName(sides["journal"]["errors"]), "期初余额": opening,
    }
    if done.decisions is not None:
        out["大模型辅助明细"] = reports.scorer_table(done)
    return reports.ordered(out)


def opening_kpis(opening: DataFrame) -> DataFrame:
    """The summary's rows on opening balances, in yuan; none if a side has no balance."""
    known = opening.where("bank_li is not null and journal_li is not null")
    yuan = lambda c: (c / 10_000).cast("double")
    pairs = {"银行期初余额": F.col("bank_li"), "日记账期初余额": F.col("journal_li"), "期初余额差额": F.col("bank_li") - F.col("journal_li")}
    rows = F.array(
        *[F.struct(F.lit(k).alias("item"), yuan(v).alias("value")) for k, v in pairs.items()], F.struct(F.lit("期初余额状态").alias("item"), F.when(F.col("warning"), 1.0).otherwise(0.0).alias("value"))
    )
    return known.select(F.explode(rows).alias("x")).select("x.*")


def parameters(spark: SparkSession, config: ReconConfig) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(config).items()], "item string, value string")


def opening_check(spark: SparkSession, opened: dict[str, int | None]) -> DataFrame:
    """Both sides' opening balances, and whether they differ by more than 0.01 yuan."""
    a, b = opened["bank"], opened["journal"]
    warn = a is not None and b is not None and abs(a - b) > 100
    return spark.createDataFrame([(a, b, warn)], "bank_li long, journal_li long, warning boolean")

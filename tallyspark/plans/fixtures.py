"""Two ledgers derived from the driver's orders and customer tables, and their DuckDB SQL.

bank: every order whose key doesn't end in 9.  journal, by the key's last digit: 0-3 and 9
the same row; 8 twice; 4 some days later; 5 with 1 to 40 yuan more; 6 in two rows; 7 none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).cast("bigint").alias("sgn"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("summary"), F.col("c_name").alias("counterparty"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, d, cents, segment, priority) of all orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return rows.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
    )


def _ledger(rows: DataFrame, source: str, balance: bool = True) -> DataFrame:
    """rows (src_row, date, amount_li, summary, counterparty) as a standardised ledger."""
    stated = F.when(F.col("src_row") % 50 == 0, F.col("src_row") * 1000).cast("bigint") if balance else F.lit(None).cast("bigint")
    return rows.select(
        F.col("src_row").alias("rec_id"), "date", "amount_li", "summary", stated.alias("balance_li"), F.lit("").alias("voucher_no"),
        F.create_map(F.lit("摘要"), F.col("summary"), F.lit("对方户名"), F.col("counterparty")).alias("aux"),
        F.lit(source).alias("source"), F.col("src_row").alias("original_idx"), (F.col("src_row") + 1).alias("original_file_row"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).where("k % 10 <> 9")
    return _ledger(rows.select((F.col("k") * 10).alias("src_row"), F.col("d").alias("date"), (F.col("sgn") * F.col("cents") * 100).alias("amount_li"), "summary", "counterparty"), "bank")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.col("k") % 10
    tens = F.floor(F.col("k") / 10.0)
    third = F.floor(F.col("cents") / 3.0).cast("bigint")
    part = lambda row, cents, days=F.lit(0): F.struct(
        (F.col("k") * 10 + row).alias("src_row"), F.date_add("d", days.cast("int")).alias("date"), (F.col("sgn") * cents * 100).alias("amount_li")
    )
    cents = F.col("cents")
    parts = (
        F.when(digit == 7, F.array().cast("array<struct<src_row:bigint,date:date,amount_li:bigint>>"))
        .when(digit == 8, F.array(part(0, cents), part(1, cents)))
        .when(digit == 4, F.array(part(0, cents, 1 + tens % 5)))
        .when(digit == 5, F.array(part(0, cents + (100 * (1 + tens % 40)).cast("bigint"))))
        .when(digit == 6, F.array(part(0, third), part(1, cents - third)))
        .otherwise(F.array(part(0, cents)))
    )
    rows = _base(spark, sf_dir).select(F.explode(parts).alias("x"), "summary", "counterparty").select("x.*", "summary", "counterparty")
    return _ledger(rows, "journal")


def _split(rows: DataFrame, cents: Column, several: Column) -> DataFrame:
    """(src_row, date, amount_li, ...) journal rows of base rows with date: one each, or two that sum to it."""
    third = F.floor(cents / 3.0).cast("bigint")
    row = lambda n, part: F.struct((F.col("k") * 10 + n).alias("src_row"), (F.col("sgn") * part * 100).alias("amount_li"))
    parts = F.when(several, F.array(row(0, third), row(1, cents - third))).otherwise(F.array(row(0, cents)))
    return rows.select(F.explode(parts).alias("x"), "date", "summary", "counterparty").select("x.*", "date", "summary", "counterparty")


def _whole(rows: DataFrame, cents: Column) -> DataFrame:
    return rows.select((F.col("k") * 10).alias("src_row"), "date", (F.col("sgn") * cents * 100).alias("amount_li"), "summary", "counterparty")


def balanced(spark: SparkSession, sf_dir: str, turn: bool = False) -> tuple[DataFrame, DataFrame]:
    """All orders on both sides, every third as two journal rows, so that days and months agree, but for the 5th of March, June, September and December.

    turn: the bank's rows in the last five days of their months, the journal's in the first five of the next.
    """
    rows, day = _base(spark, sf_dir), F.dayofmonth("d")
    off = F.when((F.month("d") % 3 == 0) & (day == 5), 100).otherwise(0)
    b = rows.withColumn("date", F.date_sub(F.last_day("d"), day % 5) if turn else F.col("d"))
    j = rows.withColumn("date", F.date_add(F.last_day("d"), 1 + day % 5) if turn else F.col("d"))
    return _ledger(_whole(b, F.col("cents")), "bank"), _ledger(_split(j, F.col("cents") + off, F.col("k") % 3 == 0), "journal")


def large_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders on both sides; those of a key that ends in 006 or 506 are ten million yuan larger, and two rows in the journal."""
    large = F.col("k") % 500 == 6
    rows = _base(spark, sf_dir).withColumn("date", F.col("d"))
    cents = F.col("cents") + F.when(large, 1_000_000_000).otherwise(0)
    return _ledger(_whole(rows, cents), "bank"), _ledger(_split(rows, cents, large), "journal")


def payroll(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bank: equal salary rows by day; journal: their sum some days later, every fourth one wrong."""
    rows = _base(spark, sf_dir).select("k", (F.col("k") % 40).alias("g"))
    day = F.date_add(F.lit("2024-01-05").cast("date"), F.col("g").cast("int"))
    b = rows.select(F.col("k").alias("src_row"), day.alias("date"), (-(5000 + F.col("g") * 10) * 10_000).cast("bigint").alias("amount_li"), F.lit("代发工资").alias("summary"), F.lit("员工").alias("counterparty"))
    sums = rows.groupBy("g").agg(F.count("*").alias("n"))
    j = sums.select(
        F.col("g").cast("bigint").alias("src_row"), F.date_add(day, (F.col("g") % 5).cast("int")).alias("date"),
        (-(F.col("n") * (5000 + F.col("g") * 10) + F.when(F.col("g") % 4 == 3, 1).otherwise(0)) * 10_000).cast("bigint").alias("amount_li"),
        F.lit("工资发放").alias("summary"), F.lit("员工").alias("counterparty"),
    )
    return _ledger(b, "bank"), _ledger(j, "journal")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bank: four consecutive rows of one summary at a time; journal: their sum, but for every third."""
    rows = _base(spark, sf_dir).select("k", F.floor(F.col("k") / 4.0).cast("bigint").alias("g"), "cents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("g") % 300).cast("int"))
    note = F.concat(F.lit("项目"), (F.col("g") % 997).cast("string"))
    b = rows.select(F.col("k").alias("src_row"), day.alias("date"), (F.col("cents") * 100).alias("amount_li"), note.alias("summary"), F.lit("甲").alias("counterparty"))
    sums = rows.groupBy("g").agg(F.sum("cents").alias("cents")).where("g % 3 <> 0")
    j = sums.select(F.col("g").alias("src_row"), day.alias("date"), (F.col("cents") * 100).alias("amount_li"), note.alias("summary"), F.lit("甲").alias("counterparty"))
    return _ledger(b, "bank"), _ledger(j, "journal")


def fees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two ledgers with rule words in their summaries."""
    words = F.array(*[F.lit(x) for x in ("账户管理费", "利息收入", "代发工资", "增值税", "回款", "货款手续费", "其他")])
    out = []
    for side in (bank(spark, sf_dir), journal(spark, sf_dir)):
        note = F.get(words, (F.floor(F.col("rec_id") / 10.0) % 7).cast("int"))
        out.append(side.withColumn("summary", note).withColumn("aux", F.create_map(F.lit("摘要"), note)))
    return out[0], out[1]


SQL = """
base AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS BIGINT) AS sgn,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_mktsegment || ' ' || o_orderpriority AS summary, c_name AS counterparty
  FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS (
  SELECT k * 10 AS rec_id, d AS date, sgn * cents * 100 AS amount_li, summary, counterparty,
         CASE WHEN (k * 10) % 50 = 0 THEN k * 10 * 1000 END AS balance_li, k * 10 AS original_idx
  FROM base WHERE k % 10 <> 9),
jraw AS (
  SELECT k * 10 AS rec_id, d AS date, sgn * cents * 100 AS amount_li, summary, counterparty FROM base WHERE k % 10 IN (0, 1, 2, 3, 8, 9)
  UNION ALL SELECT k * 10 + 1, d, sgn * cents * 100, summary, counterparty FROM base WHERE k % 10 = 8
  UNION ALL SELECT k * 10, d + CAST(1 + floor(k / 10.0) % 5 AS INT), sgn * cents * 100, summary, counterparty FROM base WHERE k % 10 = 4
  UNION ALL SELECT k * 10, d, sgn * (cents + CAST(100 * (1 + floor(k / 10.0) % 40) AS BIGINT)) * 100, summary, counterparty FROM base WHERE k % 10 = 5
  UNION ALL SELECT k * 10, d, sgn * CAST(floor(cents / 3.0) AS BIGINT) * 100, summary, counterparty FROM base WHERE k % 10 = 6
  UNION ALL SELECT k * 10 + 1, d, sgn * (cents - CAST(floor(cents / 3.0) AS BIGINT)) * 100, summary, counterparty FROM base WHERE k % 10 = 6),
journal AS (
  SELECT *, CASE WHEN rec_id % 50 = 0 THEN rec_id * 1000 END AS balance_li, rec_id AS original_idx FROM jraw)
"""

BALANCED_SQL = """
base AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS BIGINT) AS sgn,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey),
moved AS (
  SELECT k, sgn, cents, cents + CASE WHEN month(d) % 3 = 0 AND day(d) = 5 THEN 100 ELSE 0 END AS other, d, last_day(d) - CAST(day(d) % 5 AS INT) AS late, last_day(d) + CAST(1 + day(d) % 5 AS INT) AS early FROM base),
halves AS (
  SELECT k * 10 AS rec_id, d, early, sgn * (CASE WHEN k % 3 = 0 THEN CAST(floor(other / 3.0) AS BIGINT) ELSE other END) * 100 AS amount_li FROM moved
  UNION ALL SELECT k * 10 + 1, d, early, sgn * (other - CAST(floor(other / 3.0) AS BIGINT)) * 100 FROM moved WHERE k % 3 = 0)
"""

PAYROLL_SQL = """
pay AS (SELECT o_orderkey AS k, o_orderkey % 40 AS g FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS (SELECT k AS rec_id, DATE '2024-01-05' + CAST(g AS INT) AS date, CAST(-(5000 + g * 10) * 10000 AS BIGINT) AS amount_li FROM pay),
journal AS (
  SELECT g AS rec_id, DATE '2024-01-05' + CAST(g + g % 5 AS INT) AS date,
         CAST(-(count(*) * (5000 + g * 10) + CASE WHEN g % 4 = 3 THEN 1 ELSE 0 END) * 10000 AS BIGINT) AS amount_li
  FROM pay GROUP BY g)
"""

RUNS_SQL = """
run AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 4.0) AS BIGINT) AS g, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS (SELECT k AS rec_id, k AS original_idx, DATE '2024-01-01' + CAST(g % 300 AS INT) AS date, cents * 100 AS amount_li, '项目' || CAST(g % 997 AS VARCHAR) AS summary FROM run),
journal AS (
  SELECT g AS rec_id, g AS original_idx, DATE '2024-01-01' + CAST(g % 300 AS INT) AS date, CAST(sum(cents) * 100 AS BIGINT) AS amount_li, '项目' || CAST(g % 997 AS VARCHAR) AS summary
  FROM run WHERE g % 3 <> 0 GROUP BY g)
"""

FEE_WORDS_SQL = "list_value('账户管理费', '利息收入', '代发工资', '增值税', '回款', '货款手续费', '其他')[1 + CAST(floor(rec_id / 10.0) % 7 AS INT)]"

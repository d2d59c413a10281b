"""Names of the ledger queries, their plans and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig
from tallyspark.functions import dates, money, scoring, text
from tallyspark.operators import balances, nearest, pools, precheck, selection, standardize, subset_sum
from tallyspark.operators import candidates as c
from tallyspark.plans import fixtures, reconcile, reports

CONFIG = ReconConfig()

#: Cells with known answers, for tests of the functions alone.
AMOUNT_TEXTS = [
    "1,234.56", "12,34.5", "(100)", "100CR", "100 DR", "￥１，２３４．５０", "CNY 88.005", "", "nan", "abc", "-5", "1e3", "5贷", "7借", "（8.5）",
    "USD 1,000,000.10", "0.005", "-0.005", " 42 ",
]
AMOUNT_VALUES = [
    "1234.56", None, "-100.00", "-100.00", "100.00", "1234.50", "88.01", "0.00", "0.00", None, "-5.00", "1000.00", "-5.00", "7.00", None,
    "1000000.10", "0.01", "-0.01", "42.00",
]
DATE_TEXTS = ["2024-01-05", "2024/1/5", "20240105", "05-01-2024", "05/01/2024", "2024.1.5", "5.1.2024", "2024年1月5日", "45296", "2024", "13/25/2024", "12/25/2024", "x", ""]
DATE_VALUES = ["2024-01-05"] * 8 + ["2024-01-05", "1905-07-16", None, "2024-12-25", None, None]
SUMMARY_TEXTS = ["收到 ＡＢＣ公司 货款12345678", "转账  项目 一", "nan", "有限责任公司甲", "网银 手续费 2024", ""]
SUMMARY_VALUES = ["abc 货款", "项目 一", "", "有限责任甲", "手续费 2024", ""]


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.bank(spark, sf_dir), fixtures.journal(spark, sf_dir)


def _by_key(key, forms: list):
    """The form of a key: one after another."""
    return F.get(F.array(*forms), (key % len(forms)).cast("int"))


def standardize_amounts(spark, sf_dir):
    """Every order's price as an amount cell in one of twelve forms, three of them unreadable or empty, read back."""
    rows = fixtures.orders(spark, sf_dir)
    plain, commas = F.format_string("%d.%02d", F.floor(F.col("cents") / 100).cast("long"), F.col("cents") % 100), F.format_number(F.col("cents") / 100.0, 2)
    wide = F.translate(commas, money.HALF_WIDTH, money.FULL_WIDTH)
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        plain, commas, put("(", plain, ")"), put(plain, "CR"), put(plain, " DR"), put("￥", wide), put("USD ", commas), put(plain, "贷"), put("(", plain), put("1(", plain),
        F.lit(""), put("(", plain, "CR)"),
    ]
    return rows.select("k", money.clean_amount(_by_key(F.col("k"), forms)).cast("string").alias("amount"))


def standardize_dates(spark, sf_dir):
    """Every order's date as a cell in one of eleven forms, one of them unreadable, read back."""
    rows = fixtures.orders(spark, sf_dir)
    shapes = ["yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd", "dd-MM-yyyy", "d/M/yyyy", "yyyy.M.d", "d.M.yyyy", "yyyy年M月d日"]
    serial = F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string")
    forms = [F.date_format("d", x) for x in shapes] + [serial, F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 13:05:00")), F.lit("x")]
    return rows.select("k", dates.parse_date(_by_key(F.col("k"), forms)).cast("string").alias("date"))


def normalize_text(spark, sf_dir):
    """Every order's segment and priority as a summary with noise words, wide letters and serial numbers, normalised."""
    rows = fixtures.orders(spark, sf_dir)
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    segment, priority = F.col("segment"), F.col("priority")
    forms = [
        put("收到 ", segment), put(segment, "有限公司"), F.translate(segment, text.HALF_WIDTH, text.FULL_WIDTH), put(segment, " 123456789 ", priority), F.lit("nan"),
        put("  ", segment, "   转账   x"),
    ]
    return rows.select("k", text.normalize_summary(_by_key(F.col("k"), forms)).alias("norm"))


def amount_li(spark, sf_dir):
    li = fixtures.bank(spark, sf_dir).select("rec_id", "amount_li", money.from_li(F.col("amount_li")).alias("yuan"))
    return li.select("rec_id", money.to_li(F.col("yuan")).alias("amount_li"), F.col("yuan").cast("double").alias("yuan"))


def standardized_ledger(spark, sf_dir):
    """The ledger written out as raw text cells and standardised again."""
    raw = fixtures.bank(spark, sf_dir).select(
        F.col("original_idx").alias("__source_row__"), F.col("original_file_row").alias("__file_row__"),
        F.date_format("date", "yyyy/M/d").alias("日期"), F.format_number(F.abs("amount_li") / 10000.0, 2).alias("金额"),
        F.when(F.col("amount_li") < 0, "借").otherwise("贷").alias("方向"), F.col("summary").alias("摘要"),
    )
    mapping = standardize.ColumnMapping(date="日期", amount="金额", direction="方向", summary="摘要", mode="single_amount_with_direction")
    ledger, _ = standardize.standardize(raw, mapping, "bank", gate=False)
    return ledger.select("original_idx", "date", "amount_li", "summary")


def parse_error_counts(spark, sf_dir):
    """Rejected rows by kind, of a raw table with unreadable dates, amounts and directions."""
    k = F.col("original_idx") / 10
    raw = fixtures.bank(spark, sf_dir).select(
        F.col("original_idx").alias("__source_row__"), F.col("original_file_row").alias("__file_row__"),
        F.when(k % 11 == 0, "x").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("日期"), F.when(k % 7 == 0, "abc").otherwise("1.00").alias("金额"),
        F.when(k % 13 == 0, "?").otherwise("贷").alias("方向"), F.when(k % 17 == 0, "合计").otherwise(F.col("summary")).alias("摘要"),
    )
    mapping = standardize.ColumnMapping(date="日期", amount="金额", direction="方向", summary="摘要", mode="single_amount_with_direction")
    return standardize.error_counts(standardize.standardize(raw, mapping, "bank", gate=False)[1])


def masked_texts(spark, sf_dir):
    """Texts with account numbers, tokens, addresses and formulas of every order's key, masked in three ways."""
    rows = fixtures.orders(spark, sf_dir)
    key = F.col("k").cast("string")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [put("Bearer a", key, ".X-1"), put("k=v&token=t", key, "&a=1"), put("acct ", F.lpad(key, 12, "7"), " ok"), put("https://u:p@host:8443/a/", key, "?key=1#f"), put("=SUM(A", key, ")"), put("plain ", key)]
    raw = _by_key(F.col("k"), forms)
    return rows.select("k", text.redact_sensitive(raw).alias("masked"), text.sanitize_url(raw).alias("url"), text.clean_excel_string(raw).alias("cell"))


def _with_totals(raw: DataFrame, date: str) -> DataFrame:
    """raw with a row of a month's total, which is no transaction, after every hundredth one."""
    total = raw.where("__source_row__ % 1000 = 0").withColumn("__source_row__", F.col("__source_row__") + 5).withColumn(date, F.lit("本月合计")).withColumn("凭证号", F.lit(None).cast("string"))
    return raw.unionByName(total)


def input_checks(spark, sf_dir):
    """The eight checks of both ledgers as raw tables."""
    sides = {}
    for name, rows in zip(("bank", "journal"), _two(spark, sf_dir), strict=True):
        raw = rows.select(
            F.col("original_idx").alias("__source_row__"), F.col("original_file_row").alias("__file_row__"), F.date_format("date", "yyyy-MM-dd").alias("日期"),
            F.format_number(F.abs("amount_li") / 10000.0, 2).alias("金额"), F.when((F.col("amount_li") < 0) == F.lit(name == "bank"), "借").otherwise("贷").alias("方向"),
            F.col("summary").alias("摘要"), F.lit("1").alias("凭证号"),
        )
        raw = _with_totals(raw, "日期") if name == "journal" else raw
        mapping = standardize.ColumnMapping(date="日期", amount="金额", direction="方向", summary="摘要", voucher="凭证号", mode="single_amount_with_direction", auxiliary=("摘要",))
        ledger, errors = standardize.standardize(raw, mapping, name)
        sides[name] = {"path": sf_dir, "mapping": mapping, "raw": raw, "ledger": ledger, "errors": errors}
    return precheck.checks(spark, sides).select("item", "status")


def standardized_columns(spark, sf_dir):
    """The journal written out with debit and credit columns and totals in between, and standardised again, numbered by date and amount."""
    li = F.col("amount_li")
    raw = _with_totals(fixtures.journal(spark, sf_dir).select(
        F.col("original_idx").alias("__source_row__"), F.col("original_file_row").alias("__file_row__"), F.date_format("date", "yyyyMMdd").alias("记账日期"),
        F.when(li > 0, F.format_number(li / 10000.0, 2)).alias("借方"), F.when(li <= 0, F.format_number(-li / 10000.0, 2)).alias("贷方"), F.col("summary").alias("摘要"), F.lit("1").alias("凭证号"),
    ), "记账日期")
    mapping = standardize.ColumnMapping(date="记账日期", debit="借方", credit="贷方", summary="摘要", voucher="凭证号", mode="debit_credit")
    return standardize.standardize(raw, mapping, "journal")[0].select("rec_id", "original_idx", "date", "amount_li")


def standardized_signed(spark, sf_dir):
    """The journal written out with signed amounts, every other one by its suffix, with undated rows that go on from the row above, and standardised again."""
    li, again = F.col("amount_li"), F.col("original_idx") % 10 == 1
    plain = F.format_number(F.abs(li) / 10000.0, 2)
    signed = F.when(li < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain)
    suffix = F.concat(plain, F.when(li < 0, F.lit("贷")).otherwise(F.lit("DR")))
    raw = fixtures.journal(spark, sf_dir).select(
        F.col("original_idx").alias("__source_row__"), F.col("original_file_row").alias("__file_row__"), F.when(~again, F.date_format("date", "yyyy.M.d")).alias("日期"),
        F.when(F.floor(F.col("original_idx") / 10.0) % 2 == 0, signed).otherwise(suffix).alias("金额"), F.col("summary").alias("摘要"),
    )
    mapping = standardize.ColumnMapping(date="日期", amount="金额", summary="摘要")
    return standardize.standardize(raw, mapping, "journal")[0].select("rec_id", "original_idx", "date", "amount_li")


def ledger_labels(spark, sf_dir):
    """Month key and number, category, confidence and comparison functions over the whole ledger."""
    b = fixtures.bank(spark, sf_dir)
    score = F.col("rec_id") % 101
    return b.select(
        "rec_id", dates.month_key(F.col("date")).alias("month"), dates.month_number(F.col("date")).cast("long").alias("month_no"),
        text.confidence_label(score).alias("confidence"), money.compare_amounts(F.col("amount_li"), F.col("rec_id")).alias("compared"),
        money.amounts_match(F.col("amount_li"), F.col("amount_li") + score).alias("same"),
        text.critical_category(F.when(score % 3 == 0, "对方账号").when(score % 3 == 1, "客户名称").otherwise("摘要")).alias("category"),
    )


def side_components(spark, sf_dir):
    """Connected components of the candidates: their number of candidates by component."""
    return nearest.component_sizes(*_two(spark, sf_dir), CONFIG)


def daily_stats(spark, sf_dir):
    return balances.daily_table(*_two(spark, sf_dir))


def monthly_stats(spark, sf_dir):
    return balances.monthly_table(balances.daily_table(*_two(spark, sf_dir)))


def side_totals(spark, sf_dir):
    b, j = _two(spark, sf_dir)
    return balances.side_totals(b, "bank").unionByName(balances.side_totals(j, "journal"))


def running_balance(spark, sf_dir):
    return balances.running(fixtures.bank(spark, sf_dir), 1_000_000)


def opening_balance(spark, sf_dir):
    return balances.opening_balance(fixtures.bank(spark, sf_dir))


def balance_continuity(spark, sf_dir):
    return balances.continuity(fixtures.bank(spark, sf_dir))


def balance_diff(spark, sf_dir):
    return balances.balance_diff(*_two(spark, sf_dir)).drop("is_diff")


def exact_1to1(spark, sf_dir):
    return c.exact_pairs(*_two(spark, sf_dir), CONFIG).select("b_min", "j_min", "first_date", "b_income", "b_expense")


def tolerance_band(spark, sf_dir):
    return c.band_pairs(*_two(spark, sf_dir), CONFIG)


def tolerance_top(spark, sf_dir):
    """Of each bank row, the nearest pairs."""
    return nearest.candidates(nearest.found(*_two(spark, sf_dir), CONFIG)).where("ctype <> 'exact_1to1'").select("ctype", "b_min", "j_min")


def rule_candidates(spark, sf_dir):
    return c.rule_pairs(*fixtures.fees(spark, sf_dir), CONFIG).select("ctype", "b_min", "j_min", "structure_bonus")


def batch_groups(spark, sf_dir):
    return c.batch_groups(*fixtures.payroll(spark, sf_dir), CONFIG).select("b_n", "b_expense", "j_expense", "first_date", "last_date", "j_min")


def summary_islands(spark, sf_dir):
    b, j = fixtures.runs(spark, sf_dir)
    return c.island_groups(b, j, CONFIG).select("b_n", "j_n", "b_min", "j_min", "b_income", "first_date", "last_date")


_GROUP = ("b_n", "j_n", "b_income", "b_expense", "first_date", "last_date")


def daily_total(spark, sf_dir):
    return c.total_groups(*fixtures.balanced(spark, sf_dir), monthly=False).select("b_key", *_GROUP)


def monthly_total(spark, sf_dir):
    return c.total_groups(*fixtures.balanced(spark, sf_dir), monthly=True).select("b_key", *_GROUP)


def cross_month_total(spark, sf_dir):
    return c.cross_month_groups(*fixtures.balanced(spark, sf_dir, turn=True), CONFIG).select("b_key", "j_key", *_GROUP)


def group_metrics(spark, sf_dir):
    b, j = _two(spark, sf_dir)
    sums = lambda side, p: side.groupBy("date").agg(F.sum(scoring.income(F.col("amount_li"))).alias(f"{p}_income"), F.sum(scoring.expense(F.col("amount_li"))).alias(f"{p}_expense"))
    both = sums(b, "b").join(sums(j, "j"), "date")
    m = scoring.metrics(*[F.col(x) for x in ("b_income", "b_expense", "j_income", "j_expense")])
    return both.select("date", *[v.alias(k) for k, v in m.items()])


def amount_buckets(spark, sf_dir):
    return fixtures.bank(spark, sf_dir).groupBy("summary").agg(*money.bucket_counts(F.col("amount_li")))


def _rated(spark, sf_dir, config):
    return selection.scored(nearest.with_ambiguity(*_two(spark, sf_dir), config), config)


def ambiguity_flags(spark, sf_dir):
    return _rated(spark, sf_dir, CONFIG).select("b_min", "j_min", "ambiguous")


def score_no_text(spark, sf_dir):
    return _rated(spark, sf_dir, CONFIG).select("b_min", "j_min", "amount_score", "date_score", "structure_score", "score")


def routing(spark, sf_dir):
    rated = _rated(spark, sf_dir, CONFIG)
    return selection.routed(rated, CONFIG).select("b_min", "j_min", "route_reason", "status")


def select_matches(spark, sf_dir):
    rated = _rated(spark, sf_dir, CONFIG).persist()
    m = rated.select("candidate_id", F.explode(F.array(F.struct(F.lit("B").alias("side"), F.col("b_min").alias("rec_id")), F.struct(F.lit("J").alias("side"), F.col("j_min").alias("rec_id")))).alias("m"))
    members = m.select("candidate_id", "m.*").persist()
    chosen = selection.select(rated, members)
    return selection.numbered(rated.join(chosen, "candidate_id", "left_semi")).select("match_id", "candidate_id", "score", "diff_li", "span")


def difference_pools(spark, sf_dir):
    rated = _rated(spark, sf_dir, CONFIG)
    return pools.pools(pools.components(rated, CONFIG), CONFIG)


def unmatched_bank(spark, sf_dir):
    """Bank rows that no exact pair has."""
    b, j = _two(spark, sf_dir)
    pairs = c.exact_pairs(b, j, CONFIG, scored=False)
    m = pairs.select("candidate_id", F.lit("B").alias("side"), F.col("b_min").alias("rec_id"))
    return selection.unmatched(b, "B", pairs, m).select("rec_id", "date", "amount_li")


def unmatched_journal(spark, sf_dir):
    b, j = _two(spark, sf_dir)
    pairs = c.exact_pairs(b, j, CONFIG, scored=False)
    m = pairs.select("candidate_id", F.lit("J").alias("side"), F.col("j_min").alias("rec_id"))
    return selection.unmatched(j, "J", pairs, m).select("rec_id", "date", "amount_li")


def bigram_dice(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return customer.select("c_custkey", F.round(text.bigram_dice(F.col("c_name"), F.concat(F.lit("Customer#"), F.col("c_mktsegment"))), 9).alias("dice"))


def text_similarity(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    distinct = part.select("p_name", "p_type").distinct().withColumn("similarity", text.text_similarity("p_name", "p_type"))
    return part.join(distinct, ["p_name", "p_type"]).select("p_partkey", "similarity")


def subset_sums(spark, sf_dir):
    """Bank rows as sums of the journal's rows: those of each window's 30 largest amounts, among which are those of the large orders."""
    found = subset_sum.solutions(*fixtures.large_splits(spark, sf_dir), CONFIG)
    return found.select("rec_id", "amount_li", F.array_join(F.transform("ids", lambda x: x.cast("string")), "+").alias("ids"))


def calendar_days(spark, sf_dir):
    return balances.calendar(balances.daily(fixtures.bank(spark, sf_dir)))


def _reconciled(spark, sf_dir) -> reconcile.Reconciliation:
    return reconcile.reconcile(*_two(spark, sf_dir), CONFIG)


def match_groups(spark, sf_dir):
    return reports.match_groups(_reconciled(spark, sf_dir))


def match_members(spark, sf_dir):
    done = _reconciled(spark, sf_dir)
    return reports.match_members(done, *_two(spark, sf_dir))


def pending_review(spark, sf_dir):
    return reports.pending_review(_reconciled(spark, sf_dir))


def kpi_summary(spark, sf_dir):
    done = _reconciled(spark, sf_dir)
    return reports.kpis(done)


def small_differences(spark, sf_dir):
    return reports.small_differences(_reconciled(spark, sf_dir))


def streaming_daily(spark, sf_dir):
    from tallyspark.streaming import daily

    return daily.event_days(spark, sf_dir)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(spark, sf_dir)


_NOT_QUERIES = {"entry", "queries", "oracle_sql"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        standardize_amounts, standardize_dates, normalize_text, amount_li, standardized_ledger, standardized_columns, standardized_signed, input_checks, daily_stats, monthly_stats, side_totals, running_balance,
        opening_balance, balance_continuity, balance_diff, calendar_days, exact_1to1, tolerance_band, tolerance_top, rule_candidates, batch_groups, summary_islands,
        daily_total, monthly_total, cross_month_total, group_metrics, amount_buckets, ambiguity_flags, score_no_text, routing, select_matches,
        difference_pools, unmatched_bank, unmatched_journal, bigram_dice, text_similarity, subset_sums, match_groups, match_members, pending_review,
        kpi_summary, small_differences, streaming_daily, parse_error_counts, masked_texts, ledger_labels, side_components,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from tallyspark.plans import oracles

    return oracles.sql()

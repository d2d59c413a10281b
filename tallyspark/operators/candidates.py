"""Candidate generators: nine joins between the bank's and the journal's ledger.

A ledger has rec_id, date, amount_li, summary, original_idx and aux (label -> text).  Each
generator returns one row per candidate: its id and type, flags, size and non-netted sums of
both sides, first and last date, and the keys of its sides; `members` gives its records.
Records are never consumed here; selection does that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig
from tallyspark.functions import dates, text
from tallyspark.functions.scoring import expense, income

# --- fixed values: rule words -----------------------------------------------------------
STRONG_RULES = {
    "手续费": ["手续费", "账户管理费", "年费", "网银费", "服务费", "费率", "扣费", "汇费", "转账费"],
    "利息": ["利息", "活期利息", "存款利息", "结息", "利息收入", "利息支出", "理财收益"],
}
POSITIVE_RULES = {
    "工资": ["工资", "代发工资", "薪资", "薪酬", "薪金", "代发", "发放", "津贴", "奖金"],
    "税费": ["税费", "印花税", "增值税", "附加税", "所得税", "个税", "税款", "税务", "代扣代缴"],
}
WEAK_RULES = {"收款": ["收款", "回款", "入账"]}
NEGATIVE_WORDS = ["往来款", "货款", "转账", "汇款", "备用金", "借款", "还款"]
PAYROLL_WORDS = ["工资", "代发", "批量", "发放", "薪资", "薪酬"]
# ----------------------------------------------------------------------------------------
RULES = [("强规则", STRONG_RULES, 3, True), ("正规则", POSITIVE_RULES, 3, True), ("弱规则", WEAK_RULES, 1, False)]
BATCH_DAYS = 3


def _sides(bank: DataFrame, journal: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    columns = ["rec_id", "date", "amount_li", *extra]
    return (
        bank.select(*[F.col(c).alias(f"b_{c}") for c in columns]),
        journal.select(*[F.col(c).alias(f"j_{c}") for c in columns]),
    )


def pair_rows(joined: DataFrame, kind: Column, stage: str, *extra: str, rule: bool = False, bonus: Column | bool = True) -> DataFrame:
    """One-to-one candidates of joined rows."""
    return joined.select(
        F.concat_ws("|", kind, F.concat(F.lit("B:"), F.col("b_rec_id")), F.concat(F.lit("J:"), F.col("j_rec_id"))).alias("candidate_id"),
        kind.alias("ctype"), F.lit(stage).alias("stage"), F.lit(rule).alias("rule_matched"),
        (bonus if isinstance(bonus, Column) else F.lit(bonus)).alias("structure_bonus"), F.lit(False).alias("full_group"), F.lit(False).alias("cross_many"),
        F.lit(1).cast("long").alias("b_n"), F.lit(1).cast("long").alias("j_n"),
        income(F.col("b_amount_li")).alias("b_income"), expense(F.col("b_amount_li")).alias("b_expense"),
        income(F.col("j_amount_li")).alias("j_income"), expense(F.col("j_amount_li")).alias("j_expense"),
        F.least("b_date", "j_date").alias("first_date"), F.greatest("b_date", "j_date").alias("last_date"),
        F.col("b_rec_id").alias("b_min"), F.col("j_rec_id").alias("j_min"),
        F.concat(F.lit("B:"), F.col("b_rec_id")).alias("b_key"), F.concat(F.lit("J:"), F.col("j_rec_id")).alias("j_key"), *extra,
    )


def _top(joined: DataFrame, order: list, k: int) -> DataFrame:
    ranked = joined.withColumn("__r", F.row_number().over(Window.partitionBy("b_rec_id").orderBy(*order)))
    return ranked.where(F.col("__r") <= k).drop("__r")


def _local(joined: DataFrame) -> DataFrame:
    """Adds the local text score of each pair."""
    return joined.withColumn("local", text.text_evidence("b_aux", "j_aux")["local"])


def _keyed(side: DataFrame) -> DataFrame:
    """The rows of a side with a hash of their labelled texts."""
    return side.select("rec_id", "date", "amount_li", "aux", F.xxhash64(F.to_json(F.array_sort(F.map_entries("aux")))).alias("t"))


CLASS = ("date", "amount_li", "t")


def _best_by_text(bank: DataFrame, journal: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame], order: list[str], k: int) -> DataFrame:
    """Of each bank row, the first k of the pairs that `pairs` makes, by text, then the order, then the least journal id.

    Rows of equal date, amount and texts are one class: pairs are formed, and texts compared, between classes, so
    copies do not multiply them.  A class of the journal is then replaced by its first k rows, unless those
    before it are k already, and the bank's classes by their rows.
    """
    b, j = _keyed(bank), _keyed(journal)
    as_one = lambda side: side.groupBy(*CLASS).agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("n"), F.first("aux").alias("aux"))
    found = _local(pairs(as_one(b), as_one(j))).drop("b_aux", "j_aux", "b_n", "j_rec_id")
    by = [F.desc("local"), *order]
    rows = F.sum("j_n")
    before = rows.over(Window.partitionBy("b_rec_id").orderBy(*by)) - rows.over(Window.partitionBy("b_rec_id", "local", *order))
    found = found.withColumn("__before", before).where(F.col("__before") < k).drop("__before", "j_n")
    first = j.withColumn("__r", F.row_number().over(Window.partitionBy(*CLASS).orderBy("rec_id"))).where(F.col("__r") <= k)
    found = found.join(first.select(F.col("rec_id").alias("j_rec_id"), *[F.col(x).alias(f"j_{x}") for x in CLASS]), [f"j_{x}" for x in CLASS])
    top = _top(found, [*by, F.col("j_rec_id")], k).drop("b_rec_id")
    return top.join(b.select(F.col("rec_id").alias("b_rec_id"), *[F.col(x).alias(f"b_{x}") for x in CLASS]), [f"b_{x}" for x in CLASS])


def exact_pairs(bank: DataFrame, journal: DataFrame, config: ReconConfig, scored: bool = True, whole: bool = False) -> DataFrame:
    """Pairs of equal date and amount; per bank row the best by text, then the least journal id, or with whole all of them."""

    def pairs(bank: DataFrame, journal: DataFrame, *extra: str) -> DataFrame:
        b, j = _sides(bank, journal, *extra)
        return b.join(j, (F.col("b_date") == F.col("j_date")) & (F.col("b_amount_li") == F.col("j_amount_li")))

    if whole:
        top = pairs(bank, journal)
    elif scored:
        top = _best_by_text(bank, journal, lambda b, j: pairs(b, j, "aux", "t", "n"), [], config.max_candidates)
    else:
        top = _top(pairs(bank, journal), [F.col("j_rec_id")], config.max_candidates)
    return pair_rows(top, F.lit("exact_1to1"), "精确")


def cells(at: Column, tolerance: int, spread: bool) -> Column:
    """The cell of a number, cells being twice as wide as the tolerance; with spread, the one or two cells within the tolerance of it."""
    width = max(1, 2 * tolerance)
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    return F.array_distinct(F.array(cell(at - tolerance), cell(at + tolerance))) if spread else cell(at)


def band_join(bank: DataFrame, journal: DataFrame, config: ReconConfig, *extra: str) -> DataFrame:
    """Pairs of one sign, near in amount and date but not exact.

    Amounts and days fall into cells twice as wide as their tolerances.  A journal row is put
    into the cells that it reaches, four at most, so the join is on equality of (sign, amount
    cell, day cell): a pair meets in one cell only, and rows of other years don't meet at all.
    """
    b, j = _sides(bank, journal, *extra)
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    b = b.withColumn("__sign", F.signum("b_amount_li")).withColumn("__band", cells(F.col("b_amount_li"), config.trivial_li, False))
    b = b.withColumn("__days", cells(day("b_date"), config.tolerance_days, False))
    j = j.withColumn("__sign", F.signum("j_amount_li")).withColumn("__band", F.explode(cells(F.col("j_amount_li"), config.trivial_li, True)))
    j = j.withColumn("__days", F.explode(cells(day("j_date"), config.tolerance_days, True)))
    gap, days = F.abs(F.col("b_amount_li") - F.col("j_amount_li")), F.abs(F.datediff("b_date", "j_date"))
    joined = b.join(j, ["__sign", "__band", "__days"]).withColumn("gap", gap).withColumn("days", days)
    return joined.where((F.col("gap") <= config.trivial_li) & (F.col("days") <= config.tolerance_days) & ((F.col("gap") > 0) | (F.col("days") > 0)))


CLASS_ROWS = 1000  # rows of one class that a row may hold


def _classes(side: DataFrame) -> DataFrame:
    """(date, amount_li, rec_id, ids): rows of equal date and amount as one row, or as one for each CLASS_ROWS of them; rec_id is their least id."""
    ids = side.groupBy("date", "amount_li").agg(F.array_sort(F.collect_list(F.struct("rec_id")))["rec_id"].alias("__ids"))  # collected as structs, as nulls would go
    parts = F.sequence(F.lit(0), F.floor((F.size("__ids") - 1) / F.lit(CLASS_ROWS)).cast("int"))
    each = F.transform(parts, lambda i: F.slice("__ids", i * CLASS_ROWS + 1, F.lit(CLASS_ROWS)))
    return ids.select("date", "amount_li", F.explode(each).alias("ids")).withColumn("rec_id", F.col("ids")[0])


def band_pairs(bank: DataFrame, journal: DataFrame, config: ReconConfig) -> DataFrame:
    """(b_rec_id, j_rec_id, gap, days): all pairs of the band join.

    Rows of equal date and amount are one class: cells hold, and compare, classes.  A pair of classes is spelt out
    last, its rows one after another, so that the columns of copies' pairs repeat and take little room where they are written.
    """
    found = band_join(_classes(bank), _classes(journal), config, "ids")
    found = found.select(F.explode("b_ids").alias("b_rec_id"), "j_ids", "gap", "days")
    return found.select("b_rec_id", F.explode("j_ids").alias("j_rec_id"), "gap", "days")


def tolerance_pairs(bank: DataFrame, journal: DataFrame, config: ReconConfig, scored: bool = True, whole: bool = False) -> DataFrame:
    """Pairs of the band join; per bank row the best by text, gap, days and the least journal id, or with whole all of them."""
    order = ["gap", "days"]
    if whole:
        top = band_join(bank, journal, config)
    elif scored:
        top = _best_by_text(bank, journal, lambda b, j: band_join(b, j, config, "aux", "t", "n"), order, config.max_candidates)
    else:
        top = _top(band_join(bank, journal, config), [*order, F.col("j_rec_id")], config.max_candidates)
    kind = F.when(F.col("gap") == 0, "tolerance_date").otherwise("amount_difference")
    return pair_rows(top, kind, "容差").withColumn("stage", F.when(F.col("ctype") == "tolerance_date", "容差").otherwise("金额差异"))


def _any_word(words: list[str]) -> str:
    return "(?i)" + "|".join(words)


def rule_text(aux: Column) -> Column:
    return F.concat_ws(" ", F.map_values(aux))


def rule_pairs(bank: DataFrame, journal: DataFrame, config: ReconConfig, scored: bool = True, whole: bool = False) -> DataFrame:
    """Pairs of equal amount whose texts both hold a rule's words and no negative word; per bank row and rule the best, or with whole all of them."""

    def ruled(side: DataFrame, prefix: str) -> DataFrame:
        words = rule_text(F.col(f"{prefix}_aux"))
        hits = [
            F.when(words.rlike(_any_word(own)), F.struct(F.lit(group).alias("group"), F.lit(name).alias("rule"), F.lit(days).alias("most"), F.lit(bonus).alias("bonus")))
            for group, rules, days, bonus in RULES
            for name, own in rules.items()
        ]
        side = side.where(~words.rlike(_any_word(NEGATIVE_WORDS)))
        return side.withColumn("__hit", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))

    b, j = _sides(bank, journal, "aux")
    b = ruled(b, "b").select("*", "__hit.*").drop("__hit")
    j = ruled(j, "j").select("*", F.col("__hit.group").alias("__g"), F.col("__hit.rule").alias("__rule")).drop("__hit")
    joined = b.join(j, (F.col("rule") == F.col("__rule")) & (F.col("group") == F.col("__g")) & (F.col("b_amount_li") == F.col("j_amount_li")))
    joined = joined.withColumn("days", F.abs(F.datediff("b_date", "j_date"))).where("days <= most")
    if not whole:
        order = [F.col("days"), F.col("j_rec_id")]
        if scored:
            joined, order = _local(joined), [F.desc("local"), *order]
        ranked = joined.withColumn("__r", F.row_number().over(Window.partitionBy("b_rec_id", "rule").orderBy(*order)))
        joined = ranked.where(F.col("__r") <= config.max_candidates)
    return pair_rows(joined, F.concat_ws("_", "group", "rule"), "白名单", rule=True, bonus=F.col("bonus"))


def _sums(prefix: str) -> list[Column]:
    li = F.col("amount_li")
    return [
        F.count("*").alias(f"{prefix}_n"), F.sum(income(li)).alias(f"{prefix}_income"), F.sum(expense(li)).alias(f"{prefix}_expense"),
        F.min("date").alias(f"{prefix}_first"), F.max("date").alias(f"{prefix}_last"), F.min("rec_id").alias(f"{prefix}_min"),
    ]


def _groups(joined: DataFrame, kind: str, stage: str, b_key: Column, j_key: Column, full: bool, cross: bool = False) -> DataFrame:
    """Candidates of joined group rows."""
    return joined.select(
        F.concat_ws("|", F.lit(kind), b_key, j_key).alias("candidate_id"), F.lit(kind).alias("ctype"), F.lit(stage).alias("stage"),
        F.lit(True).alias("rule_matched"), F.lit(True).alias("structure_bonus"), F.lit(full).alias("full_group"), F.lit(cross).alias("cross_many"),
        "b_n", "j_n", "b_income", "b_expense", "j_income", "j_expense",
        F.least("b_first", "j_first").alias("first_date"), F.greatest("b_last", "j_last").alias("last_date"), "b_min", "j_min",
        b_key.alias("b_key"), j_key.alias("j_key"),
    )


def batch_groups(bank: DataFrame, journal: DataFrame, config: ReconConfig) -> DataFrame:
    """Payroll: many equal bank rows of a day against one journal row of their sum."""
    payroll = _any_word(PAYROLL_WORDS)
    words = rule_text(F.col("aux"))
    groups = bank.groupBy("date", "amount_li").agg(
        *_sums("b"), F.count_if(words != "").alias("__texts"), F.count_if((words != "") & ~words.rlike(payroll)).alias("__others")
    )
    groups = groups.where((F.col("b_n") >= config.batch_min_count) & (F.col("__texts") > 0) & (F.col("__others") == 0))
    groups = groups.withColumn("__total", F.col("b_n") * F.col("amount_li"))
    rows = journal.where(words.rlike(payroll)).select(
        F.col("rec_id").alias("j_min"), F.col("date").alias("j_first"), F.col("date").alias("j_last"), F.col("amount_li").alias("j_li"),
        F.lit(1).cast("long").alias("j_n"), income(F.col("amount_li")).alias("j_income"), expense(F.col("amount_li")).alias("j_expense"),
    )
    joined = groups.join(rows, F.col("__total") == F.col("j_li")).where(F.abs(F.datediff("date", "j_first")) <= BATCH_DAYS)
    b_key = F.concat(F.lit("B:batch:"), F.col("date").cast("string"), F.lit(":"), F.col("amount_li"))
    return _groups(joined, "batch_aggregation", "聚合", b_key, F.concat(F.lit("J:"), F.col("j_min")), full=True)


def islands(side: DataFrame) -> DataFrame:
    """Rows in maximal runs of consecutive original_idx and equal, non-empty normalised summary; island is the run's first idx.

    Runs cannot span summaries, so the gap test is done within each summary: idx minus its
    rank there is the same along a run.
    """
    rows = side.withColumn("norm", text.normalize_summary(F.col("summary"))).where("norm <> ''")
    rank = F.row_number().over(Window.partitionBy("norm").orderBy("original_idx"))
    rows = rows.withColumn("__run", F.col("original_idx") - rank)
    return rows.withColumn("island", F.min("original_idx").over(Window.partitionBy("norm", "__run"))).drop("__run")


def _island_side(many: DataFrame, one: DataFrame, config: ReconConfig, turned: bool) -> DataFrame:
    p, q = ("j", "b") if turned else ("b", "j")
    rows = islands(many)
    if not config.allow_zero_match:
        rows = rows.withColumn("__zero", F.max((F.col("amount_li") == 0).cast("int")).over(Window.partitionBy("norm", "island"))).where("__zero = 0")
    runs = rows.groupBy("norm", "island").agg(*_sums(p)).where(f"{p}_n >= 2")
    single = one.withColumn("__norm", text.normalize_summary(F.col("summary")))
    if not config.allow_zero_match:
        single = single.where("amount_li <> 0")
    single = single.select(
        "__norm", F.col("rec_id").alias(f"{q}_min"), F.col("date").alias(f"{q}_first"), F.col("date").alias(f"{q}_last"), F.lit(1).cast("long").alias(f"{q}_n"),
        income(F.col("amount_li")).alias(f"{q}_income"), expense(F.col("amount_li")).alias(f"{q}_expense"),
    )
    joined = runs.join(
        single, (F.col("norm") == F.col("__norm")) & (F.col("b_income") == F.col("j_income")) & (F.col("b_expense") == F.col("j_expense"))
    )
    span = F.datediff(F.greatest("b_last", "j_last"), F.least("b_first", "j_first"))
    joined = joined.where(span <= config.dfs_date_window)
    run = F.concat(F.lit(f"{p.upper()}:run:"), F.col("island"))
    row = F.concat(F.lit(f"{q.upper()}:"), F.col(f"{q}_min"))
    return _groups(joined, "continuous_summary_group", "连续摘要整组", row if turned else run, run if turned else row, full=False)


def island_groups(bank: DataFrame, journal: DataFrame, config: ReconConfig) -> DataFrame:
    """Runs of one side against one row of the other with the same summary and sum, both ways."""
    return _island_side(bank, journal, config, False).unionByName(_island_side(journal, bank, config, True))


def total_groups(bank: DataFrame, journal: DataFrame, monthly: bool) -> DataFrame:
    """All rows of a day (a month) on both sides whose incomes and expenses agree, unless one against one."""
    key = dates.month_key(F.col("date")) if monthly else F.col("date").cast("string")
    b = bank.groupBy(key.alias("period")).agg(*_sums("b"))
    j = journal.groupBy(key.alias("__p")).agg(*_sums("j"))
    joined = b.join(j, (F.col("period") == F.col("__p")) & (F.col("b_income") == F.col("j_income")) & (F.col("b_expense") == F.col("j_expense")))
    joined = joined.where("not (b_n = 1 and j_n = 1) and b_income + b_expense > 0")
    name, stage = ("monthly_total", "月核销") if monthly else ("daily_total", "日核销")
    unit = "month" if monthly else "day"
    return _groups(
        joined, name, stage, F.concat(F.lit(f"B:{unit}:"), F.col("period")), F.concat(F.lit(f"J:{unit}:"), F.col("period")), full=True
    )


def cross_month_groups(bank: DataFrame, journal: DataFrame, config: ReconConfig) -> DataFrame:
    """Whole months next to each other, several rows each, whose incomes and expenses agree."""
    month = dates.month_number(F.col("date"))
    b = bank.groupBy(month.alias("b_month")).agg(*_sums("b")).where("b_n > 1").withColumn("near", F.explode(F.array(F.col("b_month") - 1, F.col("b_month") + 1)))
    j = journal.groupBy(month.alias("j_month")).agg(*_sums("j")).where("j_n > 1")
    joined = b.join(j, (F.col("near") == F.col("j_month")) & (F.col("b_income") == F.col("j_income")) & (F.col("b_expense") == F.col("j_expense")))
    joined = joined.where(F.datediff(F.greatest("b_last", "j_last"), F.least("b_first", "j_first")) <= config.tolerance_days)
    joined = joined.where("b_income + b_expense > 0")
    b_key, j_key = F.concat(F.lit("B:monthno:"), F.col("b_month")), F.concat(F.lit("J:monthno:"), F.col("j_month"))
    return _groups(joined, "cross_month_total", "跨月核销", b_key, j_key, full=True, cross=True)


def side_keys(side: DataFrame, prefix: str) -> DataFrame:
    """(key, rec_id): every key that a candidate can name a group of this side's records by."""
    P = prefix.upper()
    own = side.select(F.concat(F.lit(f"{P}:"), F.col("rec_id")).alias("key"), "rec_id")
    day = side.select(F.concat(F.lit(f"{P}:day:"), F.col("date").cast("string")).alias("key"), "rec_id")
    month = side.select(F.concat(F.lit(f"{P}:month:"), dates.month_key(F.col("date"))).alias("key"), "rec_id")
    number = side.select(F.concat(F.lit(f"{P}:monthno:"), dates.month_number(F.col("date"))).alias("key"), "rec_id")
    batch = side.select(F.concat(F.lit(f"{P}:batch:"), F.col("date").cast("string"), F.lit(":"), F.col("amount_li")).alias("key"), "rec_id")
    run = islands(side).select(F.concat(F.lit(f"{P}:run:"), F.col("island")).alias("key"), "rec_id")
    return own.unionByName(day).unionByName(month).unionByName(number).unionByName(batch).unionByName(run)


def members(candidates: DataFrame, bank: DataFrame, journal: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(candidate_id, side, rec_id) of candidates; sets: further (key, rec_id), as subset sums have them.

    A side of one record is that record; only groups are looked up by their keys.
    """
    out = None
    for prefix, side in (("b", bank), ("j", journal)):
        keys = side_keys(side, prefix)
        if sets is not None:
            keys = keys.unionByName(sets.where(F.col("key").startswith(f"{prefix.upper()}:")))
        name = F.lit(prefix.upper()).alias("side")
        wanted = candidates.where(F.col(f"{prefix}_n") > 1).select("candidate_id", F.col(f"{prefix}_key").alias("key"))
        one = candidates.where(F.col(f"{prefix}_n") == 1).select("candidate_id", name, F.col(f"{prefix}_min").alias("rec_id"))
        found = one.unionByName(wanted.join(keys, "key").select("candidate_id", name, "rec_id"))
        out = found if out is None else out.unionByName(found)
    return out

"""Scalar expressions: money, dates, text, scores."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig
from tallyspark.functions import dates, money, scoring, text
from tallyspark.plans import registry

CONFIG = ReconConfig()


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clean_amount(spark):
    got = values(spark, [(x,) for x in [*registry.AMOUNT_TEXTS, None]], "v string", money.clean_amount(F.col("v")))
    want = [None if v is None else Decimal(v) for v in [*registry.AMOUNT_VALUES, "0.00"]]
    assert [x for (x,) in got] == want


def test_brackets_come_in_one_pair(spark):
    cells = {"1(00": None, "(100": None, "（8.5）": None, "(-5)": Decimal("5.00"), "(100)": Decimal("-100.00"), "(100CR)": Decimal("100.00"), "(100)CR": None, "((1))": None, "()": None, "(1,234.5)": Decimal("-1234.50"), "5 cr": Decimal("-5.00")}
    got = values(spark, [(x,) for x in cells], "v string", F.col("v"), money.clean_amount(F.col("v")))
    assert dict(got) == cells
    numbers = values(spark, [("1,234.565",), ("x",), ("",), ("12",)], "v string", money.round_decimal(F.replace(F.col("v"), F.lit(","), F.lit(""))), money.restored_number(F.col("v")))
    assert numbers == [(1234.57, 1234.565), (0.0, None), (0.0, None), (12.0, 12.0)]


def test_suffixes_follow_the_source(spark):
    rows = [("100CR",), ("100DR",), ("5贷",), ("5借",), ("7",)]
    bank = [x for (x,) in values(spark, rows, "v string", money.source_amount(F.col("v"), "bank"))]
    journal = [x for (x,) in values(spark, rows, "v string", money.source_amount(F.col("v"), "journal"))]
    assert bank == [100, -100, 5, -5, 7] and journal == [-100, 100, -5, 5, 7]


def test_directions(spark):
    rows = [("贷",), (" 借方 ",), ("dr",), ("收入",), ("付",), ("?",)]
    assert [x for (x,) in values(spark, rows, "v string", money.direction_sign(F.col("v"), "bank"))] == [1, -1, -1, 1, -1, None]
    assert [x for (x,) in values(spark, rows, "v string", money.direction_sign(F.col("v"), "journal"))] == [-1, 1, 1, 1, -1, None]
    with pytest.raises(ValueError):
        money.direction_sign(F.lit("贷"), "other")


def test_li(spark):
    rows = [("1.00005",), ("-0.00005",), ("x",), (None,), ("12.34",)]
    got = values(spark, rows, "v string", money.to_li(F.col("v")), money.to_decimal(F.col("v")))
    assert got == [(10001, Decimal("1.00")), (-1, Decimal("0.00")), (0, 0), (0, 0), (123400, Decimal("12.34"))]
    assert values(spark, [(123456,)], "li long", money.from_li(F.col("li"))) == [(Decimal("12.35"),)]


def test_dates(spark):
    got = [x for (x,) in values(spark, [(x,) for x in registry.DATE_TEXTS], "v string", dates.parse_date(F.col("v")))]
    assert got == [None if v is None else datetime.date.fromisoformat(v) for v in registry.DATE_VALUES]


def test_texts(spark):
    got = [x for (x,) in values(spark, [(x,) for x in registry.SUMMARY_TEXTS], "v string", text.normalize_summary(F.col("v")))]
    assert got == registry.SUMMARY_VALUES
    rows = [("=1+1",), (" -x",), ("ok",), ("a\x01b",), ("x" * 32001,)]
    cells = [x for (x,) in values(spark, rows, "v string", text.clean_excel_string(F.col("v")))]
    assert cells[:4] == ["'=1+1", "' -x", "ok", "ab"] and len(cells[4]) == 32003


def test_similarity_and_conflicts(spark):
    assert text.similarity("ＡＢＣ 公司", "abc公司") == 100 and text.similarity("", "a") == 0 and text.similarity("甲乙", "丙丁") == 0
    local, support, conflicts = text.evidence({"摘要": "货款", "对方户名": "甲公司"}, {"摘要": "货款", "客户名称": "乙公司"})
    assert conflicts == ["对方户名"] and "摘要" in support and local > 0
    assert text.evidence({}, {"a": "x"}) == (0, [], [])
    score = values(spark, [(0, 100)], "l int, m int", text.text_score(F.col("l"), F.col("m")))
    assert score == [(18,)]


def test_metrics(spark):
    rows = [(1_200_000_000, 200_000_000, 1_000_000_000, 100_000_000)]
    m = scoring.metrics(*[F.col(c) for c in ("a", "b", "c", "d")])
    got = spark.createDataFrame(rows, "a long, b long, c long, d long").select(*[v.alias(k) for k, v in m.items()]).first()
    assert (got["b_gross"], got["j_gross"], got["income_diff"], got["expense_diff"], got["diff_li"]) == (1_400_000_000, 1_100_000_000, 200_000_000, 100_000_000, 300_000_000)


def test_scores_round_half_to_even(spark):
    rows = [(0, 0, 0), (50_000_000, 1, 31), (28_750_000, 1, 30), (100_000_000, 200_000_000, 1)]
    got = values(spark, rows, "d long, g long, s int", scoring.amount_score(F.col("d"), F.col("g"), CONFIG), scoring.date_score(F.col("s"), CONFIG))
    assert got == [(40, 15), (20, 0), (28, 0), (10, 15)]


def test_structure_and_cap(spark):
    def one(b, j, ambiguous=False, cross=False, conflicts=0, rule=False, bonus=True):
        col = scoring.structure_score(F.lit(b), F.lit(j), F.lit(ambiguous), F.lit(cross), F.lit(conflicts), F.lit(rule), F.lit(bonus))
        return spark.range(1).select(col).first()[0]

    assert (one(1, 1), one(1, 3), one(2, 3), one(1, 1, True), one(2, 2, cross=True), one(1, 1, conflicts=5)) == (15, 12, 9, 10, 4, 9)
    assert (one(2, 3, rule=True), one(1, 1, rule=True), one(1, 2, rule=True, bonus=False)) == (15, 15, 12)
    capped = scoring.capped_structure(F.lit(40), F.lit(15), F.lit(0), F.lit(15), F.lit(True))
    assert spark.range(1).select(capped).first()[0] == 14


@pytest.mark.parametrize(
    ("group", "cross", "conflicts", "ambiguous", "diff", "score", "why"),
    [
        (1_000_000_000, False, 0, False, 0, 0, "no_difference"), (1_000_000_100, False, 0, False, 0, 100, "over_materiality"), (1, True, 0, False, 0, 90, "cross_month"),
        (1, False, 1, False, 0, 90, "conflict"), (1, False, 0, True, 0, 90, "ambiguity"), (1, False, 1, True, 0, 90, "conflict_and_ambiguity"),
        (1, False, 0, False, 50_000_000, 0, "trivial_difference"), (1, False, 0, False, 50_000_001, 70, "score"), (1, False, 0, False, 50_000_001, 69, "low_score"),
    ],
)
def test_routing(spark, group, cross, conflicts, ambiguous, diff, score, why):
    col = scoring.reason(F.lit(group), F.lit(cross), F.lit(conflicts), F.lit(ambiguous), F.lit(diff), F.lit(score), CONFIG)
    got = spark.range(1).select(col.alias("w"), scoring.routed(col).alias("s")).first()
    assert got["w"] == why
    assert (got["s"] == scoring.AUTO) == (why in ("no_difference", "trivial_difference", "score"))


def test_config_ranges():
    with pytest.raises(ValueError):
        ReconConfig(tolerance_days=366).checked()
    assert ReconConfig().problems() == [] and ReconConfig(random_seed=-2).problems()

"""Candidate scores (amount 40, date 15, text 30, structure 15) and routing, as Column expressions.

Scores round halves to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig

AUTO, REVIEW = "自动确认", "待人工复核"


def metrics(b_income: Column, b_expense: Column, j_income: Column, j_expense: Column) -> dict[str, Column]:
    """Sums that are never netted: gross of each side, differences of income and expense."""
    b_gross, j_gross = b_income + b_expense, j_income + j_expense
    income_diff, expense_diff = F.abs(b_income - j_income), F.abs(b_expense - j_expense)
    return {
        "b_gross": b_gross, "j_gross": j_gross, "group_li": F.greatest(b_gross, j_gross),
        "income_diff": income_diff, "expense_diff": expense_diff, "diff_li": income_diff + expense_diff,
    }


def income(li: Column) -> Column:
    return F.when(li > 0, li).otherwise(F.lit(0).cast("bigint"))


def expense(li: Column) -> Column:
    return F.when(li < 0, -li).otherwise(F.lit(0).cast("bigint"))


def amount_score(diff: Column, group: Column, config: ReconConfig) -> Column:
    trivial = config.trivial_li
    near = F.greatest(F.lit(20), F.bround(40 - 20.0 * diff / F.lit(max(1, trivial))).cast("int"))
    far = F.bround(20.0 * (1 - F.least(F.lit(1.0), diff / F.greatest(group, F.lit(1))))).cast("int")
    return F.when(diff == 0, 40).when(diff <= trivial, near).otherwise(far)


def date_score(span: Column, config: ReconConfig) -> Column:
    days = config.tolerance_days
    part = F.bround(15.0 * (1 - span / F.lit(max(1, days)))).cast("int")
    return F.when(span == 0, 15).when((F.lit(days) == 0) | (span >= days), 0).otherwise(part)


def structure_score(b_n: Column, j_n: Column, ambiguous: Column, cross_month: Column, conflicts: Column, rule: Column, bonus: Column) -> Column:
    base = F.when((b_n == 1) & (j_n == 1), 15).when((b_n == 1) | (j_n == 1), 12).otherwise(9)
    score = base - F.when(ambiguous, 5).otherwise(0) - F.when(cross_month, 5).otherwise(0) - F.least(F.lit(6), 3 * conflicts)
    score = score + F.when(rule & bonus, 6).otherwise(0)
    return F.least(F.greatest(score, F.lit(0)), F.lit(15))


def capped_structure(amount: Column, date: Column, text: Column, structure: Column, ambiguous: Column) -> Column:
    """An ambiguous candidate without text evidence has 69 points at most."""
    over = F.greatest(amount + date + text + structure - 69, F.lit(0))
    return F.when(ambiguous & (text == 0), F.greatest(structure - over, F.lit(0))).otherwise(structure)


def total(amount: Column, date: Column, text: Column, structure: Column) -> Column:
    return F.least(F.greatest(amount + date + text + structure, F.lit(0)), F.lit(100))


def reason(group: Column, cross_many: Column, conflicts: Column, ambiguous: Column, diff: Column, score: Column, config: ReconConfig) -> Column:
    """The first routing rule that applies."""
    return (
        F.when(group > config.materiality_li, "over_materiality")
        .when(cross_many, "cross_month")
        .when((conflicts > 0) & ambiguous, "conflict_and_ambiguity")
        .when(conflicts > 0, "conflict")
        .when(ambiguous, "ambiguity")
        .when(diff == 0, "no_difference")
        .when(diff <= config.trivial_li, "trivial_difference")
        .when(score >= config.auto_confirm_score, "score")
        .otherwise("low_score")
    )


def routed(why: Column) -> Column:
    return F.when(why.isin("no_difference", "trivial_difference", "score"), AUTO).otherwise(REVIEW)

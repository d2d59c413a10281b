"""Candidate joins, selection, pools, balances, subset sums, standardisation, sources."""

import datetime
import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.config import ReconConfig
from tallyspark.operators import balances, nearest, pools, precheck, selection, semantic, standardize, subset_sum
from tallyspark.operators import candidates as c
from tallyspark.plans import reconcile
from tallyspark.sources import files, headers, sinks

CONFIG = ReconConfig()
LEDGER = "rec_id long, date date, amount_li long, summary string, balance_li long, voucher_no string, aux map<string,string>, source string, original_idx long, original_file_row long"


def ledger(spark, rows, source="bank"):
    """rows: (day, yuan) or (day, yuan, summary) or (day, yuan, summary, balance)."""
    out = []
    for k, row in enumerate(rows):
        day, yuan, note, balance = [*row, *["", None][len(row) - 2 :]]
        date = None if day is None else datetime.date.fromisoformat(day)
        out.append((k, date, round(yuan * 10_000), note, None if balance is None else round(balance * 10_000), "", {"摘要": note} if note else {}, source, k + 1, k + 2))
    return spark.createDataFrame(out, LEDGER)


def kinds(df):
    return sorted((r["ctype"], r["b_n"], r["j_n"]) for r in df.collect())


def test_day_total_is_one_group(spark):
    b = ledger(spark, [("2024-01-05", 200), ("2024-01-05", 200), ("2024-01-05", 100)])
    j = ledger(spark, [("2024-01-05", 100)] * 5, "journal")
    assert kinds(c.total_groups(b, j, monthly=False)) == [("daily_total", 3, 5)]
    done = reconcile.reconcile(b, j)
    assert [(r["ctype"], r["b_n"], r["j_n"]) for r in done.selected.collect()] in ([("daily_total", 3, 5)], [("monthly_total", 3, 5)])


@pytest.mark.parametrize(("counts", "found"), [((9, 2), 0), ((10,), 1)])
def test_payroll_needs_ten_rows_of_a_day(spark, counts, found):
    rows = [(f"2024-01-0{5 + i}", -100, "代发工资") for i, n in enumerate(counts) for _ in range(n)]
    j = ledger(spark, [(f"2024-01-0{5 + i}", -100 * n, "工资发放") for i, n in enumerate(counts)], "journal")
    assert c.batch_groups(ledger(spark, rows), j, CONFIG).count() == found


def test_adjacent_months(spark):
    b = ledger(spark, [("2024-01-31", 60), ("2024-01-31", 40)])
    j = ledger(spark, [("2024-02-01", 30), ("2024-02-01", 70)], "journal")
    assert kinds(c.cross_month_groups(b, j, CONFIG)) == [("cross_month_total", 2, 2)]


@pytest.mark.parametrize("held", [1000, 2])
def test_band_pairs_of_copies(spark, monkeypatch, held):
    """Copies meet as one class in a cell, and all their pairs are there, also those of rows without an id."""
    monkeypatch.setattr(c, "CLASS_ROWS", held)
    rng = random.Random(13)
    rows = [(f"2024-0{rng.randint(1, 3)}-{rng.randint(10, 28)}", rng.choice([-1, 1]) * rng.randint(1, 12) * 1_000) for _ in range(25)]
    b = ledger(spark, rows * 5)
    j = ledger(spark, rows[5:] * 7, "journal").withColumn("rec_id", F.expr("nullif(rec_id, 11)"))
    got = sorted(map(str, c.band_pairs(b, j, CONFIG).collect()))
    want = c.band_join(b, j, CONFIG).select("b_rec_id", "j_rec_id", "gap", "days")
    assert len(got) > 500 and any("j_rec_id=None" in x for x in got) and got == sorted(map(str, want.collect()))
    if held == 1000:
        assert c._classes(b).count() == len(set(rows))


def test_opposite_signs_never_match(spark):
    b, j = ledger(spark, [("2024-01-05", 100, "手续费")]), ledger(spark, [("2024-01-05", -100, "手续费")], "journal")
    found, _ = reconcile.generated(b, j, CONFIG)
    assert found.count() == 0


def test_runs_of_equal_summaries(spark):
    b = ledger(spark, [("2024-01-05", 10, "项目甲"), ("2024-01-06", 20, "项目甲"), ("2024-01-06", 5, "其他"), ("2024-01-07", 7, "项目甲")])
    j = ledger(spark, [("2024-01-08", 30, "项目甲")], "journal")
    assert kinds(c.island_groups(b, j, CONFIG)) == [("continuous_summary_group", 2, 1)]


def test_exact_beats_far_and_ambiguity_is_seen(spark):
    b = ledger(spark, [("2024-01-05", 100, "甲"), ("2024-01-05", 100, "乙")])
    j = ledger(spark, [("2024-01-05", 100, "甲"), ("2024-01-05", 100, "乙")], "journal")
    done = reconcile.reconcile(b, j, subsets=False)
    rows = done.candidates.where("ctype = 'exact_1to1'").collect()
    assert len(rows) == 4 and all(r["ambiguous"] for r in rows)


def test_selection_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    rows, member_rows = [], []
    for i in range(150):
        records = {("B", rng.randrange(40)) for _ in range(rng.randint(1, 3))} | {("J", rng.randrange(40)) for _ in range(rng.randint(1, 3))}
        bs, js = sorted(r for s, r in records if s == "B"), sorted(r for s, r in records if s == "J")
        rows.append((f"c{i}", rng.randint(0, 5) * 10, rng.randrange(3), 0, len(bs), len(js), bs[0], js[0]))
        member_rows += [(f"c{i}", s, r) for s, r in records]
    found = spark.createDataFrame(rows, "candidate_id string, score int, diff_li long, span int, b_n long, j_n long, b_min long, j_min long")
    members = spark.createDataFrame(member_rows, "candidate_id string, side string, rec_id long")
    own = {}
    for cid, s, r in member_rows:
        own.setdefault(cid, set()).add((s, r))
    used, want = set(), []
    for row in sorted(rows, key=lambda x: (-x[1], x[2], x[3], x[4] + x[5], x[6], x[7], x[0])):
        if not own[row[0]] & used:
            used |= own[row[0]]
            want.append(row[0])
    assert sorted(r[0] for r in selection.select(found, members).collect()) == sorted(want)
    parts = {r["candidate_id"]: r["component"] for r in selection.components(found, members).collect()}
    for a, b in itertools.combinations(own, 2):
        if own[a] & own[b]:
            assert parts[a] == parts[b]


def test_pools_over_the_limit_go_to_review(spark):
    b = ledger(spark, [(f"2024-01-{d:02}", 5000) for d in range(1, 22)])
    j = ledger(spark, [(f"2024-01-{d:02}", 1) for d in range(1, 22)], "journal")
    rows = [(f"c{i}", 50_000_000, 0, 10_000, 0, 49_990_000, 49_990_000, 0, 50_000_000, datetime.date(2024, 1, 1 + i), "trivial_difference", "x") for i in range(21)]
    chosen = spark.createDataFrame(rows, "candidate_id string, b_income long, b_expense long, j_income long, j_expense long, diff_li long, income_diff long, expense_diff long, group_li long, last_date date, route_reason string, status string")
    found = pools.pools(pools.components(chosen, CONFIG), CONFIG).collect()
    assert [(r["n"], r["total_li"], r["over"]) for r in found] == [(21, 1_049_790_000, True)]
    assert pools.applied(chosen, CONFIG).where("over_pool and status = '待人工复核'").count() == 21
    at_limit = chosen.limit(20).withColumn("income_diff", F.lit(50_000_000).cast("long")).withColumn("diff_li", F.lit(50_000_000).cast("long"))
    assert not pools.pools(pools.components(at_limit, CONFIG), CONFIG).first()["over"]
    assert b.count() == j.count() == 21


def test_balances(spark):
    rows = [("2024-01-05", 1000, "", 110000), ("2024-01-10", -3000, "", 107000), ("2024-01-15", 50, ""), ("2024-01-20", -200, "", 106900)]
    side = ledger(spark, rows)
    got = balances.continuity(side).collect()
    assert [(str(r["date"]), r["expected_li"], r["stated_li"]) for r in got] == [("2024-01-20", 1_068_500_000, 1_069_000_000)]
    assert balances.opening_balance(side).first()["opening_li"] == 1_090_000_000
    raw = spark.createDataFrame([(1, "x", "月初余额 转入", ""), (2, "", "上年 月初余额", "5.00"), (3, "2024-01-05", "月初余额", "7")], "__source_row__ long, d string, s string, b string")
    assert balances.opening_balance(side, balances.stated_opening(raw, "d", "s", "b")).first()["opening_li"] == 50_000
    assert balances.opening_balance(side, balances.stated_opening(raw.where("__source_row__ <> 2"), "d", "s", "b")).first()["opening_li"] == 1_090_000_000
    assert balances.running(side, 10).count() == 16
    assert balances.opening_balance(side.limit(0)).collect() == [(None,)]


def brute(items, target, most):
    for n in range(1, most + 1):
        for pick in itertools.combinations(range(len(items)), n):
            if sum(items[i] for i in pick) == target:
                return n
    return None


def test_subset_solvers():
    assert subset_sum.depth_first([5000, 4000, 3000], 12000, 3) == [0, 1, 2]
    halves = subset_sum.Halves([5000, 4000, 3000, 2000, 1000], 5)
    assert len(halves.exact(10000, 5)) == brute([5000, 4000, 3000, 2000, 1000], 10000, 5)
    assert subset_sum.depth_first([10000, 5000, 3000, -2000], 8000, 4) is not None
    assert subset_sum.greedy([4, 3, 2], 5, 3, 5, 42) is not None and subset_sum.greedy([5000, 2000], 6000, 2, 3, 0) is None
    rng = random.Random(2)
    for k in range(120):
        low = -40 if k % 3 == 0 else 1
        items = sorted((rng.randint(low, 60) for _ in range(rng.randint(2, 12))), key=abs, reverse=True)
        target, most = rng.randint(1, 200), rng.randint(2, 5)
        found, exact = subset_sum.depth_first(items, target, most), subset_sum.Halves(items, most).exact(target, most)
        near = subset_sum.Halves(items, most).near(target, most, 10)
        picks = [(abs(sum(items[i] for i in p) - target), n, list(p)) for n in range(1, most + 1) for p in itertools.combinations(range(len(items)), n)]
        first = min((p for p in picks if p[0] == 0), default=None)
        assert exact == (first[2] if first else None) and (first is None or low < 0 or found is not None) and (found is None or sum(items[i] for i in found) == target)
        best = min((p for p in picks if p[0] <= 10 and p[1] >= 2), default=None)
        assert near == (best[2] if best else None)
    many = [1000 - i for i in range(100)]
    assert subset_sum.Halves(many, 2).exact(1000 + 901, 2) == [0, 99] and subset_sum.Halves([7] * 70, 2).exact(14, 2) == [0, 1]


def test_near_subset_is_a_candidate(spark):
    b = ledger(spark, [("2024-01-05", 50000)])
    j = ledger(spark, [("2024-01-06", 20000), ("2024-01-07", 20000), ("2024-01-08", 9900)], "journal")
    found, sets = subset_sum.subset_groups(b, j, CONFIG)
    row = found.first()
    assert (row["b_n"], row["j_n"], row["j_income"]) == (1, 3, 499_000_000) and sets.count() == 3
    one = ledger(spark, [("2024-01-06", 50000), ("2024-01-07", 25000), ("2024-01-08", 25000)], "journal")
    assert subset_sum.solutions(b, one, CONFIG).count() == 0  # a single row already matches


def test_copies_take_no_other_amounts_place_in_subsets(spark):
    """Three equal bank rows, each of two journal rows of their own, where two amounts are on offer."""
    b = ledger(spark, [("2024-01-05", 100000)] * 3)
    j = ledger(spark, [("2024-01-06", 70000)] * 3 + [("2024-01-07", 30000)] * 3, "journal")
    found = subset_sum.solutions(b, j, ReconConfig(max_candidates=2)).collect()
    assert {r["rec_id"]: r["ids"] for r in found} == {0: [0, 3], 1: [1, 4], 2: [2, 5]}
    assert {(*r["lis"], r["first"].day, r["last"].day) for r in found} == {(700_000_000, 300_000_000, 6, 7)}
    # an amount is taken twice, and rows are taken anew after the last
    assert subset_sum.solve([70, 30], [3, 3], 140, ReconConfig(max_candidates=2, clearly_trivial_threshold=Decimal(0))) == [70, 70]
    again = subset_sum.solutions(b, ledger(spark, [("2024-01-06", 50000)] * 4, "journal"), CONFIG).collect()
    assert {r["rec_id"]: r["ids"] for r in again} == {0: [0, 1], 1: [2, 3], 2: [0, 1]}


def test_texts_of_copies_are_compared_once(spark, monkeypatch):
    """Pairs are formed between classes of equal rows, and each bank row still has its best ones."""
    formed, local = [], c._local
    monkeypatch.setattr(c, "_local", lambda joined: formed.append(joined.count()) or local(joined))
    b = ledger(spark, [("2024-01-05", 100, "abc")] * 4)
    j = ledger(spark, [("2024-01-05", 100, "abc")] * 5 + [("2024-01-06", 100, "abd")] * 5 + [("2024-01-06", 100, "abc")], "journal")
    config = ReconConfig(max_candidates=3)
    exact = sorted((r["b_min"], r["j_min"]) for r in c.exact_pairs(b, j, config).collect())
    near = sorted((r["b_min"], r["j_min"]) for r in c.tolerance_pairs(b, j, config).collect())
    assert exact == [(x, y) for x in range(4) for y in range(3)]
    assert near == [(x, y) for x in range(4) for y in (5, 6, 10)]
    assert formed == [1, 2]


@pytest.mark.parametrize(("k", "yuan", "days", "step"), [(3, "5000", 31, 1), (30, "5000", 31, 64), (2, "0", 0, 1), (4, "7.5", 2, 2)])
def test_nearest_pairs_are_those_of_the_joins(spark, monkeypatch, k, yuan, days, step):
    """The pairs, their ambiguity and their components, as the joins over all pairs give them; pairs are not all formed."""
    monkeypatch.setattr(nearest, "STEP", step)
    monkeypatch.setattr(nearest, "AT_ONCE", 50)
    config, rng = ReconConfig(max_candidates=k, clearly_trivial_threshold=Decimal(yuan), tolerance_days=days), random.Random(k)
    row = lambda: (f"2024-{rng.randint(1, 4):02}-{rng.randint(1, 28):02}", rng.choice([-1, 1]) * rng.choice([0, 10, 10, 17.5, 20, 3000, 9000, 70_000, rng.randint(1, 60_000)]))
    b, j = ledger(spark, [row() for _ in range(150)] + [(None, 5)]), ledger(spark, [row() for _ in range(170)], "journal")
    want = c.exact_pairs(b, j, config, scored=False).unionByName(c.tolerance_pairs(b, j, config, scored=False))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s.lower()}_min").alias("rec_id")) for s in "BJ"])
    members = want.select("candidate_id", F.explode(sides).alias("m")).select("candidate_id", "m.*")
    rows = selection.ambiguity(want, members)
    got = nearest.with_ambiguity(b, j, config).select(rows.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and got.count() > 0
    parts = selection.components(want, members).groupBy("component").agg(F.count("*").alias("n"))
    assert sorted(nearest.component_sizes(b, j, config).collect()) == sorted(parts.collect())


RAW = "__source_row__ long, __file_row__ long, `日期` string, `金额` string, `方向` string, `摘要` string"


def test_standardize(spark):
    raw = spark.createDataFrame(
        [
            (1, 2, "2024-01-05", "1,000.00", "贷", "货款"), (2, 3, None, "5", "借", "续"), (3, 4, "本月合计", "1", "贷", "合计"), (4, 5, "x", "1", "贷", "a"),
            (5, 6, "2024-01-06", "abc", "贷", "b"), (6, 7, "2024-01-07", "3", "?", "c"), (7, 8, "2024-01-08", "4", "贷", "=d"), (8, 9, None, None, None, None), (9, 10, "2024-01-09", "(7)", "贷", "e"),
        ],
        RAW,
    )
    mapping = standardize.ColumnMapping(date="日期", amount="金额", direction="方向", summary="摘要", mode="single_amount_with_direction")
    out, errors = standardize.standardize(raw, mapping, "bank")
    got = [(r["original_idx"], str(r["date"]), r["amount"], r["summary"]) for r in out.orderBy("original_idx").collect()]
    assert got == [(1, "2024-01-05", Decimal("1000.00"), "货款"), (2, "2024-01-05", Decimal("-5.00"), "续"), (7, "2024-01-08", Decimal("4.00"), "'=d"), (9, "2024-01-09", Decimal("7.00"), "e")]
    assert {r["kind"]: r["n"] for r in standardize.error_counts(errors).collect()} == {"被丢弃的汇总行": 1, "日期解析失败": 1, "金额解析失败": 1, "方向解析失败": 1, "空日期行": 1}
    bad = raw.withColumn("金额", F.lit("abc"))
    with pytest.raises(standardize.TooManyBadAmounts):
        standardize.standardize(bad, mapping, "bank")
    with pytest.raises(ValueError):
        standardize.standardize(raw, standardize.ColumnMapping(date="日期", mode="debit_credit"), "bank")
    assert standardize.standardize(raw.limit(0), mapping, "bank")[0].count() == 0


def test_debit_and_credit_depend_on_the_side(spark):
    raw = spark.createDataFrame([(1, 2, "2024-01-05", "10", None), (2, 3, "2024-01-05", None, "4")], "__source_row__ long, __file_row__ long, `日期` string, `借方` string, `贷方` string")
    mapping = standardize.ColumnMapping(date="日期", debit="借方", credit="贷方", mode="debit_credit")
    sums = {s: [r["amount_li"] for r in standardize.standardize(raw, mapping, s)[0].orderBy("original_idx").collect()] for s in ("bank", "journal")}
    assert sums == {"bank": [-100_000, 40_000], "journal": [100_000, -40_000]}


def test_headers():
    rows = [["对账单", None, None, None, None], ["日期", "发生额", "发生额", "辅助信息", "辅助信息"], ["日期", "借方", "贷方", "摘要", "对方户名"], ["2024-01-05", "1", None, "货款", "甲"], ["2024-01-06", None, "2", "货款", "乙"]]
    found = headers.detect(rows)
    assert (found.skiprows, found.header_rows) == (1, 2)
    assert list(found.columns) == ["日期", "发生额｜借方", "发生额｜贷方", "辅助信息｜摘要", "辅助信息｜对方户名"]
    assert headers.deduplicated(["金额", "金额", "a"]) == ["金额", "金额_2", "a"] and headers.flatten([["", "x"]]) == ["第1列", "x"]
    mapping = headers.auto_mapping(list(found.columns))
    assert mapping.mode == "debit_credit" and mapping.auxiliary == ("辅助信息｜摘要", "辅助信息｜对方户名")
    with pytest.raises(ValueError):
        headers.derive(rows, 4, 3)


def test_files(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    path.write_bytes("日期,金额,摘要\n2024-01-05,5,货款\n\n2024-01-06,6,\n".encode("gbk"))
    out = files.load(spark, str(path))
    assert [tuple(r) for r in out.collect()] == [(1, 2, "2024-01-05", "5", "货款"), (2, 4, "2024-01-06", "6", None)]
    whole = [tuple(r) for r in out.collect()]
    monkeypatch.setattr(files, "LARGE", 1 << 20)
    structure = files.structure_of(str(path))
    assert [tuple(r) for r in files.load_large_csv(spark, str(path), list(structure.columns), 1, "gbk").orderBy("__source_row__").collect()] == whole
    monkeypatch.setattr(files, "LARGE", 1)
    (tmp_path / "big.csv").write_text("日期,金额,摘要\r\n2024-01-05,\"1,000\",甲\r\n\r\n2024-01-06,2,\r\n", encoding="utf-8-sig")
    rows = files.load(spark, str(tmp_path / "big.csv"), structure).orderBy("__source_row__").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "2024-01-05", "1,000", "甲"), (2, 4, "2024-01-06", "2", None)]
    with pytest.raises(FileNotFoundError):
        files.check(str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        files.check(str(tmp_path))
    book = tmp_path / "b.xlsx"
    table = spark.createDataFrame([("2024-01-05", "=1", 2.5)], "`日期` string, `摘要` string, `金额` double")
    sinks.write_xlsx({"明细": table}, str(book))
    again = files.load(spark, str(book)).first()
    assert (again["日期"], again["摘要"], again["金额"]) == ("2024-01-05", "'=1", "2.5")
    sinks.write_tables({"t": table}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 1


def test_precheck(spark, tmp_path):
    def side(rows):
        raw = spark.createDataFrame([(i + 1, i + 2, *r) for i, r in enumerate(rows)], "__source_row__ long, __file_row__ long, `日期` string, `金额` string, `摘要` string")
        mapping = standardize.ColumnMapping(date="日期", amount="金额", summary="摘要", auxiliary=("摘要",))
        out, errors = standardize.standardize(raw, mapping, "bank")
        return {"path": "x", "mapping": mapping, "raw": raw, "ledger": out, "errors": errors}

    good = side([("2024-01-05", "5", "a"), ("2024-01-06", "-5", "b"), ("合计", "0", None), (None, None, None)])
    items = precheck.checks(spark, {"bank": good, "journal": good})
    status = {r["item"]: r["status"] for r in items.collect()}
    assert len(status) == 8 and status["收支合计"] == "通过" and status["非交易行"] == "提示" and status["辅助列完整度"] == "通过"
    precheck.require(items)
    other = side([("x", "5", None)])
    with pytest.raises(precheck.Blocked):
        precheck.require(precheck.checks(spark, {"bank": good, "journal": other}))


def _request(rows):
    return [(c, f"k{c}", i, datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), 10_000, 20_000, {"摘要": "tel 13800138000", "账号": "1"}, {"备注": " ", "帐号": "2"}) for c, i in rows]


def test_semantic_decisions_are_checked_and_recorded(spark):
    fields = "component string, candidate_id string, __place int, first_date date, last_date date, b_gross long, j_gross long, b_fields map<string,string>, j_fields map<string,string>"
    rows = spark.createDataFrame(_request([("a", 1), ("b", 1), ("c", 1), ("d", 1)]), fields)

    def scorer(request):
        (own,) = request["candidates"]
        if own["candidate_id"] == "ka":
            raise RuntimeError("no answer")
        assert own["bank_fields"] == {"摘要": "tel ********"} and own["journal_fields"] == {} and own["local_signals"] == ["账号:不同"]
        good = {k: "" for k in semantic.REPLY_KEYS} | {"selected_candidate_id": own["candidate_id"], "semantic_score": 80, "supporting_evidence": [], "conflicting_evidence": []}
        if own["candidate_id"] == "kb" and "problem" not in request:
            return good | {"semantic_score": "80"}
        if own["candidate_id"] == "kc":
            return good | {"selected_candidate_id": "other"}
        return "```json\n" + json.dumps(good) + "\n```"

    got = {r["component"]: r for r in semantic.numbered(semantic.decisions(rows, scorer)).collect()}
    assert {k: r["fallback"] for k, r in got.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert got["a"]["error"] == "no answer" and "not asked about" in got["c"]["error"] and got["b"]["semantic_score"] == 80 and got["c"]["selected"] is None
    assert [got[k]["request_id"] for k in "abcd"] == ["LLM000001", "LLM000002", "LLM000003", "LLM000004"] and "本机敏感字段一致性信号" in got["d"]["sent_fields"]
    for bad in ("x", "[]", "{}"):
        with pytest.raises(semantic.BadReply):
            semantic.checked(bad, ["k"])


def test_ambiguity_compares_sets_of_records(spark):
    """The day's total and the combination of the same records are one option, whatever they are called."""
    bank, journal = ledger(spark, [("2024-01-05", 30_000)]), ledger(spark, [("2024-01-05", 10_000), ("2024-01-05", 20_000)], "journal")
    found, members = reconcile.generated(bank, journal, CONFIG)
    got = {r["ctype"]: r["ambiguous"] for r in selection.ambiguity(found, members).collect()}
    assert got["combination_dfs"] is False and got["daily_total"] is False
    other = ledger(spark, [("2024-01-05", 10_000), ("2024-01-05", 20_000), ("2024-01-06", 30_000)], "journal")
    found, members = reconcile.generated(bank, other, CONFIG)
    got = {(r["ctype"], r["j_n"]): r["ambiguous"] for r in selection.ambiguity(found, members).collect()}
    assert got["tolerance_date", 1] is True


def test_streamed_days(spark, tmp_path):
    from tallyspark.streaming import daily

    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5), "a", 1.5), (datetime.datetime(2024, 1, 1, 6), "a", 2.0), (datetime.datetime(2024, 1, 2), "b", 1.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(tuple(r) for r in daily.event_days(spark, str(tmp_path)).collect()) == [("2024-01-01", "a", 2, 350), ("2024-01-02", "b", 1, 100)]
    for day in (12, 30):  # later rows close the days before the watermark
        spark.createDataFrame([(datetime.datetime(2024, 1, day), "c", 1.0)], rows.schema).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        query = daily.start(daily.stream_of(spark, str(tmp_path)), str(tmp_path / "out"), availableNow=True)
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/days")).collect())
    assert got[:2] == [("2024-01-01", "a", 2, 350), ("2024-01-02", "b", 1, 100)]

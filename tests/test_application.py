"""Two files in, report tables out."""

import dataclasses

import pytest

from tallyspark.operators import precheck
from tallyspark.operators.standardize import ColumnMapping
from tallyspark.plans import application
from tallyspark.sources import files, sinks


def write(path, rows):
    path.write_text("对账单\n日期,金额,方向,摘要\n" + "\n".join(",".join(r) for r in rows) + "\n", encoding="utf-8-sig")
    return application.Input(str(path), skiprows=1, header_rows=1)  # 借 and 贷 in the rows below speak for a deeper header


def test_files_to_tables(spark, tmp_path):
    bank = [("2024-01-05", "1,000.00".replace(",", ""), "贷", "货款甲"), ("2024-01-06", "50000", "借", "采购乙"), ("2024-01-08", "77", "贷", "零星"), ("2024-01-09", "x", "贷", "坏"), ("合计", "1", "贷", "合计")]
    journal = [("2024-01-05", "1000", "借", "货款甲"), ("2024-01-06", "20000", "贷", "采购乙"), ("2024-01-07", "30000", "贷", "采购乙"), ("2024-01-20", "4", "借", "其他")]
    got = application.run(spark, write(tmp_path / "b.csv", bank), write(tmp_path / "j.csv", journal))
    detail = got["匹配明细"]
    groups = {r["类型"]: (r["银行笔数"], r["日记账笔数"]) for r in detail.collect()}
    assert groups["精确一对一"] == (1, 1) and (1, 2) in groups.values()
    assert len(detail.columns) == 35 and [r["最早日期"] for r in detail.collect()] == sorted(r["最早日期"] for r in detail.collect())
    exact = detail.where("`类型` = '精确一对一'").first()
    assert exact["银行合计"] == 1000 and exact["处理原因"] in ("金额完全一致", "候选歧义") and exact["银_日期"] == exact["账_日期"]
    parts = got["匹配组成明细"]
    assert parts.count() >= 5 and len(parts.columns) == 12 and {r["来源"] for r in parts.collect()} == {"银行流水", "日记账"}
    assert parts.where("`来源` = '银行流水'").first()["辅助文字"].startswith('{"摘要": "')
    assert got["运行参数"].count() == 13
    assert {r["kind"] for r in got["解析异常明细"].collect()} == {"金额解析失败", "被丢弃的汇总行"}
    assert {r["摘要"] for r in got["日记账未达"].collect()} | {r["摘要"] for r in got["银行未达"].collect()} <= {"零星", "其他"}
    figures = {r["item"]: r["value"] for r in got["核对汇总"].collect()}
    assert got["输入预检查"].count() == 8 and figures["匹配组数"] >= 2 and figures["银行流水总笔数"] == 3 and figures["日记账支出金额"] == -50000
    assert figures["银行已找到候选笔数"] + figures["银行未找到候选笔数"] == 3 and figures["大模型辅助"] == 0 and len(figures) >= 44
    review = got["待人工复核"]
    assert len(review.columns) == 34 and {r["复核结论"] for r in review.collect()} <= {"暂不处理"} and len(got["明显微小错报"].columns) == 9
    sinks.write_xlsx({k: got[k] for k in ("核对汇总", "匹配明细", "银行未达")}, str(tmp_path / "r.xlsx"))
    assert files.xlsx_rows(str(tmp_path / "r.xlsx"))[0][:2] == ["item", "value"]


def test_review_rows_hold_all_evidence(spark, tmp_path):
    bank = [("2024-01-05", "300000", "贷", "大额")]
    journal = [("2024-01-05", "100000", "借", "大额一"), ("2024-01-05", "200000", "借", "大额二")]
    got = application.run(spark, write(tmp_path / "b.csv", bank), write(tmp_path / "j.csv", journal))
    (row,) = got["待人工复核"].collect()
    assert (row["银行原文件行号"], row["日记账原文件行号"]) == ("3", "3；4") and row["日记账逐笔金额"] == "100000.0；200000.0"
    assert row["日记账摘要"] == "大额一；大额二" and row["日记账日期"] == "2024-01-05；2024-01-05" and row["日记账金额"] == 300000
    assert row["重要性规则"] == "超过实际执行重要性水平" and row["原因"] == "匹配组金额超过实际执行重要性水平" and row["组成数量"] == 3
    assert row["日记账辅助文字"] == '{"摘要": "大额一"}；{"摘要": "大额二"}'


def test_stated_opening_balances(spark, tmp_path):
    def side(name, first):
        path = tmp_path / name
        path.write_text(f"日期,金额,摘要,余额\n,,上期结转,{first}\n2024-01-05,10,甲,{first + 10}\n2024-01-06,5,乙,{first + 15}\n", encoding="utf-8")
        return application.Input(str(path))

    got = application.run(spark, side("b.csv", 100), side("j.csv", 90))
    assert tuple(got["期初余额"].first()) == (1_000_000, 900_000, True)
    figures = {r["item"]: r["value"] for r in got["核对汇总"].collect()}
    assert figures["期初余额差额"] == 10 and figures["期初余额状态"] == 1


def test_dates_apart_warn_and_missing_ones_block(spark, tmp_path):
    a = write(tmp_path / "b.csv", [("2024-01-05", "10", "贷", "a"), ("2024-01-06", "10", "贷", "a")])
    b = write(tmp_path / "j.csv", [("2025-01-05", "10", "借", "a"), ("2025-01-06", "10", "借", "a")])
    with pytest.raises(precheck.Blocked):
        application.run(spark, a, b, warned=lambda items: "两侧日期无重叠" not in [r["detail"] for r in items.collect()])
    c = write(tmp_path / "c.csv", [("x", "10", "借", "a"), ("y", "10", "借", "a")])
    with pytest.raises(precheck.Blocked, match="日期范围"):
        application.run(spark, a, c)
    unknown = write(tmp_path / "d.csv", [("2024-01-05", "10", "借", "a"), ("2024-01-06", "10", "?", "a")])
    with pytest.raises(precheck.Blocked, match="方向"):
        application.run(spark, a, unknown)
    with pytest.raises(precheck.Blocked, match="必需列"):
        application.run(spark, dataclasses.replace(a, mapping=ColumnMapping(date="日期", amount="没有")), b)


def test_semantic_scorer_changes_the_choice(spark, tmp_path):
    a = write(tmp_path / "b.csv", [("2024-01-05", "10", "贷", "甲"), ("2024-01-05", "10", "贷", "乙")])
    b = write(tmp_path / "j.csv", [("2024-01-05", "10", "借", "丙"), ("2024-01-05", "10", "借", "丁")])

    def scorer(request):
        chosen = next(c["candidate_id"] for c in request["candidates"] if c["candidate_id"].startswith("exact") and c["candidate_id"].endswith("B:0|J:1"))
        said = {"reason": "same account 6222021234567890", "supporting_evidence": ["a"], "conflicting_evidence": [], "uncertainty": "", "suggested_status": "自动确认"}
        return said | {"selected_candidate_id": chosen, "semantic_score": 100}

    got = application.run(spark, a, b, scorer=scorer)
    pairs = {r["候选ID"]: r["是否使用大模型"] for r in got["匹配明细"].collect()}
    assert pairs["exact_1to1|B:0|J:1"] == "是" and pairs["exact_1to1|B:1|J:0"] == "否"
    asked = got["大模型辅助明细"].collect()
    assert 1 <= len(asked) <= 5 and {r["请求ID"] for r in asked} == {"LLM000001"} and sum(r["是否模型选择"] == "是" for r in asked) == 1
    assert all("6222021234567890" not in r["判断理由"] and r["实际发送字段"] == "摘要；日期；金额" and r["是否降级"] == "否" for r in asked)
    figures = {r["item"]: r["value"] for r in got["核对汇总"].collect()}
    assert figures["大模型成功次数"] == 1 and figures["大模型降级次数"] == 0 and figures["大模型辅助"] == 1

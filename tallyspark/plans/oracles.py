"""DuckDB SQL of the ledger queries."""

from __future__ import annotations

from tallyspark.plans import fixtures

INC, EXP = "CASE WHEN amount_li > 0 THEN amount_li ELSE 0 END", "CASE WHEN amount_li < 0 THEN -amount_li ELSE 0 END"


#: All orders, as the queries on cells read them.
_CELLS = """WITH o AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_mktsegment AS segment, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _daily(side: str) -> str:
    return f"""SELECT date, count(*) AS {side}_rows, count(*) FILTER (WHERE amount_li > 0) AS {side}_income_n, CAST(sum({INC}) AS BIGINT) AS {side}_income_li,
      count(*) FILTER (WHERE amount_li < 0) AS {side}_expense_n, CAST(sum({EXP}) AS BIGINT) AS {side}_expense_li, CAST(sum(amount_li) AS BIGINT) AS {side}_net_li,
      arg_max(balance_li, original_idx) FILTER (WHERE balance_li IS NOT NULL) AS {side}_balance_li FROM {side} GROUP BY date"""


_COUNTED = ["rows", "income_n", "income_li", "expense_n", "expense_li", "net_li"]
_DAYS = f"""WITH {fixtures.SQL}, b AS ({_daily('bank')}), j AS ({_daily('journal')}),
both_ AS (SELECT * FROM b FULL OUTER JOIN j USING (date)),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM both_),
table_ AS (
  SELECT date, {', '.join(f'coalesce({s}_{x}, 0) AS {s}_{x}' for s in ('bank', 'journal') for x in _COUNTED)},
    {', '.join(f'last_value({s}_balance_li IGNORE NULLS) OVER (ORDER BY date) AS {s}_balance_li' for s in ('bank', 'journal'))}
  FROM days LEFT JOIN both_ USING (date))"""

_PAIRS = f"""WITH {fixtures.SQL},
pairs AS (
  SELECT b.rec_id AS b_min, j.rec_id AS j_min, abs(b.amount_li - j.amount_li) AS gap, abs(date_diff('day', b.date, j.date)) AS days,
         greatest(abs(b.amount_li), abs(j.amount_li)) AS size, greatest(b.date, j.date) AS last_date, b.amount_li AS b_li, j.amount_li AS j_li
  FROM bank b JOIN journal j ON sign(b.amount_li) = sign(j.amount_li) AND abs(b.amount_li - j.amount_li) <= 50000000 AND abs(date_diff('day', b.date, j.date)) <= 31),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY b_min, gap = 0 AND days = 0 ORDER BY gap, days, j_min) AS r FROM pairs),
cand AS (SELECT * FROM kept WHERE r <= 30),
flags AS (
  SELECT *, count(*) OVER (PARTITION BY b_min) > 1 OR count(*) OVER (PARTITION BY j_min) > 1 AS ambiguous FROM cand),
scored AS (
  SELECT *, CASE WHEN gap = 0 THEN 40 ELSE greatest(20, CAST(round_even(40 - 20.0 * gap / 50000000, 0) AS INT)) END AS amount_score,
    CASE WHEN days = 0 THEN 15 WHEN days >= 31 THEN 0 ELSE CAST(round_even(15.0 * (1 - days / 31), 0) AS INT) END AS date_score,
    CASE WHEN ambiguous THEN 10 ELSE 15 END AS s0 FROM flags),
rated AS (
  SELECT *, CASE WHEN ambiguous THEN greatest(s0 - greatest(amount_score + date_score + s0 - 69, 0), 0) ELSE s0 END AS structure_score FROM scored),
final AS (SELECT *, amount_score + date_score + structure_score AS score FROM rated)"""

_KIND = "CASE WHEN gap = 0 AND days = 0 THEN 'exact_1to1' WHEN gap = 0 THEN 'tolerance_date' ELSE 'amount_difference' END"
_ID = f"{_KIND} || '|B:' || b_min || '|J:' || j_min"


def _recursive(query: str) -> str:
    return query.replace("WITH", "WITH RECURSIVE", 1)


#: Labels of records go to their neighbours as long as a smaller one arrives.
_COMPONENTS = f"""{_recursive(_PAIRS)},
ids AS (SELECT {_ID} AS c, 'B' || b_min AS b, 'J' || j_min AS j FROM cand),
edges AS (SELECT b AS x, j AS y FROM ids UNION SELECT j, b FROM ids),
label(node, least) USING KEY (node) AS (
  SELECT node, min(c) FROM (SELECT b AS node, c FROM ids UNION ALL SELECT j, c FROM ids) GROUP BY node
  UNION
  SELECT e.y, min(l.least) FROM label l JOIN edges e ON l.node = e.x JOIN recurring.label r ON r.node = e.y WHERE l.least < r.least GROUP BY e.y)
SELECT least AS component, count(*) AS n FROM ids JOIN label ON node = b GROUP BY least"""

#: In each round the candidates that come first at both of their records are taken (1), and those that share a record with them go (2).
_SELECTED = f"""{_recursive(_PAIRS)},
ranked AS (SELECT row_number() OVER (ORDER BY score DESC, gap, days, b_min, j_min) AS rk, b_min AS b, j_min AS j FROM final),
picked(rk, b, j, state) USING KEY (rk) AS (
  SELECT rk, b, j, 0 FROM ranked
  UNION
  SELECT rk, b, j, CASE WHEN wins THEN 1 ELSE 2 END FROM (
    SELECT *, bool_or(wins) OVER (PARTITION BY b) OR bool_or(wins) OVER (PARTITION BY j) AS settled FROM (
      SELECT *, rk = min(rk) OVER (PARTITION BY b) AND rk = min(rk) OVER (PARTITION BY j) AS wins FROM recurring.picked WHERE state = 0)) WHERE settled)
SELECT format('M{{:06d}}', row_number() OVER (ORDER BY p.rk)) AS match_id, {_ID} AS candidate_id, score, gap AS diff_li, days AS span
FROM picked p JOIN final f ON p.b = f.b_min AND p.j = f.j_min WHERE p.state = 1"""


def _totals(key: str, unit: str) -> str:
    def side(s: str, p: str) -> str:
        return f"""SELECT {key} AS p, count(*) AS {p}_n, CAST(sum({INC}) AS BIGINT) AS {p}_income, CAST(sum({EXP}) AS BIGINT) AS {p}_expense, min(date) AS {p}_first, max(date) AS {p}_last FROM {s} GROUP BY 1"""

    return f"""WITH {fixtures.BALANCED_SQL}, bc AS (SELECT d AS date, sgn * cents * 100 AS amount_li FROM moved), jc AS (SELECT d AS date, amount_li FROM halves), b AS ({side('bc', 'b')}), j AS ({side('jc', 'j')})
SELECT 'B:{unit}:' || b.p AS b_key, b_n, j_n, b_income, b_expense, least(b_first, j_first) AS first_date, greatest(b_last, j_last) AS last_date
FROM b JOIN j ON b.p = j.p AND b_income = j_income AND b_expense = j_expense WHERE NOT (b_n = 1 AND j_n = 1) AND b_income + b_expense > 0"""


def _rules() -> str:
    from tallyspark.operators import candidates as c

    negative = "|".join(c.NEGATIVE_WORDS)
    rows = [
        f"SELECT '{group}_{name}' AS ctype, b.rec_id AS b_rec, j.rec_id AS j_rec, abs(date_diff('day', b.date, j.date)) AS days, {'true' if bonus else 'false'} AS structure_bonus "
        f"FROM bf b JOIN jf j ON b.amount_li = j.amount_li AND abs(date_diff('day', b.date, j.date)) <= {days} "
        f"WHERE regexp_matches(b.note, '{'|'.join(words)}') AND regexp_matches(j.note, '{'|'.join(words)}') "
        f"AND NOT regexp_matches(b.note, '{negative}') AND NOT regexp_matches(j.note, '{negative}')"
        for group, rules, days, bonus in c.RULES
        for name, words in rules.items()
    ]
    return f"""WITH {fixtures.SQL}, bf AS (SELECT *, {fixtures.FEE_WORDS_SQL} AS note FROM bank), jf AS (SELECT *, {fixtures.FEE_WORDS_SQL} AS note FROM journal),
hits AS ({' UNION ALL '.join(rows)}),
top AS (SELECT *, row_number() OVER (PARTITION BY ctype, b_rec ORDER BY days, j_rec) AS r FROM hits)
SELECT ctype, b_rec AS b_min, j_rec AS j_min, structure_bonus FROM top WHERE r <= 30"""


def _islands() -> str:
    def way(many: str, one: str, p: str, q: str) -> str:
        return f"""SELECT r.n AS {p}_n, CAST(1 AS BIGINT) AS {q}_n, r.low AS {p}_min, o.rec_id AS {q}_min, r.li AS b_income, least(r.a, o.date) AS first_date, greatest(r.z, o.date) AS last_date
FROM (SELECT summary, count(*) AS n, min(rec_id) AS low, CAST(sum(amount_li) AS BIGINT) AS li, min(date) AS a, max(date) AS z
      FROM (SELECT *, original_idx - row_number() OVER (PARTITION BY summary ORDER BY original_idx) AS g FROM {many}) GROUP BY summary, g HAVING count(*) >= 2) r
JOIN {one} o ON o.summary = r.summary AND o.amount_li = r.li WHERE date_diff('day', least(r.a, o.date), greatest(r.z, o.date)) <= 31"""

    return f"""WITH {fixtures.RUNS_SQL}, x AS ({way('bank', 'journal', 'b', 'j')}), y AS ({way('journal', 'bank', 'j', 'b')})
SELECT b_n, j_n, b_min, j_min, b_income, first_date, last_date FROM x UNION ALL SELECT b_n, j_n, b_min, j_min, b_income, first_date, last_date FROM y"""


def sql() -> dict[str, str]:
    f = f"WITH {fixtures.SQL}"
    buckets = [(0, 100), (100, 1000), (1000, 10000), (10000, 100000), (100000, None)]
    return {
        "standardize_amounts": f"""{_CELLS} SELECT k, CASE WHEN k % 12 IN (8, 9) THEN NULL WHEN k % 12 = 10 THEN '0.00'
  ELSE CAST(CAST(CASE WHEN k % 12 IN (2, 3, 7) THEN -cents ELSE cents END / 100.0 AS DECIMAL(20, 2)) AS VARCHAR) END AS amount FROM o""",
        "standardize_dates": f"{_CELLS} SELECT k, CASE WHEN k % 11 < 10 THEN CAST(d AS VARCHAR) END AS date FROM o",
        "normalize_text": f"""{_CELLS} SELECT k, CASE k % 6 WHEN 0 THEN lower(segment) WHEN 1 THEN lower(segment) || '有限' WHEN 2 THEN lower(segment)
  WHEN 3 THEN lower(segment || ' ' || priority) WHEN 4 THEN '' ELSE lower(segment) || ' x' END AS norm FROM o""",
        "standardized_columns": f"{f} SELECT row_number() OVER (ORDER BY date, amount_li, original_idx) - 1 AS rec_id, original_idx, date, amount_li FROM journal",
        "standardized_signed": f"""{f}, x AS (SELECT original_idx, amount_li, last_value(CASE WHEN original_idx % 10 <> 1 THEN date END IGNORE NULLS) OVER (ORDER BY original_idx) AS date FROM journal)
SELECT row_number() OVER (ORDER BY date, amount_li, original_idx) - 1 AS rec_id, original_idx, date, amount_li FROM x""",
        "subset_sums": f"""WITH {fixtures.BALANCED_SQL} SELECT k * 10 AS rec_id, sgn * (cents + 1000000000) * 100 AS amount_li, (k * 10) || '+' || (k * 10 + 1) AS ids FROM base WHERE k % 500 = 6""",
        "amount_li": f"{f} SELECT rec_id, amount_li, amount_li / 10000.0 AS yuan FROM bank",
        "standardized_ledger": f"{f} SELECT original_idx, date, amount_li, summary FROM bank",
        "daily_stats": f"{_DAYS} SELECT * FROM table_",
        "monthly_stats": f"""{_DAYS} SELECT strftime(date, '%Y-%m') AS month, {', '.join(f'CAST(sum({s}_{x}) AS BIGINT) AS {s}_{x}' for s in ('bank', 'journal') for x in _COUNTED)},
  {', '.join(f'arg_max({s}_balance_li, date) FILTER (WHERE {s}_balance_li IS NOT NULL) AS {s}_balance_li' for s in ('bank', 'journal'))} FROM table_ GROUP BY 1""",
        "side_totals": f + " UNION ALL ".join(
            f""" SELECT '{s}' AS side, count(*) AS n, CAST(sum(amount_li) AS BIGINT) AS net_li, count(*) FILTER (WHERE amount_li > 0) AS income_n, CAST(sum({INC}) AS BIGINT) AS income_li,
  count(*) FILTER (WHERE amount_li < 0) AS expense_n, CAST(sum({EXP}) AS BIGINT) AS expense_li FROM {s}""" for s in ("bank", "journal")
        ),
        "running_balance": f"""{f}, d AS (SELECT date, CAST(sum(amount_li) AS BIGINT) AS net FROM bank GROUP BY date),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
x AS (SELECT date, coalesce(net, 0) AS net_li, CAST(1000000 + sum(coalesce(net, 0)) OVER (ORDER BY date) AS BIGINT) AS balance_li FROM days LEFT JOIN d USING (date))
SELECT date, net_li, balance_li, balance_li - net_li AS previous_li FROM x""",
        "opening_balance": f"""{f}, first_ AS (SELECT date, original_idx, balance_li FROM bank WHERE balance_li IS NOT NULL ORDER BY date, original_idx LIMIT 1)
SELECT CAST(any_value(first_.balance_li) - sum(amount_li) AS BIGINT) AS opening_li FROM bank, first_ WHERE bank.date < first_.date OR (bank.date = first_.date AND bank.original_idx <= first_.original_idx)""",
        "balance_continuity": f"""{f}, d AS (SELECT date, CAST(sum(amount_li) AS BIGINT) AS net, arg_max(balance_li, original_idx) FILTER (WHERE balance_li IS NOT NULL) AS stated_li FROM bank GROUP BY date),
m AS (SELECT *, sum(net) OVER (ORDER BY date) AS moved FROM d), s AS (SELECT *, lag(stated_li - moved) OVER (ORDER BY date) + moved AS e FROM m WHERE stated_li IS NOT NULL)
SELECT date, CAST(e AS BIGINT) AS expected_li, stated_li, CAST(stated_li - e AS BIGINT) AS off_li FROM s WHERE e IS NOT NULL AND e <> stated_li""",
        "balance_diff": f"""{f}, {', '.join(f'''{p}d AS (SELECT date, sum(amount_li) AS net FROM {s} GROUP BY date),
{p}c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM {p}d),
{p}r AS (SELECT date, CAST(coalesce(net, 0) AS BIGINT) AS {s}_net_li, CAST(sum(coalesce(net, 0)) OVER (ORDER BY date) AS BIGINT) AS {s}_li FROM {p}c LEFT JOIN {p}d USING (date))''' for s, p in (('bank', 'b'), ('journal', 'j')))}
SELECT *, coalesce(bank_li, 0) - coalesce(journal_li, 0) AS diff_li,
  CASE WHEN bank_li IS NULL OR journal_li IS NULL THEN '缺失记录' WHEN bank_net_li = journal_net_li THEN '时间序错误' ELSE '金额错误' END AS kind FROM br FULL OUTER JOIN jr USING (date)""",
        "calendar_days": f"{f} SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bank",
        "exact_1to1": f"""{f}, p AS (SELECT b.rec_id AS b_min, j.rec_id AS j_min, b.date AS first_date, b.amount_li AS li, row_number() OVER (PARTITION BY b.rec_id ORDER BY j.rec_id) AS r
  FROM bank b JOIN journal j ON b.date = j.date AND b.amount_li = j.amount_li)
SELECT b_min, j_min, first_date, CASE WHEN li > 0 THEN li ELSE 0 END AS b_income, CASE WHEN li < 0 THEN -li ELSE 0 END AS b_expense FROM p WHERE r <= 30""",
        "tolerance_band": f"{_PAIRS} SELECT b_min AS b_rec_id, j_min AS j_rec_id, gap, days FROM pairs WHERE gap > 0 OR days > 0",
        "tolerance_top": f"""{f}, p AS (SELECT b.rec_id AS b_min, j.rec_id AS j_min, abs(b.amount_li - j.amount_li) AS gap, abs(date_diff('day', b.date, j.date)) AS days
  FROM bank b JOIN journal j ON sign(b.amount_li) = sign(j.amount_li) AND abs(b.amount_li - j.amount_li) <= 50000000 AND abs(date_diff('day', b.date, j.date)) <= 31),
t AS (SELECT *, row_number() OVER (PARTITION BY b_min ORDER BY gap, days, j_min) AS r FROM p WHERE gap > 0 OR days > 0)
SELECT CASE WHEN gap = 0 THEN 'tolerance_date' ELSE 'amount_difference' END AS ctype, b_min, j_min FROM t WHERE r <= 30""",
        "rule_candidates": _rules(),
        "batch_groups": f"""WITH {fixtures.PAYROLL_SQL}, g AS (SELECT date, amount_li, count(*) AS n FROM bank GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT n AS b_n, -n * g.amount_li AS b_expense, -j.amount_li AS j_expense, least(g.date, j.date) AS first_date, greatest(g.date, j.date) AS last_date, j.rec_id AS j_min
FROM g JOIN journal j ON j.amount_li = n * g.amount_li AND abs(date_diff('day', g.date, j.date)) <= 3""",
        "summary_islands": _islands(),
        "daily_total": _totals("CAST(date AS VARCHAR)", "day"),
        "monthly_total": _totals("strftime(date, '%Y-%m')", "month"),
        "cross_month_total": f"""WITH {fixtures.BALANCED_SQL}, bl AS (SELECT late AS date, sgn * cents * 100 AS amount_li FROM moved), jl AS (SELECT early AS date, amount_li FROM halves),
b AS (SELECT year(date) * 12 + month(date) AS m, count(*) AS b_n, CAST(sum({INC}) AS BIGINT) AS b_income, CAST(sum({EXP}) AS BIGINT) AS b_expense, min(date) AS a, max(date) AS z FROM bl GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT year(date) * 12 + month(date) AS m, count(*) AS j_n, CAST(sum({INC}) AS BIGINT) AS j_income, CAST(sum({EXP}) AS BIGINT) AS j_expense, min(date) AS a, max(date) AS z FROM jl GROUP BY 1 HAVING count(*) > 1)
SELECT 'B:monthno:' || b.m AS b_key, 'J:monthno:' || j.m AS j_key, b_n, j_n, b_income, b_expense, least(b.a, j.a) AS first_date, greatest(b.z, j.z) AS last_date
FROM b JOIN j ON abs(b.m - j.m) = 1 AND b_income = j_income AND b_expense = j_expense WHERE date_diff('day', least(b.a, j.a), greatest(b.z, j.z)) <= 31 AND b_income + b_expense > 0""",
        "group_metrics": f"""{f}, b AS (SELECT date, CAST(sum({INC}) AS BIGINT) AS bi, CAST(sum({EXP}) AS BIGINT) AS be FROM bank GROUP BY date), j AS (SELECT date, CAST(sum({INC}) AS BIGINT) AS ji, CAST(sum({EXP}) AS BIGINT) AS je FROM journal GROUP BY date)
SELECT date, bi + be AS b_gross, ji + je AS j_gross, greatest(bi + be, ji + je) AS group_li, abs(bi - ji) AS income_diff, abs(be - je) AS expense_diff, abs(bi - ji) + abs(be - je) AS diff_li FROM b JOIN j USING (date)""",
        "amount_buckets": f + " SELECT summary, " + ", ".join(
            f"count(*) FILTER (WHERE abs(amount_li) >= {lo * 10000}" + (f" AND abs(amount_li) < {hi * 10000}" if hi else "") + f") AS bucket_{i}" for i, (lo, hi) in enumerate(buckets)
        ) + " FROM bank GROUP BY summary",
        "ambiguity_flags": f"{_PAIRS} SELECT b_min, j_min, ambiguous FROM flags",
        "score_no_text": f"{_PAIRS} SELECT b_min, j_min, amount_score, date_score, structure_score, score FROM final",
        "routing": f"""{_PAIRS}, w AS (SELECT *, CASE WHEN size > 1000000000 THEN 'over_materiality' WHEN ambiguous THEN 'ambiguity' WHEN gap = 0 THEN 'no_difference' ELSE 'trivial_difference' END AS route_reason FROM final)
SELECT b_min, j_min, route_reason, CASE WHEN route_reason IN ('no_difference', 'trivial_difference') THEN '自动确认' ELSE '待人工复核' END AS status FROM w""",
        "select_matches": _SELECTED,
        "side_components": _COMPONENTS,
        "input_checks": f"""{f}, e AS (SELECT 'bank' AS s, min(date) AS a, max(date) AS z, sum({INC}) AS i, sum({EXP}) AS x FROM bank UNION ALL SELECT 'journal', min(date), max(date), sum({INC}), sum({EXP}) FROM journal),
same AS (SELECT count(DISTINCT a) = 1 AND count(DISTINCT z) = 1 AS days, count(DISTINCT i) = 1 AND count(DISTINCT x) = 1 AS sums FROM e)
SELECT item, CASE WHEN item = '日期范围' AND NOT days OR item = '收支合计' AND NOT sums OR item = '非交易行' THEN '提示' ELSE '通过' END AS status
FROM same, (VALUES ('文件'), ('表头结构'), ('日期范围'), ('方向'), ('收支合计'), ('非交易行'), ('必需列'), ('辅助列完整度')) t(item)""",
        "difference_pools": f"""{_PAIRS}, x AS (SELECT strftime(last_date, '%Y-%m') AS month, CASE WHEN b_li > 0 THEN CASE WHEN b_li > j_li THEN '收入银行多' ELSE '收入银行少' END ELSE CASE WHEN b_li < j_li THEN '支出银行多' ELSE '支出银行少' END END AS pool, gap
  FROM final WHERE gap > 0 AND size <= 1000000000)
SELECT month, pool, count(*) AS n, CAST(sum(gap) AS BIGINT) AS total_li, sum(gap) > 1000000000 AS "over" FROM x GROUP BY 1, 2""",
        "unmatched_bank": f"{f} SELECT rec_id, date, amount_li FROM bank b WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j.date = b.date AND j.amount_li = b.amount_li)",
        "unmatched_journal": f"{f} SELECT rec_id, date, amount_li FROM journal j WHERE NOT EXISTS (SELECT 1 FROM bank b WHERE j.date = b.date AND j.amount_li = b.amount_li)",
        "bigram_dice": """WITH t AS (SELECT c_custkey, c_name AS a, 'Customer#' || c_mktsegment AS b FROM customer),
g AS (SELECT c_custkey, list_distinct(list_transform(range(1, length(a)), lambda i: a[i : i + 1])) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i : i + 1])) AS y FROM t)
SELECT c_custkey, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS dice FROM g""",
        "parse_error_counts": f"""{f}, x AS (SELECT CASE WHEN k % 17 = 0 THEN '被丢弃的汇总行' WHEN k % 11 = 0 THEN '日期解析失败' WHEN k % 7 = 0 THEN '金额解析失败' WHEN k % 13 = 0 THEN '方向解析失败' END AS kind
  FROM (SELECT rec_id // 10 AS k FROM bank)) SELECT 'bank' AS source, kind, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY kind""",
        "masked_texts": f"""{_CELLS}, x AS (SELECT k, k % 6 AS v, CAST(k AS VARCHAR) AS t,
    CASE k % 6 WHEN 0 THEN 'Bearer a' || k || '.X-1' WHEN 1 THEN 'k=v&token=t' || k || '&a=1' WHEN 2 THEN 'acct ' || lpad(CAST(k AS VARCHAR), 12, '7') || ' ok'
      WHEN 3 THEN 'https://u:p@host:8443/a/' || k || '?key=1#f' WHEN 4 THEN '=SUM(A' || k || ')' ELSE 'plain ' || k END AS raw FROM o)
SELECT k, CASE v WHEN 0 THEN 'Bearer ***' WHEN 1 THEN 'k=v&token=***&a=1' WHEN 2 THEN 'acct ******** ok' WHEN 3 THEN 'https://u:p@host:8443/a/' || t || '?key=***#f' ELSE raw END AS masked,
  CASE v WHEN 3 THEN 'https://host:8443/a/' || t ELSE '' END AS url, CASE v WHEN 4 THEN '''' || raw ELSE raw END AS cell FROM x""",
        "ledger_labels": f"""{f} SELECT rec_id, strftime(date, '%Y-%m') AS month, CAST(year(date) * 12 + month(date) AS BIGINT) AS month_no,
  CASE WHEN rec_id % 101 >= 85 THEN '高' WHEN rec_id % 101 >= 70 THEN '中' ELSE '低' END AS confidence, CAST(sign(amount_li - rec_id) AS INT) AS compared, rec_id % 101 <= 100 AS same,
  CASE WHEN rec_id % 101 % 3 = 0 THEN '账号' WHEN rec_id % 101 % 3 = 1 THEN '对方户名' END AS category FROM bank""",
        "streaming_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(round(sum(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    }

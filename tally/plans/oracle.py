"""The same results in DuckDB's SQL."""

from __future__ import annotations

_EXPENSE = """expense AS (
  SELECT CAST(o_custkey % 20 AS BIGINT) AS condo_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    l_orderkey * 10 + l_linenumber AS ord, l_orderkey || '-' || l_linenumber AS code,
    p_name || ' - ' || s_name || ' - NF. ' || l_orderkey || CASE WHEN round(l_discount * 100) = 5 THEN ' PARC ' || l_linenumber || '/7' ELSE '' END AS description,
    CAST(CASE WHEN l_quantity = 1 THEN -round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS DECIMAL(18,2)) AS amount,
    p_type AS category, p_type || ' ' || p_brand AS subcategory,
    CASE l_returnflag WHEN 'N' THEN 'ORDINARIA' WHEN 'R' THEN 'FUNDO DE RESERVA' ELSE 'FUNDO DE OBRAS' END AS account,
    s_name AS vendor, l_orderkey AS invoice,
    CASE WHEN round(l_discount * 100) = 5 THEN CAST(l_linenumber AS BIGINT) END AS inst_n,
    CAST(o_orderdate AS DATE) + 30 AS due, CAST(l_shipdate AS DATE) AS paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  CROSS JOIN range(2) AS copies(copy) WHERE copy = 0 OR (l_orderkey * 10 + l_linenumber) % 503 = 0
)"""
_INCOME = """income AS (
  SELECT CAST(o_custkey % 20 AS BIGINT) AS condo_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS ord,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'ORDINARIA' WHEN o_orderpriority LIKE '4%' THEN 'FUNDO DE RESERVA' ELSE 'FUNDO DE OBRAS' END AS account,
    CASE o_orderstatus WHEN 'O' THEN 'COTA' WHEN 'F' THEN 'MULTA' ELSE 'OUTRA' END AS line, line || ' ' || o_orderpriority AS description,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS DECIMAL(18,2)) AS amount,
    CASE o_orderstatus WHEN 'O' THEN 'quota' WHEN 'F' THEN 'fine' ELSE 'other' END AS kind
  FROM orders
)"""
_ACCOUNT = """moved AS (
  SELECT condo_id, month, account, amount AS credit, CAST(0 AS DECIMAL(18,2)) AS debit FROM income
  UNION ALL SELECT condo_id, month, account, 0, amount FROM expense
), sums AS (SELECT condo_id, month, account, sum(credit) AS credits, sum(debit) AS debits FROM moved GROUP BY ALL),
closed AS (SELECT *, sum(credits - debits) OVER (PARTITION BY condo_id, account ORDER BY month) AS closing, year(month) * 12 + month(month) AS no FROM sums),
account AS (
  SELECT condo_id, month, account, credits, debits, closing,
    closing - credits + debits + CASE WHEN (condo_id * 7 + no + length(account)) % 13 = 0 THEN 2500 ELSE 0 END AS opening,
    CASE WHEN account = 'FUNDO DE OBRAS' AND (condo_id + no) % 5 = 0 THEN 0 WHEN (condo_id + no) % 7 = 0 THEN 2 * round(CAST(abs(closing) AS DECIMAL(18,2)) * 0.005, 2)
      ELSE round(CAST(abs(closing) AS DECIMAL(18,2)) * 0.005, 2) END AS yield_amt
  FROM closed
)"""
_ISSUANCE = """issuance AS (
  SELECT condo_id, month, line, round(CAST(sum(abs(amount)) AS DECIMAL(18,2)) * 1.05, 2) AS budget, sum(CASE WHEN kind <> 'quota' THEN abs(amount) ELSE 0 END) AS collected
  FROM income GROUP BY ALL
)"""
_EVIDENCE = """evidence AS (SELECT condo_id, month, code, amount + CASE WHEN ord % 7 = 0 THEN 100 ELSE 0 END AS paid_amount FROM expense WHERE ord % 11 <> 0)"""
_BALANCE = """balance AS (
  SELECT condo_id, month, sum(opening) AS opening, sum(credits) AS credits, sum(debits) AS debits, sum(closing) AS closing, sum(yield_amt) AS yield_amt, count(*) AS accounts
  FROM account GROUP BY ALL
)"""
M = "strftime(month, '%Y-%m') AS month"


def _d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _with(parts: list[str], query: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + query


E, I = [_EXPENSE], [_INCOME]  # noqa: E741
A = [_EXPENSE, _INCOME, _ACCOUNT]
S = [_INCOME, _ISSUANCE]
B = [*A, _BALANCE]
NORM = "trim(regexp_replace(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
BRL = "CASE WHEN amount < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{:,.2f}', CAST(abs(amount) AS DOUBLE)), ',.', '.,')"
CUT = r"regexp_replace(regexp_replace(regexp_replace(upper(description), ' PARC [0-9]/7', ' ', 'g'), ' NF\. [0-9]+', ' ', 'g'), '[0-9]+', ' ', 'g')"
STREAK = """past AS (SELECT b.condo_id, b.month, b.account, list(DISTINCT date_diff('month', p.month, b.month)) AS agos
  FROM below b JOIN below p ON p.condo_id = b.condo_id AND p.account = b.account AND p.month < b.month AND p.month >= b.month - INTERVAL 6 MONTH GROUP BY ALL),
streaks AS (SELECT b.*, coalesce(list_min(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT coalesce(list_contains(agos, x), false))), 7) AS streak
  FROM below b LEFT JOIN past USING (condo_id, month, account))"""
BELOW = "below AS (SELECT condo_id, month, account, closing FROM account WHERE closing < -0.011)"
R1 = "SELECT condo_id, month, trim(regexp_replace(" + NORM.format("description") + ", ' *[0-9]+ *', ' ', 'g')) AS description, sum(amount) AS total, count(*) AS n, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts FROM income WHERE amount < -0.011 GROUP BY 1, 2, 3"
R4 = "SELECT n.condo_id, n.month, n.category, n.total, p.total AS previous_total FROM cats n JOIN cats p ON p.condo_id = n.condo_id AND p.category = n.category AND p.month + INTERVAL 1 MONTH = n.month WHERE p.total > 0.011 AND abs(n.total - p.total) >= 1000 AND CAST(abs(n.total - p.total) AS DOUBLE) / CAST(p.total AS DOUBLE) > 1"
CATS = "cats AS (SELECT condo_id, month, category, sum(amount) AS total FROM expense GROUP BY ALL)"
R9 = "SELECT n.condo_id, n.month, n.account, n.opening, p.closing AS previous_closing, n.opening - p.closing AS gap FROM account n JOIN account p ON p.condo_id = n.condo_id AND p.account = n.account AND p.month + INTERVAL 1 MONTH = n.month WHERE abs(n.opening - p.closing) > 0.02"
A7 = "SELECT condo_id, month, code, count(*) AS n, max(amount) AS amount FROM expense GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT amount) = 1"

SQL = {
    "text_functions": _with(E, r"SELECT DISTINCT code, " + NORM.format("description") + r" AS norm, CAST(invoice AS VARCHAR) AS invoice_no, inst_n AS n, CASE WHEN inst_n IS NOT NULL THEN CAST(7 AS BIGINT) END AS total, " + NORM.format(CUT) + " AS base, " + BRL + " AS brl FROM expense"),
    "f3_parse_brl": _with(E, "SELECT condo_id, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM expense GROUP BY 1"),
    "r1_negative_income": _with(I, f"SELECT * REPLACE (strftime(month, '%Y-%m') AS month, CAST(total AS DOUBLE) AS total) FROM ({R1})"),
    "r4_category_variation": _with([*E, CATS], f"SELECT condo_id, {M}, category, {_d('total', 'previous_total')} FROM ({R4})"),
    "r5_repeated_invoice": _with([*E, "inv AS (SELECT condo_id, month, vendor, invoice, sum(amount) AS total FROM expense WHERE inst_n IS NULL GROUP BY ALL)"], f"SELECT condo_id, {M}, vendor, invoice, {_d('total', 'earlier_total')}, earlier_months FROM (SELECT n.condo_id, n.month, n.vendor, n.invoice, n.total, count(*) AS earlier_months, sum(p.total) AS earlier_total FROM inv n JOIN inv p ON p.condo_id = n.condo_id AND p.vendor = n.vendor AND p.invoice = n.invoice AND p.month < n.month AND p.month >= n.month - INTERVAL 6 MONTH GROUP BY ALL)"),
    "r6_collection_rate": _with([*S, "rates AS (SELECT condo_id, month, sum(budget) AS budget, sum(collected) AS collected, CAST(sum(collected) AS DOUBLE) / CAST(sum(budget) AS DOUBLE) AS rate FROM issuance GROUP BY ALL HAVING sum(budget) > 0)"], f"SELECT n.condo_id, strftime(n.month, '%Y-%m') AS month, CAST(n.budget AS DOUBLE) AS budget, CAST(n.collected AS DOUBLE) AS collected, n.rate, p.rate AS previous_rate FROM rates n LEFT JOIN rates p ON p.condo_id = n.condo_id AND p.month + INTERVAL 1 MONTH = n.month WHERE n.rate < 0.9 OR n.rate > 1"),
    "r7_negative_streak": _with([*A, BELOW, STREAK], f"SELECT condo_id, {M}, account, {_d('closing')}, CAST(streak AS BIGINT) AS streak FROM streaks WHERE streak >= 3"),
    "r9_balance_continuity": _with(A, f"SELECT condo_id, {M}, account, {_d('opening', 'previous_closing', 'gap')} FROM ({R9})"),
    "r10_inter_account_movement": _with(A, f"SELECT condo_id, {M}, account, CAST(opening + credits - debits - closing AS DOUBLE) AS movement FROM account WHERE abs(opening + credits - debits - closing) >= 1000"),
    "r11_disproportionate_yield": _with([*A, "rates AS (SELECT *, CAST(yield_amt AS DOUBLE) / ((CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2) AS rate FROM account WHERE (CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2 > 0.011 AND yield_amt > 0)", "middles AS (SELECT condo_id, month, median(rate) AS middle FROM rates GROUP BY ALL HAVING count(*) >= 2 AND median(rate) > 0)"], f"SELECT condo_id, {M}, account, round(rate, 6) AS rate, round(middle, 6) AS median_rate FROM rates JOIN middles USING (condo_id, month) WHERE abs(rate / middle - 1) > 0.25"),
    "r15_installments_same_month": _with([*E, "series AS (SELECT condo_id, month, vendor, list_sort(list(DISTINCT inst_n)) AS numbers, sum(amount) AS total FROM expense WHERE inst_n IS NOT NULL GROUP BY ALL)"], f"SELECT n.condo_id, strftime(n.month, '%Y-%m') AS month, n.vendor, array_to_string(n.numbers, ',') AS numbers, CAST(n.total AS DOUBLE) AS total FROM series n LEFT JOIN series p ON p.condo_id = n.condo_id AND p.vendor = n.vendor AND p.month + INTERVAL 1 MONTH = n.month WHERE len(n.numbers) >= 2 AND NOT coalesce(list_has_any(n.numbers, p.numbers), false)"),
    "r17_new_category": _with([*E, "subs AS (SELECT condo_id, month, subcategory, sum(amount) AS total, count(*) AS n FROM expense GROUP BY ALL)"], f"SELECT condo_id, {M}, subcategory, {_d('total')}, n FROM subs s WHERE NOT EXISTS (SELECT 1 FROM subs p WHERE p.condo_id = s.condo_id AND p.subcategory = s.subcategory AND p.month < s.month AND p.month >= s.month - INTERVAL 6 MONTH) AND EXISTS (SELECT 1 FROM subs p WHERE p.condo_id = s.condo_id AND p.month < s.month AND p.month >= s.month - INTERVAL 6 MONTH)"),
    "r20_late_payment": _with(E, f"SELECT condo_id, {M}, code, days, CASE WHEN days > 30 THEN 'high' ELSE 'attention' END AS severity FROM (SELECT *, date_diff('day', due + CASE dayofweek(due) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END, paid) AS days FROM expense) WHERE days > 0 AND days <= 120"),
    "g2_round_amount": _with(E, f"SELECT condo_id, {M}, code, {_d('amount')} FROM expense WHERE amount >= 2000 AND CAST(amount * 100 AS BIGINT) % 10000 = 0 AND inst_n IS NULL"),
    "g3_missing_recurrent": _with([*E, "v AS (SELECT condo_id, month, vendor, sum(amount) AS total FROM expense GROUP BY ALL)", "past AS (SELECT condo_id, CAST(month + INTERVAL (ago) MONTH AS DATE) AS month, vendor, count(*) AS n, median(CAST(total AS DOUBLE)) AS usual FROM v, range(1, 4) AS g(ago) GROUP BY 1, 2, 3)"], f"SELECT condo_id, {M}, vendor, round(usual, 2) AS usual FROM past p WHERE n = 3 AND usual >= 500 AND EXISTS (SELECT 1 FROM v WHERE v.condo_id = p.condo_id AND v.month = p.month) AND NOT EXISTS (SELECT 1 FROM v WHERE v.condo_id = p.condo_id AND v.month = p.month AND v.vendor = p.vendor)"),
    "g8_duplicate_in_month": _with(E, f"SELECT condo_id, {M}, {NORM.format('description')} AS description, {_d('amount')}, count(*) AS n FROM expense WHERE amount >= 100 AND inst_n IS NULL GROUP BY ALL HAVING count(*) >= 2"),
    "g10_account_deficit": _with(A, f"SELECT condo_id, {M}, account, CAST(debits - credits AS DOUBLE) AS deficit FROM account WHERE account = 'ORDINARIA' AND debits - credits >= 1000 AND debits - credits > CAST(credits AS DOUBLE) * 0.05"),
    "a1_extraction_check": _with(A, f"SELECT * FROM (SELECT condo_id, {M}, account, CAST(sum(e.amount) AS DOUBLE) AS entries, CAST(any_value(a.debits) AS DOUBLE) AS debits, CAST(sum(e.amount) - any_value(a.debits) AS DOUBLE) AS gap FROM expense e JOIN account a USING (condo_id, month, account) GROUP BY condo_id, e.month, account, strftime(month, '%Y-%m')) WHERE abs(gap) > 0.011"),
    "a6_account_identity": _with(A, f"SELECT condo_id, {M}, account, CAST(opening + credits - debits - closing AS DOUBLE) AS gap FROM account WHERE abs(opening + credits - debits - closing) > 0.05"),
    "a7_duplicate_codes": _with(E, f"SELECT condo_id, {M}, code, n, {_d('amount')} FROM ({A7})"),
    "a16_negative_expense": _with(E, f"SELECT condo_id, {M}, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, CAST(sum(amount) AS DOUBLE) AS total FROM expense WHERE amount < -0.005 GROUP BY ALL"),
    "a18_category_rollup": _with([*E, CATS], f"SELECT condo_id, {M}, category, {_d('total')}, round(CAST(total AS DOUBLE) / nullif(CAST(sum(total) OVER m AS DOUBLE), 0), 6) AS share, row_number() OVER (PARTITION BY condo_id, cats.month ORDER BY total DESC, category) AS rank FROM cats WINDOW m AS (PARTITION BY condo_id, cats.month)"),
    "a19_month_balance": _with(B, f"SELECT condo_id, {M}, {_d('opening', 'credits', 'debits', 'closing', 'yield_amt')}, accounts FROM balance"),
    "j1_pair_by_code": _with([*E, _EVIDENCE], f"SELECT condo_id, {M}, code, {_d('amount', 'paid_amount')}, CASE WHEN paid_amount IS NULL THEN 'missing_evidence' WHEN abs(amount - paid_amount) <= 0.01 THEN 'verified' ELSE 'divergent_amount' END AS type FROM (SELECT condo_id, month, code, max(amount) AS amount FROM expense GROUP BY ALL) LEFT JOIN (SELECT condo_id, month, code, max(paid_amount) AS paid_amount FROM evidence GROUP BY ALL) USING (condo_id, month, code)"),
    "j4_many_to_one": _with([*E, _EVIDENCE], f"SELECT condo_id, {M}, strftime(paid, '%Y-%m-%d') AS paid, account, count(DISTINCT code) AS codes, CAST(sum(amount) AS DOUBLE) AS total FROM expense x WHERE NOT EXISTS (SELECT 1 FROM evidence v WHERE v.condo_id = x.condo_id AND v.month = x.month AND v.code = x.code) GROUP BY ALL HAVING count(DISTINCT code) >= 2"),
    "d2_period_kpis": _with(B, "SELECT condo_id, count(*) AS months, CAST(sum(credits) AS DOUBLE) AS inflow, CAST(sum(debits) AS DOUBLE) AS outflow, CAST(max_by(closing, month) AS DOUBLE) AS last_balance FROM balance GROUP BY 1"),
    "d4_budget_tracking": _with([*S, "m AS (SELECT condo_id, month, sum(budget) AS budget, sum(collected) AS collected FROM issuance GROUP BY ALL)", "c AS (SELECT *, sum(budget) OVER w AS budget_to_date, sum(collected) OVER w AS collected_to_date FROM m WINDOW w AS (PARTITION BY condo_id ORDER BY month))"], f"SELECT condo_id, {M}, {_d('budget', 'collected', 'budget_to_date', 'collected_to_date')}, CASE WHEN collected_to_date - budget_to_date < -50000 THEN 'red' WHEN collected_to_date - budget_to_date < -20000 THEN 'yellow' ELSE 'green' END AS badge FROM c"),
    "d6_account_buckets": _with(A, f"SELECT condo_id, {M}, " + ", ".join(f"CAST(sum(CASE WHEN account = '{k}' AND closing > 0 THEN closing ELSE 0 END) AS DOUBLE) AS {v}" for k, v in (("ORDINARIA", "ordinary"), ("FUNDO DE RESERVA", "reserve"), ("FUNDO DE OBRAS", "works"))) + " FROM account GROUP BY condo_id, account.month"),
    "d9_balance_evolution": _with(B, f"SELECT condo_id, {M}, {_d('closing')}, CAST(closing - lag(closing) OVER (PARTITION BY condo_id ORDER BY balance.month) AS DOUBLE) AS change FROM balance"),
    "d10_snapshot_latest": _with(B, f"SELECT condo_id, strftime(max(month), '%Y-%m') AS last_month, count(*) AS months, " + ", ".join(f"CAST(max_by({c}, month) AS DOUBLE) AS {c}" for c in ("opening", "credits", "debits", "closing")) + " FROM balance GROUP BY 1"),
    "t2_last_import": "SELECT condo_id, event_id, status, imports FROM (SELECT CAST(user_id % 20 AS BIGINT) AS condo_id, event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'warning' END AS status, count(*) OVER (PARTITION BY user_id % 20) AS imports, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "u1_all_findings": _with(
        [*A, CATS, BELOW, STREAK, f"found AS (SELECT condo_id, month, 'negative_income' AS type, 'R1' AS rule, description AS subject, total AS amount FROM ({R1}) UNION ALL SELECT condo_id, month, 'category_variation', 'R4', category, total FROM ({R4}) UNION ALL SELECT condo_id, month, 'negative_balance', 'R7', account, closing FROM streaks WHERE streak >= 3 UNION ALL SELECT condo_id, month, 'balance_continuity', 'R9', account, gap FROM ({R9}) UNION ALL SELECT condo_id, month, 'duplicate', 'A7', code, amount FROM ({A7}))"],
        f"SELECT condo_id, {M}, type, rule, subject, {_d('amount')}, format('RG-{{:04d}}', row_number() OVER (PARTITION BY condo_id, found.month ORDER BY rule, subject, amount)) AS finding_id FROM found",
    ),
}

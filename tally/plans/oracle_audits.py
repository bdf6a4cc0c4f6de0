"""SQL of the audits, and of the operators on business days and vendor history."""

from __future__ import annotations

from tally.functions.calendar import FIXED, FROM_EASTER
from tally.plans.oracle import BELOW, NORM, STREAK, A, B, E, I, M, _d, _with
from tally.plans.oracle_more import PAID_EVIDENCE

RATES = [
    "rates AS (SELECT *, CAST(yield_amt AS DOUBLE) / ((CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2) AS rate FROM account WHERE (CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2 > 0.011 AND yield_amt > 0)",
    "middles AS (SELECT condo_id, month, median(rate) AS middle FROM rates GROUP BY ALL HAVING count(*) >= 2 AND median(rate) > 0)",
    "r11 AS (SELECT DISTINCT condo_id, month FROM rates JOIN middles USING (condo_id, month) WHERE abs(rate / middle - 1) > 0.25)",
]
CALENDAR = [
    "due_days AS (SELECT DISTINCT due, CAST(due + CAST(k AS INTEGER) AS DATE) AS day FROM expense, range(10) AS t(k))",
    "years AS (SELECT DISTINCT year(day) AS y FROM due_days)",
    "e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years)",
    "e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1)",
    "e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2)",
    "e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM e3)",
    "easter AS (SELECT make_date(y, s // 31, s % 31 + 1) AS day FROM e4)",
    "holidays AS (SELECT CAST(y || '-' || d AS DATE) AS day FROM years, (VALUES " + ", ".join(f"('{d}')" for d in FIXED) + ") AS f(d) UNION SELECT CAST(day + CAST(k AS INTEGER) AS DATE) FROM easter, (VALUES " + ", ".join(f"({k})" for k in FROM_EASTER) + ") AS g(k))",
    "business AS (SELECT due, min(day) AS business FROM due_days WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT day FROM holidays) GROUP BY 1)",
]
VENDORS = "v AS (SELECT condo_id, month, vendor, sum(amount) AS total FROM expense GROUP BY ALL)"
KIND = "CASE WHEN regexp_matches(d, 'RENDIMENTO|APLICAC') THEN 'yield' WHEN regexp_matches(d, 'TRANSFER') THEN 'transfer' WHEN regexp_matches(d, 'MULTA|JUROS') THEN 'fine_interest' WHEN regexp_matches(d, 'COTA|TAXA COND') THEN 'quota' ELSE 'other' END"

SQL = {
    "r12_yield_concentrated": _with([*A, *RATES, "m AS (SELECT condo_id, month, count(*) FILTER (WHERE yield_amt > 0.011) AS yielding, round(avg((CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2) FILTER (WHERE yield_amt <= 0.011), 2) AS others, sum(yield_amt) AS total FROM account GROUP BY ALL)"], f"SELECT condo_id, {M}, {_d('others', 'total')} FROM m WHERE yielding = 1 AND others >= 10000 AND NOT EXISTS (SELECT 1 FROM r11 WHERE r11.condo_id = m.condo_id AND r11.month = m.month)"),
    "r20_late_business_days": _with([*E, *CALENDAR], f"SELECT condo_id, {M}, code, strftime(business, '%Y-%m-%d') AS business, date_diff('day', business, paid) AS days, CASE WHEN date_diff('day', business, paid) > 30 THEN 'high' ELSE 'attention' END AS severity FROM expense JOIN business USING (due) WHERE date_diff('day', business, paid) BETWEEN 1 AND 120"),
    "j12_bank_statement_check": _with([*E, PAID_EVIDENCE, "listed AS (SELECT condo_id, month, paid, code, max(amount) AS amount FROM expense GROUP BY ALL)", "sums AS (SELECT condo_id, paid, sum(paid_amount) AS day_total FROM evidence GROUP BY ALL)"], f"SELECT condo_id, {M}, code, {_d('amount')}, CASE WHEN EXISTS (SELECT 1 FROM evidence v WHERE v.condo_id = l.condo_id AND v.paid = l.paid AND v.paid_amount = l.amount) THEN 'verified' WHEN abs(amount - day_total) <= 0.01 THEN 'day_total' ELSE 'not_in_extract' END AS state FROM listed l LEFT JOIN sums USING (condo_id, paid)"),
    "q2_read_integrity": _with([*A, "x AS (SELECT condo_id, month, account, sum(amount) AS entries FROM expense GROUP BY ALL)", "w AS (SELECT condo_id, 'A1' AS c FROM x JOIN account USING (condo_id, month, account) WHERE abs(entries - debits) > 0.011 UNION ALL SELECT condo_id, 'A6' FROM account WHERE abs(opening + credits - debits - closing) > 0.05)"], 'SELECT condo_id, c AS "check", count(*) AS warnings FROM w GROUP BY ALL'),
    "q6_uncovered_negatives": _with([*A, BELOW, STREAK], f"SELECT condo_id, {M}, account, {_d('closing')} FROM streaks WHERE closing <= -1 AND streak < 3"),
    "u2_union_by_priority": _with([*A, BELOW, STREAK], f"SELECT condo_id, {M}, account, CASE WHEN streak >= 3 THEN 'R7' ELSE 'R8' END AS rule, {_d('closing')} FROM streaks"),
    "d1_financial_analysis": _with([*A, "j AS (SELECT n.*, n.closing - p.closing AS change FROM account n LEFT JOIN account p ON p.condo_id = n.condo_id AND p.account = n.account AND p.month + INTERVAL 1 MONTH = n.month)"], f"SELECT condo_id, {M}, account, CAST(credits - debits AS DOUBLE) AS result, {_d('change')}, concat_ws(',', CASE WHEN debits > credits THEN 'deficit' END, CASE WHEN closing < 0 THEN 'negative' END, CASE WHEN change < 0 THEN 'falling' END) AS attention FROM j"),
    "d13_processing_overview": _with(B, "SELECT condo_id, count(*) AS processed, date_diff('month', min(month), max(month)) + 1 AS total FROM balance GROUP BY 1"),
    "g0_vendor_stability": _with([*E, VENDORS, "s AS (SELECT n.condo_id, CAST(n.month + INTERVAL 1 MONTH AS DATE) AS month, count(*) AS vendors, round(CAST(count(p.vendor) AS DOUBLE) / count(*), 6) AS share FROM v n LEFT JOIN v p ON p.condo_id = n.condo_id AND p.vendor = n.vendor AND p.month + INTERVAL 1 MONTH = n.month GROUP BY n.condo_id, n.month)"], f"SELECT condo_id, {M}, vendors, share, share >= 0.5 AS stable FROM s WHERE EXISTS (SELECT 1 FROM v WHERE v.condo_id = s.condo_id AND v.month = s.month)"),
    "g1_new_vendor": _with([*E, VENDORS, "past AS (SELECT DISTINCT condo_id, CAST(month + INTERVAL (ago) MONTH AS DATE) AS month, vendor, ago FROM v, range(1, 7) AS g(ago))", "known AS (SELECT condo_id, month FROM past GROUP BY ALL HAVING count(DISTINCT ago) >= 2)"], f"SELECT condo_id, {M}, vendor, {_d('total')} FROM v JOIN known USING (condo_id, month) WHERE total >= 3000 AND NOT EXISTS (SELECT 1 FROM past p WHERE p.condo_id = v.condo_id AND p.month = v.month AND p.vendor = v.vendor)"),
    "f8_expense_keys": _with(E, f"SELECT DISTINCT vendor, coalesce(nullif({NORM.format('vendor')}, ''), {NORM.format('split_part(description, chr(32) || chr(45) || chr(32), 2)')}) AS key, {NORM.format('split_part(description, chr(32) || chr(45) || chr(32), 2)')} AS second FROM expense"),
    "f18_income_kinds": _with([*I, f"k AS (SELECT condo_id, month, amount, {NORM.format('description')} AS d FROM income)", f"t AS (SELECT condo_id, month, {KIND} AS kind, sum(amount) AS total, count(*) AS n FROM k GROUP BY ALL)"], f"SELECT condo_id, {M}, kind, {_d('total')}, n FROM t"),
    "f36_base_balances": _with(A, f"SELECT condo_id, {M}, account, greatest(0, (CAST(opening AS DOUBLE) + CAST(closing AS DOUBLE)) / 2) AS mean_base, greatest(0, CAST(opening AS DOUBLE)) AS opening_base, greatest(0, CAST(closing AS DOUBLE)) AS closing_base, strftime(last_day(month), '%Y-%m-%d') AS last_day FROM account"),
    "t3_latest_versions": f"WITH r AS (SELECT CAST(user_id % 20 AS BIGINT) AS condo_id, date_trunc('month', ts) AS month, event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'warning' END AS status, ts FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY condo_id, month ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY condo_id, month) AS most FROM r) SELECT condo_id, {M}, version, event_id, status FROM n WHERE version = most",
}

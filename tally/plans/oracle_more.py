"""SQL of the rules, reviews and dashboards in ``history`` and ``reviews``."""

from __future__ import annotations

from tally.plans.oracle import A7, BELOW, CATS, R1, R9, STREAK, A, B, E, M, S, _d, _with
from tally.plans.oracle import _EVIDENCE as EVIDENCE

PAID_EVIDENCE = EVIDENCE.replace("month, code, amount", "month, paid, account, code, amount", 1)
INDICATOR = """indicator AS (SELECT condo_id, month, CASE WHEN condo_id % 10 <> 0 THEN sum(CASE WHEN kind = 'quota' THEN amount ELSE 0 END) END AS delinquent FROM income GROUP BY condo_id, month)"""
D = [S[0], INDICATOR]
COLLECTED = "collected AS (SELECT condo_id, month, sum(budget) AS budget, sum(collected) AS collected FROM issuance GROUP BY ALL)"
SLIPS = """slips AS (SELECT condo_id, month, code, amount, condo_id || '-' || strftime(month, '%Y-%m') || '-' || account AS auth_id, ord,
  sum(amount) OVER (PARTITION BY condo_id, month, account) AS document_amount FROM expense WHERE ord % 13 = 1)"""
FOUND = [*A, f"found AS (SELECT condo_id, month, 'negative_income' AS type, 'R1' AS rule, description AS subject, total AS amount FROM ({R1}) UNION ALL SELECT condo_id, month, 'balance_continuity', 'R9', account, gap FROM ({R9}) UNION ALL SELECT condo_id, month, 'duplicate', 'A7', code, amount FROM ({A7}))",
         "reviewed AS (SELECT DISTINCT *, CASE WHEN rule IN ('R1', 'R9') AND (condo_id + year(month) * 12 + month(month)) % 10 = 0 THEN 'informative' ELSE 'open' END AS state FROM found)"]
CATEGORIES = "ranked AS (SELECT condo_id, month, category, total, round(CAST(total AS DOUBLE) / nullif(CAST(sum(total) OVER (PARTITION BY condo_id, month) AS DOUBLE), 0), 6) AS share, row_number() OVER (PARTITION BY condo_id, month ORDER BY total DESC, category) AS rank FROM cats)"
SNAPSHOT = "snapshot AS (SELECT condo_id, max(month) AS last_month FROM account GROUP BY 1)"
IMPORTS = "imports AS (SELECT condo_id, status FROM (SELECT CAST(user_id % 20 AS BIGINT) AS condo_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'warning' END AS status, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"
MONTHS = [f"{n:02d}" for n in range(1, 13)]


def _past(table: str, columns: str, value: str) -> str:
    """Rows of the six months before, as (condo_id, month, columns, value)."""
    return f"SELECT condo_id, CAST(month + INTERVAL (ago) MONTH AS DATE) AS month, {columns}, {value} FROM {table}, range(1, 7) AS g(ago)"


SQL = {
    "r3_budget_change": _with([*S, f"past AS ({_past('issuance', 'line', 'median(CAST(budget AS DOUBLE)) AS usual')} GROUP BY 1, 2, 3)"], f"SELECT condo_id, {M}, line, {_d('budget')}, round(usual, 4) AS usual FROM issuance JOIN past USING (condo_id, month, line) WHERE usual > 0 AND abs(CAST(budget AS DOUBLE) / usual - 1) > 0.3"),
    "r3_missing_line": _with([*S, "have AS (SELECT DISTINCT condo_id, month FROM issuance)", "known AS (SELECT condo_id, CAST(month + INTERVAL (ago) MONTH AS DATE) AS month, count(*) AS months FROM have, range(1, 7) AS g(ago) GROUP BY 1, 2)", f"past AS ({_past('issuance', 'line', 'count(*) AS n')} GROUP BY 1, 2, 3)"], f"SELECT condo_id, {M}, line, months FROM past JOIN known USING (condo_id, month) JOIN have USING (condo_id, month) WHERE n = months AND months >= 2 AND NOT EXISTS (SELECT 1 FROM issuance i WHERE i.condo_id = past.condo_id AND i.month = past.month AND i.line = past.line)"),
    "r8_negative_balance_alert": _with([*A, BELOW, STREAK], f"SELECT condo_id, {M}, array_to_string(list_sort(list(account || ':' || streak)), ',') AS accounts, CAST(sum(closing) AS DOUBLE) AS total FROM streaks WHERE closing <= -1 GROUP BY condo_id, streaks.month"),
    "r16_category_switch": _with([*E, "now AS (SELECT condo_id, month, vendor, category, sum(amount) AS total FROM expense GROUP BY ALL)", f"past AS (SELECT DISTINCT * FROM ({_past('now', 'vendor', 'category')}))", "moved AS (SELECT * FROM now WHERE (condo_id, month, vendor) IN (SELECT (condo_id, month, vendor) FROM past) AND (condo_id, month, vendor, category) NOT IN (SELECT (condo_id, month, vendor, category) FROM past))"], f"SELECT condo_id, {M}, vendor, category, {_d('total')}, CASE WHEN count(*) OVER (PARTITION BY condo_id, moved.month) > 8 THEN 'mass' ELSE 'single' END AS kind FROM moved"),
    "r18_new_category_totals": _with([*E, CATS], f"SELECT condo_id, {M}, category, {_d('total')} FROM cats c WHERE total >= 1000 AND EXISTS (SELECT 1 FROM cats p WHERE p.condo_id = c.condo_id AND p.month + INTERVAL 1 MONTH = c.month) AND NOT EXISTS (SELECT 1 FROM cats p WHERE p.condo_id = c.condo_id AND p.month + INTERVAL 1 MONTH = c.month AND p.category = c.category)"),
    "g4b_series_stopped": _with([*E, "series AS (SELECT condo_id, month, vendor, max(inst_n) AS last_n FROM expense WHERE inst_n IS NOT NULL GROUP BY ALL)", "after AS (SELECT condo_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, vendor, last_n FROM series WHERE last_n < 7)"], f"SELECT condo_id, {M}, vendor, last_n FROM after a WHERE EXISTS (SELECT 1 FROM expense e WHERE e.condo_id = a.condo_id AND e.month = a.month) AND NOT EXISTS (SELECT 1 FROM series s WHERE s.condo_id = a.condo_id AND s.month = a.month AND s.vendor = a.vendor)"),
    "g9_reserve_usage": _with(E, f"SELECT condo_id, {M}, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM expense WHERE account LIKE '%RESERVA%' AND amount >= 0.01 GROUP BY condo_id, expense.month"),
    "g12_delinquency_growth": _with(D, f"SELECT n.condo_id, strftime(n.month, '%Y-%m') AS month, CAST(n.delinquent AS DOUBLE) AS delinquent, CAST(p.delinquent AS DOUBLE) AS previous_delinquent FROM indicator n JOIN indicator p ON p.condo_id = n.condo_id AND p.month + INTERVAL 1 MONTH = n.month WHERE p.delinquent > 0 AND n.delinquent - p.delinquent >= 1000 AND CAST(n.delinquent - p.delinquent AS DOUBLE) / CAST(p.delinquent AS DOUBLE) >= 0.2"),
    "k2_top_items": _with([*E, "items AS (SELECT DISTINCT condo_id, month, category, code, amount FROM expense)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY condo_id, month, category ORDER BY abs(amount) DESC, code) AS rank FROM items)"], f"SELECT condo_id, {M}, category, code, {_d('amount')}, rank FROM ranked WHERE rank <= 6"),
    "a5_category_closure": _with([*A, "c AS (SELECT condo_id, month, sum(amount) AS categories FROM expense GROUP BY ALL)", "d AS (SELECT condo_id, month, sum(debits) AS all_debits, sum(CASE WHEN account = 'ORDINARIA' THEN debits ELSE 0 END) AS ordinary FROM account GROUP BY ALL)", "g AS (SELECT condo_id, month, categories, least(abs(categories - all_debits), abs(categories - ordinary)) AS gap FROM c JOIN d USING (condo_id, month))"], f"SELECT condo_id, {M}, {_d('categories', 'gap')}, gap <= 0.01 AS closes FROM g"),
    "a8_duplicates_by_fields": _with([*E, "g AS (SELECT condo_id, month, due, amount, category, description, count(*) AS n FROM expense GROUP BY ALL HAVING count(*) >= 2 AND bool_and(regexp_matches(description, 'NF\\. *[0-9]+|[0-9]{8,}')))"], f"SELECT condo_id, {M}, strftime(due, '%Y-%m-%d') AS due, {_d('amount')}, category, description, n FROM g"),
    "a21_audit_totals": _with(A, "SELECT condo_id, count(*) AS rows, count(*) FILTER (WHERE abs(opening + credits - debits - closing) > 0.05) AS failed FROM account GROUP BY ROLLUP (condo_id)"),
    "a28_delinquency_ratio": _with([*D, S[1], COLLECTED], f"SELECT condo_id, {M}, {_d('delinquent', 'collected')}, round(CAST(delinquent AS DOUBLE) / CAST(collected AS DOUBLE) * 100, 2) AS ratio FROM indicator JOIN collected USING (condo_id, month) WHERE delinquent > 0 AND collected > 0"),
    "j9_shared_documents": _with([*E, SLIPS, "g AS (SELECT condo_id, month, auth_id, document_amount, count(DISTINCT code) AS codes, sum(amount) AS total FROM slips WHERE ord % 11 <> 0 GROUP BY ALL HAVING count(DISTINCT code) >= 2)"], f"SELECT condo_id, {M}, auth_id, codes, {_d('document_amount', 'total')}, CAST(CASE WHEN abs(total - document_amount) <= 0.02 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM g"),
    "j15_kth_pairing": _with([*E, PAID_EVIDENCE, "x AS (SELECT condo_id, month, paid, abs(amount) AS size, amount < 0 AS debit, row_number() OVER (PARTITION BY condo_id, paid, abs(amount), amount < 0 ORDER BY code) AS i FROM expense)", "v AS (SELECT condo_id, paid, abs(paid_amount) AS size, paid_amount < 0 AS debit, row_number() OVER (PARTITION BY condo_id, paid, abs(paid_amount), paid_amount < 0 ORDER BY code) AS i FROM evidence)"], f"SELECT condo_id, {M}, count(v.i) AS paired, count(*) - count(v.i) AS left_over FROM x LEFT JOIN v USING (condo_id, paid, size, debit, i) GROUP BY condo_id, x.month"),
    "p4_reviewed_findings": _with(FOUND, f"SELECT condo_id, {M}, type, rule, subject, {_d('amount')}, state FROM reviewed"),
    "p10_open_items": _with(FOUND, f"SELECT condo_id, {M}, count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state <> 'open') AS excluded FROM reviewed GROUP BY condo_id, reviewed.month"),
    "d3_month_card": _with([*B, CATS, CATEGORIES], f"SELECT condo_id, {M}, {_d('opening', 'credits', 'debits', 'closing')}, CAST(credits - debits AS DOUBLE) AS gap, category AS top_category, share AS top_share FROM balance LEFT JOIN (SELECT condo_id, month, category, share FROM ranked WHERE rank = 1) USING (condo_id, month)"),
    "d5_category_by_month": _with([*E, "t AS (SELECT condo_id, category, year(month) AS year, " + ", ".join(f"coalesce(sum(amount) FILTER (WHERE strftime(month, '%m') = '{m}'), 0) AS m{m}" for m in MONTHS) + " FROM expense GROUP BY condo_id, category, year(month))"], "SELECT condo_id, category, year, " + _d(*(f"m{m}" for m in MONTHS)) + " FROM t WHERE " + " OR ".join(f"m{m} <> 0" for m in MONTHS)),
    "d7_budget_gap": _with([*S, COLLECTED, "c AS (SELECT condo_id, month, CAST(budget AS DOUBLE) AS budget, CAST(collected AS DOUBLE) - CAST(budget AS DOUBLE) AS gap FROM collected)"], f"SELECT condo_id, {M}, round(gap, 2) AS gap, CASE WHEN budget > 0 THEN round(gap / budget * 100, 4) END AS percent, round(avg(budget) OVER w, 4) AS mean_budget, round(avg(gap) OVER w, 4) AS mean_gap FROM c WINDOW w AS (PARTITION BY condo_id)"),
    "d8_delinquency_status": _with([*D, "s AS (SELECT *, CAST(delinquent AS DOUBLE) / CAST(max(delinquent) OVER (PARTITION BY condo_id) AS DOUBLE) AS share, max(delinquent) OVER (PARTITION BY condo_id) AS most FROM indicator)"], f"SELECT condo_id, {M}, {_d('delinquent')}, round(share, 6) AS share, CASE WHEN share > 0.8 THEN 'high' WHEN share > 0.5 THEN 'medium' ELSE 'low' END AS status FROM s WHERE delinquent IS NOT NULL AND most > 0"),
    "d11_building_status": _with([*A, SNAPSHOT, IMPORTS], "SELECT condo_id, strftime(last_month, '%Y-%m') AS last_month, CASE WHEN last_month IS NULL THEN 'no_data' WHEN last_month >= DATE '1998-11-01' THEN 'current' WHEN status = 'error' THEN 'error' ELSE 'pending' END AS state FROM snapshot FULL JOIN imports USING (condo_id)"),
    "q4_text_lint": r"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '\{\{|\}\}|TODO|XXX|\[\.\.\.\]') AS placeholder, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS BIGINT) AS questions, contains(coalesce(text, ''), '?') AND NOT regexp_matches(coalesce(text, ''), '\?[ \n]*$') AS trails FROM conversations WHERE role = 'assistant'",
}

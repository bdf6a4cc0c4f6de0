"""SQL of the review layer, of audits over what is published, and of the readers."""

from __future__ import annotations

from tally.plans.oracle import _ACCOUNT, _BALANCE, _EXPENSE, _INCOME, _ISSUANCE, A7, BRL, M, R1, R9, _d, _with
from tally.plans.oracle_matching import DOCS

A = [_EXPENSE, _INCOME, _ACCOUNT]
B = [*A, _BALANCE]
_F = f"f AS (SELECT *, condo_id + year(month) * 12 + month(month) AS k FROM (SELECT condo_id, month, 'negative_income' AS type, 'R1' AS rule, description AS subject, CAST(total AS DECIMAL(18,2)) AS amount FROM ({R1}) UNION ALL SELECT condo_id, month, 'balance_continuity', 'R9', account, CAST(gap AS DECIMAL(18,2)) FROM ({R9}) UNION ALL SELECT condo_id, month, 'duplicate', 'A7', code, CAST(amount AS DECIMAL(18,2)) FROM ({A7})))"
F = [*A, _F]
TITLE = "CASE type WHEN 'negative_income' THEN 'Receita negativa' WHEN 'balance_continuity' THEN 'Saldo anterior diverge' ELSE 'Lançamento em duplicidade' END"
QUESTION = f"CASE type WHEN 'negative_income' THEN 'A que se refere ' || {BRL} || '?' WHEN 'balance_continuity' THEN 'Por que o saldo mudou?' END"
BODY = f"{TITLE} || ': ' || subject || ', ' || {BRL}"
WAIVED = "wv AS (SELECT condo_id, month, type, subject, amount + CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.01 ELSE 0 END AS waived FROM f WHERE rule IN ('R1', 'R9') AND k % 2 = 0), rv AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM wv WHERE wv.condo_id = f.condo_id AND wv.month = f.month AND wv.type = f.type AND wv.subject = f.subject AND abs(f.amount - wv.waived) <= 0.01) THEN 'informative' ELSE 'open' END AS state FROM f)"
MI = f"SELECT condo_id, {M}, type, subject"
KK = "condo_id + year(month) * 12 + month(month)"
BRL_OF = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || translate(format('{{:,.2f}}', CAST(abs({0}) AS DOUBLE)), ',.', '.,')"
SQL = {
    "p1_narrated": _with(F, f"{MI}, {_d('amount')}, {TITLE} AS title, {BODY} AS body, {QUESTION} AS question FROM f"),
    "p2_invalid_reviews": _with([*F, "r AS (SELECT condo_id, month, type, CASE WHEN k % 13 = 0 THEN subject || '?' ELSE subject END AS subject, k FROM f WHERE k % 11 <> 0)"], f"{MI}, 'not_reviewed' AS fault FROM f WHERE k % 11 = 0 OR k % 13 = 0 UNION ALL {MI}, 'unknown_finding' FROM r WHERE k % 13 = 0 UNION ALL {MI}, 'severity' FROM r WHERE k % 7 = 0 UNION ALL {MI}, 'no_reason' FROM r WHERE (k % 7 = 0 OR k % 5 = 0) AND k % 10 <> 0 UNION ALL {MI}, 'confidence' FROM r WHERE k % 17 = 0 UNION ALL {MI}, 'no_text' FROM r WHERE k % 19 = 0"),
    "p3_visual_checks": _with(F, f"{MI}, rule, {_d('amount')}, CASE WHEN k % 3 = 0 AND k % 2 <> 0 AND condo_id % 4 <> 0 THEN 'informative' ELSE 'open' END AS state FROM f"),
    "p4_waivers": _with([*F, WAIVED], f"{MI}, rule, {_d('amount')}, state FROM rv"),
    "p5_rewrites": _with(F, f"{MI}, {_d('amount')}, CASE WHEN k % 9 = 0 THEN 'Ver ' || subject ELSE {TITLE} END AS title, {BODY} AS body, CASE WHEN k % 9 = 0 THEN 'Qual o motivo?' ELSE {QUESTION} END AS question FROM f"),
    "p6_scope": _with(F, f"{MI}, rule, {_d('amount')} FROM f WHERE k % 6 <> 0 OR type = 'duplicate'"),
    "p9_manual": _with(F, f"{MI}, rule, CAST(CASE WHEN k % 8 = 0 AND rule = 'R9' THEN amount * 2 ELSE amount END AS DOUBLE) AS amount FROM f UNION ALL SELECT DISTINCT condo_id, {M}, 'manual', 'note', 'M', CAST(0 AS DOUBLE) FROM f WHERE k % 15 = 0"),
    "p11_scope_notices": _with(DOCS, f"SELECT condo_id, {M}, count(*) AS listed FROM expense e WHERE NOT EXISTS (SELECT 1 FROM papers WHERE papers.condo_id = e.condo_id AND papers.month = e.month) GROUP BY condo_id, e.month"),
    "p12_repeated_values": _with(DOCS, f"SELECT condo_id, {M}, code, times FROM (SELECT *, CAST(len(string_split(raw_text, translate(format('{{:,.2f}}', CAST(abs(read_amount) AS DOUBLE)), ',.', '.,'))) - 1 AS BIGINT) AS times FROM papers) WHERE times >= 1"),
    "p13_summary_vs_cashbook": _with(A, f"SELECT condo_id, {M}, {_d('categories', 'cashbook')} FROM (SELECT condo_id, month, sum(amount) AS categories FROM expense WHERE ord % 111 <> 0 GROUP BY ALL) JOIN (SELECT condo_id, month, sum(debits) AS cashbook FROM account GROUP BY ALL) USING (condo_id, month) WHERE abs(categories - cashbook) > 1"),
    "p14_withdrawn": _with([*F, WAIVED], f"SELECT condo_id, {M}, 'Building ' || condo_id AS name, type, subject, {_d('amount')} FROM rv WHERE state = 'informative'"),
    "k5_fronted": _with(F, f"{MI}, rule, {_d('amount')}, row_number() OVER (PARTITION BY condo_id, f.month ORDER BY CASE WHEN type = 'duplicate' THEN 0 ELSE 1 END, rule, subject, f.amount) AS place FROM f"),
    "q1_source_vs_published": _with([*B, f"p AS (SELECT condo_id, month, opening AS b_opening, credits AS b_credits, debits AS b_debits, closing + CASE WHEN ({KK}) % 5 = 0 THEN 2 ELSE 0 END AS b_closing, CASE WHEN ({KK}) % 6 = 0 THEN 0 WHEN ({KK}) % 4 = 0 THEN yield_amt + 5 ELSE yield_amt END AS b_yield FROM balance WHERE ({KK}) % 14 <> 0)", "r AS (SELECT b.condo_id, unnest([b.opening, b.credits, b.debits, b.closing, b.yield_amt]) AS x, unnest([b_opening, b_credits, b_debits, b_closing, b_yield]) AS y, unnest([true, true, true, true, false]) AS critical FROM balance b LEFT JOIN p USING (condo_id, month))", "s AS (SELECT condo_id, CASE WHEN y IS NULL THEN 'missing' WHEN NOT critical AND y = 0 THEN 'skip' WHEN abs(x - y) <= 1 THEN 'ok' WHEN critical THEN 'diff' ELSE 'warn' END AS state FROM r)"], "SELECT condo_id, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ("ok", "warn", "diff", "skip", "missing")) + " FROM s GROUP BY ROLLUP (condo_id)"),
    "q3_untraced_facts": _with([*F, "v AS (SELECT condo_id, month, CAST(abs(amount) AS DECIMAL(18,2)) AS value FROM expense UNION SELECT condo_id, month, CAST(abs(unnest([opening, closing, credits, debits])) AS DECIMAL(18,2)) FROM account)"], f"{MI}, {_d('amount')} FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.condo_id = f.condo_id AND v.month = f.month AND v.value = abs(f.amount))"),
    "q5_report_closure": _with([*A, "a AS (SELECT condo_id, month, count(*) FILTER (abs(opening + credits - debits - closing) > 0.011) AS open_accounts, sum(debits) AS debits, list(CAST(debits * 100 AS BIGINT)) FILTER (abs(debits) > 0.005) AS ds FROM account GROUP BY ALL)", "c AS (SELECT condo_id, month, sum(amount) AS categories FROM expense GROUP BY ALL)", "r AS (SELECT condo_id, month, open_accounts, ds, categories, coalesce(abs(categories - debits) <= 0.02, false) AS categories_close FROM a LEFT JOIN c USING (condo_id, month))"], f"SELECT condo_id, {M}, open_accounts, categories_close, (SELECT CAST(min(bit_count(mask)) AS BIGINT) FROM range(1, 8) AS q(mask) WHERE mask < (1 << len(ds)) AND abs(coalesce(CASE WHEN mask & 1 = 1 THEN ds[1] END, 0) + coalesce(CASE WHEN mask & 2 = 2 THEN ds[2] END, 0) + coalesce(CASE WHEN mask & 4 = 4 THEN ds[3] END, 0) - CAST(categories * 100 AS BIGINT)) <= 2) AS accounts_in_total FROM r WHERE open_accounts > 0 OR NOT categories_close"),
    "q7_missing_reports": "SELECT condo_id, strftime(m, '%Y-%m') AS month FROM (SELECT CAST(user_id % 20 AS BIGINT) AS condo_id, date_trunc('month', ts) AS m, bool_or(event_type = 'purchase' AND user_id % 20 % 3 <> 0) AS done FROM events GROUP BY ALL) WHERE NOT done",
    "d12_month_exists": _with(B, f"SELECT w.condo_id, strftime(w.month, '%Y-%m') AS month, b.condo_id IS NOT NULL AS present, CAST(b.closing AS DOUBLE) AS closing FROM (SELECT DISTINCT condo_id, CAST(month + INTERVAL 2 MONTH AS DATE) AS month FROM expense) w LEFT JOIN balance b USING (condo_id, month)"),
    "s4_month_files": _with([_EXPENSE, f"s AS (SELECT DISTINCT condo_id, month, {KK} AS k FROM expense)"], "SELECT condo_id, strftime(month + INTERVAL 20 YEAR, '%Y-%m') AS month, '/c' || condo_id || '/' || CASE k % 4 WHEN 0 THEN 'Prestacao ' || strftime(month, '%m') || '.' || (year(month) + 20) WHEN 1 THEN 'balancete ' || (year(month) + 20) || '_' || strftime(month, '%m') WHEN 2 THEN ['JANEIRO', 'FEVEREIRO', 'MARCO', 'ABRIL', 'MAIO', 'JUNHO', 'JULHO', 'AGOSTO', 'SETEMBRO', 'OUTUBRO', 'NOVEMBRO', 'DEZEMBRO'][month(month)] || ' ' || (year(month) + 20) ELSE 'conta ' || strftime(month, '%m') || (year(month) + 20) END || '.pdf' AS path, 'pdf' AS format FROM s WHERE k % 5 <> 0"),
    "s5_printed_period": _with([_EXPENSE], f"SELECT DISTINCT condo_id, {M}, strftime(last_day(month) + INTERVAL 1 MONTH, '%Y-%m-%d') AS printed_end FROM expense WHERE condo_id % 9 = 0"),
    "s7_section_lines": _with([_EXPENSE, "t AS (SELECT condo_id, month, account, sum(amount) AS items FROM expense GROUP BY ALL)"], f"SELECT condo_id, {M}, account AS section, {_d('items')}, CAST(items + CASE WHEN condo_id % 8 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS declared, condo_id % 8 <> 0 AS closes FROM t"),
    "s9_repeated_blocks": _with([_EXPENSE], f"SELECT DISTINCT condo_id, {M}, CAST(CASE WHEN condo_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS blocks, CAST(CASE WHEN condo_id % 8 = 0 THEN NULL WHEN condo_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM expense"),
    "s11_dashboard_balances": _with(B, "SELECT condo_id, strftime(month, '%Y-%m') AS key, " + ", ".join(f"CAST({a} AS DOUBLE) AS {b}" for a, b in (("opening", "tAnt"), ("credits", "tCred"), ("debits", "tDeb"), ("closing", "tAtual"))) + " FROM balance"),
    "s14_declared_indicators": _with([_INCOME, _ISSUANCE, "s AS (SELECT condo_id, month, sum(budget) AS budget, sum(collected) AS collected FROM issuance GROUP BY ALL)", "i AS (SELECT condo_id, month, sum(CASE WHEN kind = 'quota' THEN amount ELSE 0 END) AS quota FROM income GROUP BY ALL)"], f"SELECT condo_id, {M}, {_d('budget', 'collected')}, CAST(CASE WHEN condo_id % 10 <> 0 THEN quota END AS DOUBLE) AS delinquent FROM (SELECT * FROM s JOIN i USING (condo_id, month))"),
}

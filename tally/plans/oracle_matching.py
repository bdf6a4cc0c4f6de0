"""SQL of the reconciliation with payments, slips, reports and documents."""

from __future__ import annotations

from tally.functions.documents import AUTHENTICATION, BANK_SLIP, FALSE_MARKER, INVOICE_MARKER, MECHANICAL, PAYMENT_PAGE
from tally.functions.identity import TAX
from tally.plans.oracle import _ACCOUNT, _EXPENSE, _INCOME, _ISSUANCE, M, _d, _with
from tally.plans.oracle_named import EXEMPT, K, NF, RENAMED, kind

_W = """w AS (
  SELECT DISTINCT ON (code) condo_id, month, ord, code, amount, CASE ord % 3 WHEN 0 THEN 'INSS' WHEN 1 THEN 'ISS' ELSE 'PIS' END AS tax, 'RECEITA FEDERAL' AS vendor,
    last_day(month) + CASE WHEN ord % 5 = 0 THEN 5 ELSE 0 END AS due, paid, account
  FROM expense WHERE ord % 11 = 0 AND amount > 0 ORDER BY code, amount, paid, account, month
)"""
_T = """t0 AS (SELECT condo_id, month, tax, sum(amount) AS sum, list_sort(list(code)) AS codes FROM w GROUP BY ALL), t AS (
  SELECT condo_id, month, 'T-' || condo_id || '-' || strftime(month, '%Y%m') || '-' || tax AS payment, sum + CASE WHEN (condo_id + month(month)) % 7 = 0 THEN 1 ELSE 0 END AS total,
    CASE WHEN condo_id % 2 = 0 THEN codes ELSE codes[1:1] END AS listed FROM t0
)"""
_P = """p0 AS (SELECT condo_id, month, paid, account, sum(amount) AS sum FROM w GROUP BY ALL), p AS (
  SELECT condo_id, month, 'P-' || condo_id || '-' || strftime(paid, '%Y%m%d') || '-' || account || '-' || copy AS payment, paid, account, sum + CASE WHEN (condo_id + day(paid)) % 5 = 0 THEN 1 ELSE 0 END AS total
  FROM p0 CROSS JOIN range(1, 3) AS g(copy) WHERE copy = 1 OR day(paid) % 6 = 0
)"""
_M = "many AS (SELECT condo_id, month, paid, account, min(payment) AS payment, max(sum) AS total, max(n) AS expenses FROM p JOIN (SELECT condo_id, month, paid, account, count(*) AS n, sum(amount) AS sum FROM w GROUP BY ALL HAVING count(*) >= 2) USING (condo_id, month, paid, account) WHERE abs(total - sum) <= 0.01 GROUP BY ALL)"
_AT = r"""papers AS (
  SELECT DISTINCT ON (code) condo_id, month, code,
    CASE WHEN ord % 17 = 0 THEN '' WHEN ord % 3 = 0 THEN '[Pagina 1]' || chr(10) || 'NOTA FISCAL ' || invoice || chr(10) || 'valor total: R$ ' || money || chr(10) || 'Emitente ' || name
      WHEN ord % 3 = 1 THEN '[Pagina 1]' || chr(10) || 'Comprovante de Pagamento' || chr(10) || 'valor: R$ ' || money || chr(10) || 'Encaminhar a Nota Fiscal junto'
      ELSE '[Pagina 1]' || chr(10) || 'DARF Documento No. 12345 ' || condo_id || ' 678' || chr(10) || 'Beneficiario ' || name END AS raw_text,
    CASE WHEN ord % 17 = 0 THEN NULL WHEN ord % 7 = 0 THEN amount + 100 ELSE amount END AS read_amount, ord % 3 = 2 AS is_slip
  FROM (SELECT *, translate(format('{:,.2f}', CAST(abs(amount) AS DOUBLE)), ',.', '.,') AS money FROM named) WHERE ord % 11 <> 0 AND condo_id % 9 <> 0 ORDER BY code, amount, paid, account, name, month
)"""
E = [_EXPENSE]
A = [_EXPENSE, _INCOME, _ACCOUNT]
NO = "(condo_id + no)"


def _shown(text: str, amount: str) -> str:
    return f"{amount} > 0 AND regexp_matches({text}, '(?:^|[^0-9.,]|[^0-9][.,])' || replace(replace(split_part(format('{{:,.2f}}', CAST(abs({amount}) AS DOUBLE)), '.', 1), ',', '#'), '#', '[.,\\s]?') || '\\s?[,.]\\s?' || (CASE WHEN {_CENTS.format(amount)} LIKE '%0' AND {_CENTS.format(amount)} <> '00' THEN '(?:' || {_CENTS.format(amount)} || '|' || left({_CENTS.format(amount)}, 1) || ')' ELSE {_CENTS.format(amount)} END) || '(?:[^0-9]|$)')"


_CENTS = "lpad(CAST(CAST(abs({0}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0')"
PAY = f"(regexp_matches(page_text, '{PAYMENT_PAGE}') OR regexp_matches(regexp_replace(page_text, '{MECHANICAL}', ' ', 'g'), '{AUTHENTICATION}'))"
SLIP = f"regexp_matches(page_text, '{BANK_SLIP}')"
# DuckDB's expressions repeat up to a thousand times
_FALSE = FALSE_MARKER.replace("{0,2500}", "{0,1000}")
INV = f"regexp_matches(regexp_replace(page_text, '{_FALSE}', ' ', 'g'), '{INVOICE_MARKER}')"
PAGES = "pages AS (SELECT condo_id, month, code, read_amount, substr(raw_text, length('[Pagina 1]') + 2) AS page_text FROM papers WHERE raw_text <> '')"
DOCS = [*K, _AT, PAGES]
ONCE = "once AS (SELECT condo_id, month, code, min({'ord': ord, 'description': description, 'category': category, 'amount': amount}) AS x, count(*) AS n FROM keyed GROUP BY ALL), one AS (SELECT condo_id, month, code, n, x.description AS description, x.category AS category, x.amount AS amount, concat_ws(' ', x.description, x.category) AS both_texts FROM once)"
KINDS_J8 = f"CASE WHEN {EXEMPT} IS NOT NULL THEN 'exempt' WHEN raw_text IS NULL THEN 'missing_evidence' WHEN raw_text = '' THEN 'unreadable' WHEN abs(read_amount - amount) <= 0.01 THEN 'verified' WHEN is_slip AND read_amount > amount AND regexp_matches(upper(description), '{TAX}') THEN 'slip_larger_than_withholding' WHEN coalesce({_shown('raw_text', 'amount')}, false) AND length(raw_text) >= 60 THEN 'amount_in_text' ELSE 'divergent_amount' END"
SQL = {
    "j2_consolidated_by_list": _with([*E, _W, _T, "l AS (SELECT condo_id, month, payment, total, len(listed) AS n, unnest(listed) AS code FROM t WHERE len(listed) >= 2)", "g AS (SELECT condo_id, month, payment FROM l LEFT JOIN w USING (condo_id, month, code) GROUP BY ALL HAVING max(n) = count(amount) AND abs(sum(amount) - max(total)) <= 0.01)"], f"SELECT condo_id, {M}, code, payment, amount FROM (SELECT condo_id, month, code, min(payment) AS payment, CAST(max(amount) AS DOUBLE) AS amount FROM l JOIN g USING (condo_id, month, payment) JOIN w USING (condo_id, month, code) GROUP BY ALL)"),
    "j3_consolidated_by_pool": _with([*E, _W, _T, "h AS (SELECT t.condo_id, t.month, payment, total, len(listed) AS n, tax, due FROM t JOIN w ON w.code = listed[1])", "d AS (SELECT condo_id, month, tax, due, sum(amount) AS ds, count(*) AS dn FROM w GROUP BY ALL)", "x AS (SELECT condo_id, month, tax, sum(amount) AS xs, count(*) AS xn FROM w GROUP BY ALL)", "s AS (SELECT h.*, CASE WHEN dn > n AND abs(ds - total) <= 0.01 THEN 'due' WHEN xn > n AND abs(xs - total) <= 0.01 THEN 'tax' END AS pool FROM h JOIN d USING (condo_id, month, tax, due) JOIN x USING (condo_id, month, tax))"], f"SELECT condo_id, {M}, code, payment, amount, pool FROM (SELECT s.condo_id, s.month, w.code, min(payment) AS payment, CAST(max(amount) AS DOUBLE) AS amount, max(pool) AS pool FROM s JOIN w ON w.condo_id = s.condo_id AND w.month = s.month AND w.tax = s.tax AND (pool = 'tax' OR w.due = s.due) WHERE pool IS NOT NULL GROUP BY ALL)"),
    "j4_many_to_one": _with([*E, _W, _P, _M], f"SELECT condo_id, {M}, strftime(paid, '%Y-%m-%d') AS paid, account, payment, {_d('total')}, expenses, CAST(0.6 AS DOUBLE) AS confidence FROM many"),
    "j5_fiscal_amounts": _with([*E, _W], f"SELECT condo_id, {M}, code, {_d('amount')}, 'F-' || condo_id || '-' || strftime(month, '%Y%m') AS report, CAST(0.8 AS DOUBLE) AS confidence FROM (SELECT * FROM w WHERE condo_id % 3 = 0)".replace("strftime(month, '%Y-%m') AS month", "strftime(month, '%Y-%m') AS month")),
    "j6_unpaired": _with([*DOCS, ONCE, _W, _T, "l AS (SELECT condo_id, month, payment, total, len(listed) AS n, unnest(listed) AS code FROM t WHERE len(listed) >= 2)", "g AS (SELECT condo_id, month, payment FROM l LEFT JOIN w USING (condo_id, month, code) GROUP BY ALL HAVING max(n) = count(amount) AND abs(sum(amount) - max(total)) <= 0.01)", "s AS (SELECT DISTINCT condo_id, month, code FROM l JOIN g USING (condo_id, month, payment))"], f"SELECT condo_id, {M}, code, {_d('amount')}, CASE WHEN {EXEMPT} IS NOT NULL THEN 'verified' WHEN EXISTS (SELECT 1 FROM papers WHERE papers.condo_id = one.condo_id AND papers.month = one.month AND papers.code = one.code) THEN 'unverifiable' ELSE 'missing_evidence' END AS type, {EXEMPT} AS reason FROM one WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.condo_id = one.condo_id AND s.month = one.month AND s.code = one.code)"),
    "j7_orphan_payments": _with([*E, _W, _P, _M], f"SELECT condo_id, {M}, payment, {_d('total')} FROM p WHERE NOT EXISTS (SELECT 1 FROM many WHERE many.payment = p.payment AND many.condo_id = p.condo_id AND many.month = p.month)"),
    "j8_listing_vs_attachment": _with([*DOCS, ONCE, "r AS (SELECT * FROM one LEFT JOIN papers USING (condo_id, month, code) WHERE EXISTS (SELECT 1 FROM papers m WHERE m.condo_id = one.condo_id AND m.month = one.month))"], f"SELECT *, CAST(CASE type WHEN 'slip_larger_than_withholding' THEN 0.5 WHEN 'divergent_amount' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence FROM (SELECT condo_id, {M}, code, {_d('amount', 'read_amount')}, {KINDS_J8} AS type FROM r)"),
    "j10_invoice_missing": _with([*DOCS, f"li AS (SELECT condo_id, month, code, {NF} AS number, min(amount) AS amount FROM keyed WHERE {NF} <> '' AND NOT {kind('description', 'withholding')} GROUP BY ALL)", f"bare AS (SELECT * FROM li JOIN (SELECT condo_id, month, code FROM pages GROUP BY ALL HAVING NOT bool_or({INV})) USING (condo_id, month, code))", f"nums AS (SELECT condo_id, month, code AS holder, unnest(regexp_extract_all(page_text, '[0-9]{{2,}}')) AS number FROM pages WHERE {INV} AND NOT {PAY})"], f"SELECT condo_id, {M}, code, number, {_d('amount')} FROM bare b WHERE NOT EXISTS (SELECT 1 FROM nums n WHERE n.condo_id = b.condo_id AND n.month = b.month AND n.number = b.number AND n.holder <> b.code)"),
    "j14_pages_shared": _with([*DOCS, "once AS (SELECT condo_id, month, code, min({'ord': ord, 'amount': amount, 'held': " + kind("description", "withholding") + "}) AS x FROM keyed GROUP BY ALL)", f"r AS (SELECT condo_id, month, code, x.amount AS amount, CASE WHEN x.held AND is_slip THEN 'withholding_slip' WHEN {_shown('raw_text', 'x.amount')} THEN 'amount_visible' END AS how FROM once JOIN papers USING (condo_id, month, code))"], f"SELECT condo_id, {M}, code, {_d('amount')}, how FROM r WHERE how IS NOT NULL"),
    "j17_signs_reconciled": _with([*A, f"r AS (SELECT *, CASE WHEN {NO} % 6 = 0 THEN abs(closing) WHEN {NO} % 7 = 0 THEN closing + 1 ELSE closing END AS reported FROM (SELECT *, year(month) * 12 + month(month) AS no FROM (SELECT * EXCLUDE (no) FROM (SELECT *, 0 AS no FROM account))))", "s AS (SELECT *, CASE WHEN abs(reported - closing) <= 0.02 THEN 'equal' WHEN abs(abs(reported) - abs(closing)) <= 0.02 THEN 'sign' ELSE 'different' END AS state FROM r)"], f"SELECT condo_id, {M}, account, CAST(CASE WHEN state = 'sign' THEN closing ELSE reported END AS DOUBLE) AS amount, state FROM s"),
    "j19_reclassified_vendors": _with([*K, "now AS (SELECT condo_id, month, key, category, sum(amount) AS total FROM keyed WHERE key <> '' GROUP BY ALL)", "past AS (SELECT condo_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, key, category FROM now)"], f"SELECT condo_id, {M}, key, category, {_d('total')}, past_category FROM (SELECT n.condo_id, n.month, n.key, n.category, n.total, max_by(p.category, row(length(p.category), p.category)) AS past_category FROM now n JOIN past p ON p.condo_id = n.condo_id AND p.month = n.month AND p.key = n.key WHERE NOT EXISTS (SELECT 1 FROM past h WHERE h.condo_id = n.condo_id AND h.month = n.month AND h.category = n.category) GROUP BY ALL)"),
    "j23_paired_by_value": _with([_INCOME, "c AS (SELECT *, row_number() OVER (PARTITION BY condo_id, month, account, amount ORDER BY ord) AS i FROM income)", "r AS (SELECT *, row_number() OVER (PARTITION BY condo_id, month, account, amount ORDER BY ord) AS i FROM income WHERE ord % 4 <> 0)"], f"SELECT c.condo_id, strftime(c.month, '%Y-%m') AS month, c.account, CAST(c.amount AS DOUBLE) AS amount, c.ord, r.ord AS receipt, CASE WHEN r.ord IS NULL THEN 'position_only' ELSE 'paired' END AS state FROM c LEFT JOIN r USING (condo_id, month, account, amount, i)"),
    "f24_document_facts": _with(DOCS, f"SELECT condo_id, {M}, code, 'pag1_cod' || code AS record, coalesce({_shown('page_text', 'read_amount')}, false) AS shows_amount, {INV} AS invoice, {PAY} AS payment, {SLIP} AS slip, CASE WHEN page_text LIKE 'DARF%' THEN '12345' || condo_id || '678' END AS slip_id, TRY_CAST(replace(replace(nullif(coalesce(nullif(regexp_extract(page_text, '(?i)valor\\s+total:?\\s*R?\\$?\\s*([0-9.]+,[0-9]{{2}})', 1), ''), regexp_extract(page_text, '(?i)\\bvalor:?\\s*R\\$\\s*([0-9.]+,[0-9]{{2}})', 1)), ''), '.', ''), ',', '.') AS DOUBLE) AS total FROM pages"),
    "a2_sum_vs_declared": _with([*A, "de AS (SELECT condo_id, month, account, debits + CASE WHEN (condo_id + year(month) * 12 + month(month)) % 8 = 0 THEN 0.05 ELSE 0 END AS declared FROM account)", "s AS (SELECT condo_id, month, account, sum(amount) AS entries FROM expense GROUP BY ALL)", "r AS (SELECT condo_id, month, account, coalesce(entries, 0) AS entries, declared FROM de LEFT JOIN s USING (condo_id, month, account))"], f"SELECT condo_id, {M}, account, {_d('entries', 'declared')}, CAST(entries - declared AS DOUBLE) AS gap FROM r WHERE abs(entries - declared) > 0.02"),
    "a4_category_vs_balance": _with([*E, "b AS (SELECT condo_id, month, category, sum(amount) AS declared, coalesce(sum(amount) FILTER (ord % 111 <> 0), 0) AS evidence FROM expense GROUP BY ALL)"], f"SELECT condo_id, {M}, category, {_d('declared', 'evidence')}, CAST(evidence - declared AS DOUBLE) AS gap FROM b WHERE abs(evidence - declared) > 0.02"),
    "a9_repeated_documents": _with([*K], f"SELECT condo_id, {M}, key, document, amount, n, CAST(0.8 AS DOUBLE) AS confidence FROM (SELECT condo_id, month, key, coalesce(nullif({NF}, ''), CAST(due AS VARCHAR)) AS document, CAST(amount AS DOUBLE) AS amount, count(*) AS n FROM keyed WHERE amount > 0 GROUP BY ALL HAVING count(*) >= 2)"),
    "a11_slip_groups": _with([*E, "x AS (SELECT * FROM expense WHERE ord % 13 = 1)", "tot AS (SELECT condo_id, month, account, sum(amount) AS document_amount, coalesce(sum(amount) FILTER (ord % 11 = 0), 0) AS spare FROM x GROUP BY ALL)", "g AS (SELECT condo_id, month, account, count(*) AS n, sum(amount) AS s FROM x WHERE ord % 11 <> 0 GROUP BY ALL HAVING count(*) >= 2)"], f"SELECT condo_id, {M}, condo_id || '-' || strftime(month, '%Y-%m') || '-' || account AS auth_id, n, CAST(s AS DOUBLE) AS sum, {_d('document_amount')}, CASE WHEN abs(document_amount - s) <= 0.02 THEN 'closes' WHEN abs(document_amount - s - spare) <= 0.02 THEN 'closes_with_unread' ELSE 'open' END AS state FROM (SELECT * FROM g JOIN tot USING (condo_id, month, account))"),
    "a17_subset_sums": _with([*E, "it AS (SELECT condo_id, date_trunc('quarter', month) AS month, account, code, CAST(amount * 100 AS BIGINT) AS cents, amount, row_number() OVER (PARTITION BY condo_id, date_trunc('quarter', month), account ORDER BY ord, code) AS pos FROM expense WHERE ord % 3 = 0)", "g AS (SELECT condo_id, month, account, count(*) AS items, list_sort(list(amount)) AS a FROM it GROUP BY ALL)", "tg AS (SELECT *, CASE (condo_id + month(month)) % 4 WHEN 0 THEN a[1] + a[2] + a[3] WHEN 1 THEN a[1] + a[-1] WHEN 2 THEN a[2] + a[3] + a[4] + a[5] ELSE a[1] + a[3] + 0.05 END + CASE WHEN condo_id % 3 = 0 THEN 0.01 ELSE 0 END AS target, CAST(target * 100 AS BIGINT) AS want FROM g WHERE items >= 5)", "pr AS (SELECT x.condo_id, x.month, x.account, [x.pos, y.pos] AS m, x.cents + y.cents AS s FROM it x JOIN it y ON x.condo_id = y.condo_id AND x.month = y.month AND x.account = y.account AND x.pos < y.pos)", "lo AS (SELECT condo_id, month, account, [pos] AS m, cents AS s FROM it UNION ALL SELECT * FROM pr)", "hi AS (SELECT DISTINCT condo_id, month, account, []::BIGINT[] AS m, 0 AS s FROM it UNION ALL SELECT * FROM lo)", "so AS (SELECT condo_id, month, account, want + unnest([-1, 0, 1]) AS sought FROM tg)", "hit AS (SELECT l.condo_id, l.month, l.account, list_concat(l.m, h.m) AS m FROM so JOIN lo l USING (condo_id, month, account) JOIN hi h ON h.condo_id = l.condo_id AND h.month = l.month AND h.account = l.account AND h.s = so.sought - l.s WHERE len(h.m) = 0 OR h.m[1] > l.m[-1])", "best AS (SELECT condo_id, month, account, min({'n': len(m), 'm': m}) AS b FROM hit GROUP BY ALL)", "codes AS (SELECT condo_id, month, account, string_agg(code, ',' ORDER BY pos) AS codes FROM (SELECT condo_id, month, account, unnest(b.m) AS pos FROM best) JOIN it USING (condo_id, month, account, pos) GROUP BY ALL)"], f"SELECT condo_id, {M}, account, {_d('target')}, items, CAST(b.n AS BIGINT) AS used, codes FROM tg LEFT JOIN best USING (condo_id, month, account) LEFT JOIN codes USING (condo_id, month, account)"),
    "a20_merged_balance": _with([*A, _ISSUANCE, "b AS (SELECT condo_id, month, sum(opening) AS opening, sum(credits) AS credits, sum(debits) AS debits FROM account GROUP BY ALL)", "i AS (SELECT condo_id, month, sum(CASE WHEN kind = 'quota' AND condo_id % 10 <> 0 THEN amount ELSE 0 END) AS delinquent FROM income GROUP BY ALL)", "r AS (SELECT condo_id, month, CASE WHEN condo_id % 2 = 0 AND opening + 10 <> 0 THEN opening + 10 ELSE opening END AS opening, credits, debits, coalesce(delinquent, 0) AS delinquent FROM b LEFT JOIN i USING (condo_id, month))"], f"SELECT condo_id, {M}, {_d('opening')}, CAST(opening + credits - debits AS DOUBLE) AS closing, {_d('delinquent')} FROM r"),
    "a23_net_debits": _with([*A, RENAMED, *K[1:], "mo AS (SELECT condo_id, month, account, sum(amount) AS moved FROM named WHERE description LIKE 'TRANSF%' GROUP BY ALL)"], f"SELECT condo_id, {M}, account, CAST(debits - coalesce(moved, 0) AS DOUBLE) AS net_debits, {_d('yield_amt')} FROM (SELECT * FROM renamed LEFT JOIN mo USING (condo_id, month, account))"),
    "a24_income_source": _with([*A, "de AS (SELECT condo_id, month, account, sum(amount) AS detail, sum(amount) FILTER (amount > 0) AS positive FROM income GROUP BY ALL)"], f"SELECT condo_id, {M}, account, {_d('credits')}, CASE WHEN abs(detail - credits) <= 0.011 THEN 'detail' WHEN abs(positive - credits) <= 0.011 THEN 'positive' ELSE 'position' END AS source FROM (SELECT * FROM account LEFT JOIN de USING (condo_id, month, account))"),
    "a25_missing_tax_ids": _with([*DOCS], f"SELECT condo_id, {M}, code, CAST(amount AS DOUBLE) AS amount FROM (SELECT condo_id, month, code, bool_or(vendor IS NOT NULL OR (length(left(key, 4)) = 4 AND contains(upper(raw_text), left(key, 4)))) AS known, max(read_amount) AS amount FROM papers JOIN (SELECT DISTINCT condo_id, month, code, key, vendor FROM keyed) USING (condo_id, month, code) WHERE {PAY.replace('page_text', 'raw_text')} GROUP BY ALL) WHERE NOT known"),
    "a26_typed_evidence": _with([*DOCS], f"SELECT condo_id, {M}, code, kind, CASE WHEN kind IN ('invoice', 'payment') THEN 'verified' ELSE 'unverifiable' END AS verdict, CAST(CASE kind WHEN 'invoice' THEN 0.85 WHEN 'payment' THEN 1.0 WHEN 'slip' THEN 0.8 ELSE 0.4 END AS DOUBLE) AS confidence FROM (SELECT *, CASE WHEN raw_text = '' THEN 'blank' WHEN {PAY.replace('page_text', 'raw_text')} THEN 'payment' WHEN {INV.replace('page_text', 'raw_text')} THEN 'invoice' ELSE 'slip' END AS kind FROM papers)"),
}

"""SQL of the queries on what stands beside the entries and belongs to them."""

from __future__ import annotations

from tally.operators.assignment import ASKS_INVOICE, FUND_MANY, FUND_ONE, GENERIC, SHARED_NAMES, TRANSFER, UNSORTED
from tally.plans.oracle import _ACCOUNT, _BALANCE, _EXPENSE, _INCOME, _ISSUANCE, NORM, M, _d, _with
from tally.plans.oracle_matching import DOCS, INV, PAY
from tally.plans.oracle_more import INDICATOR
from tally.plans.oracle_named import NAMED, NF, _list

_ONES = "o AS (SELECT DISTINCT ON (code) * FROM named ORDER BY code, amount, paid, account, name, month)"
N = [_EXPENSE, NAMED, _ONES]
_COARSE = "x AS (SELECT *, CAST(floor(a / 10000) * 10000 AS DECIMAL(18,2)) AS amount FROM (SELECT DISTINCT ON (code) * EXCLUDE (amount), amount AS a FROM expense ORDER BY code, expense.amount, paid, account, month))"
_NUMBERED = "row_number() OVER (PARTITION BY condo_id, paid, abs(amount), {0} ORDER BY code) AS i"
_MONEY = "translate(format('{{:,.2f}}', CAST(abs({0}) AS DOUBLE)), ',.', '.,')"
_BARE = r"regexp_replace(regexp_replace({0}, '[.\s]', '', 'g'), '^0+(.)', '\1')"
_PAID = f"""e AS (
  SELECT condo_id, month, ord, code, amount, invoice, CASE WHEN ord % 5 = 0 THEN 'NF ' || invoice WHEN ord % 5 >= 2 THEN 'F ' || (ord % 7 + 100) END AS document,
    CASE ord % 17 WHEN 0 THEN 'BANCO DO SUL' WHEN 1 THEN 'RECEITA FEDERAL' ELSE name END AS name FROM o WHERE amount > 0
), sh AS (SELECT condo_id, month, document, sum(amount) AS s, min(ord) AS least FROM e WHERE document IS NOT NULL GROUP BY ALL HAVING count(*) > 1
), g AS (
  SELECT condo_id, month, ord AS grp, CASE ord % 4 WHEN 0 THEN 'Pagamento R$ ' || {_MONEY.format('amount')} WHEN 1 THEN 'Nota ' || invoice || ' ' || name ELSE 'Recibo ' || name END AS text FROM e WHERE ord % 4 <> 3 AND ord % 11 <> 0
  UNION ALL SELECT condo_id, month, least + 1000000000, 'Fatura R$ ' || {_MONEY.format('s')} FROM sh WHERE least % 2 = 0
), pairs AS (
  SELECT code, grp, 3 * CAST(list_contains(amounts, {_MONEY.format('amount')}) OR coalesce(list_contains(amounts, {_MONEY.format('s')}), false) AS INT)
      + 3 * CAST(list_has_any(regexp_extract_all(coalesce(document, ''), '[0-9]{{3,}}'), regexp_extract_all(text, '[0-9]{{3,}}')) AS INT) AS points,
    len(list_intersect(list_distinct(list_filter(string_split({NORM.format('name')}, ' '), lambda w: len(w) >= 4 AND NOT list_contains({_list(SHARED_NAMES)}, w))[1:3]), string_split({NORM.format('text')}, ' '))) AS hits
  FROM e LEFT JOIN sh USING (condo_id, month, document) JOIN (SELECT *, regexp_extract_all(text, '[0-9.]+,[0-9]{{2}}') AS amounts FROM g) USING (condo_id, month)
  WHERE NOT (name LIKE 'RECEITA FEDERAL%' OR (name LIKE 'BANCO %' AND document IS NULL))
), best AS (
  SELECT code, coalesce(max({{'points': points + least(2, hits), 'back': -grp}}) FILTER (points > 0), max({{'points': hits, 'back': -grp}}) FILTER (hits >= 2)) AS b FROM pairs GROUP BY ALL
)"""
_ITEMS = """i AS (
  SELECT condo_id, month, 'q' || code AS id, CASE ord % 6 WHEN 0 THEN 'new_vendor' WHEN 1 THEN 'new_category' ELSE 'late_payment' END AS kind, CASE WHEN ord % 7 = 0 THEN 'informative' ELSE 'open' END AS state, category, ord,
    CASE WHEN ord % 6 = 0 THEN 'Quem é e onde está a nota fiscal?' WHEN ord % 6 = 1 THEN 'Está correto?' WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN 'Houve aprovação em assembleia?' ELSE 'Por que o atraso?' END AS question
  FROM o WHERE ord % 6 <= 2
), c AS (
  SELECT condo_id, month, 'q' || code AS id, amount + unnest(CASE WHEN ord % 36 = 0 THEN [0, 0, 0.37] WHEN ord % 9 = 0 THEN [0, 0] WHEN ord % 12 = 0 THEN [0, 0.37] ELSE [0] END) AS amount, CASE WHEN ord % 8 = 0 THEN 9 ELSE ord % 3 END AS page, account
  FROM o WHERE ord % 6 <= 2
), h AS (SELECT condo_id, month, abs(amount) AS size, ord % 3 AS page, min({'ord': ord, 'code': code}) AS x FROM o GROUP BY ALL
), t AS (SELECT condo_id, month, abs(amount) AS size, min({'ord': ord, 'code': code}) AS y FROM o GROUP BY ALL
), f AS (
  SELECT condo_id, month, c.id, bool_and(coalesce(o.ord % 5 <> 0 AND o.ord % 14 <> 0, false)) AS proved, count(*) FILTER (c.account LIKE 'FUNDO DE RESERVA%') AS fund
  FROM (SELECT *, abs(amount) AS size FROM c) c LEFT JOIN h USING (condo_id, month, size, page) LEFT JOIN t USING (condo_id, month, size) LEFT JOIN (SELECT code, ord FROM o) o ON o.code = coalesce(x.code, y.code) GROUP BY ALL
), known AS (SELECT DISTINCT condo_id, category FROM o WHERE condo_id % 3 = 0 AND category LIKE 'DESPESAS%')"""
_ASKED = f"""CASE WHEN kind = 'new_category' AND state = 'open' AND condo_id IN (SELECT condo_id FROM known) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.condo_id = i.condo_id AND k.category = i.category)
  THEN 'A subconta "' || category || '" está sem categoria: em qual categoria de despesa do balancete ela deve ser classificada?' WHEN kind = 'new_vendor' AND proved THEN replace(question, '{ASKS_INVOICE}', '?') ELSE question END"""
_SUMMARY = """ca AS (SELECT condo_id, month, category, CAST(sum(amount) AS DECIMAL(28,2)) AS t FROM expense GROUP BY ALL
), sp AS (SELECT condo_id, month, sum(t) AS spent, string_agg(category || '=' || t, ';' ORDER BY category) AS categories FROM ca GROUP BY ALL
), inc AS (SELECT condo_id, month, sum(budget) AS budget, sum(collected) AS collected FROM issuance GROUP BY ALL
), su AS (SELECT *, CAST(opening + coalesce(collected, 0) - coalesce(spent, 0) AS DECIMAL(28,2)) AS final, year(month) * 12 + month(month) AS no FROM balance LEFT JOIN inc USING (condo_id, month) LEFT JOIN sp USING (condo_id, month) LEFT JOIN indicator USING (condo_id, month))"""
SQL = {
    "r3_position_differs": _with([_INCOME, _ISSUANCE, "p AS (SELECT condo_id, month, CASE WHEN condo_id % 7 = 0 AND line = 'OUTRA' THEN 'AVULSA' ELSE line END AS line, collected + CASE WHEN condo_id % 6 = 0 THEN 5 ELSE 0 END AS position FROM issuance)"], f"SELECT condo_id, {M}, line, {_d('position')}, CAST(coalesce(collected, 0) AS DOUBLE) AS collected FROM p LEFT JOIN issuance USING (condo_id, month, line) WHERE abs(position) > 0.011 AND abs(position - coalesce(collected, 0)) > 1 AND EXISTS (SELECT 1 FROM issuance q WHERE q.condo_id = p.condo_id AND date_diff('month', q.month, p.month) BETWEEN 1 AND 6)"),
    "j11_invoice_elsewhere": _with([*DOCS, f"li AS (SELECT DISTINCT condo_id, month, code, {_BARE.format(NF)} AS number, list_filter(regexp_extract_all({NORM.format('description')}, '[A-Z]{{3,}}'), lambda w: NOT list_contains({_list(GENERIC)}, w)) AS words FROM keyed WHERE {NF} <> '')", f"nums AS (SELECT DISTINCT condo_id, month, code AS holder, {NORM.format('page_text')} AS said, {_BARE.format('n')} AS number FROM (SELECT *, unnest(list_concat(regexp_extract_all(page_text, '[0-9]+'), regexp_extract_all(page_text, '[0-9]+[.\\s][0-9]{{3}}\\b'))) AS n FROM pages WHERE {INV} AND NOT {PAY}))"], f"SELECT DISTINCT condo_id, {M}, code, number FROM li JOIN nums USING (condo_id, month, number) WHERE holder <> code AND (len(words) = 0 OR len(list_filter(words, lambda w: contains(said, w))) > 0)"),
    "j13_content_match": _with([*N, _PAID], f"SELECT condo_id, {M}, code, CAST(-b.back AS BIGINT) AS \"group\", CAST(b.points AS BIGINT) AS points FROM e LEFT JOIN best USING (code)"),
    "j15_ledger_entries": _with([_EXPENSE, _COARSE, f"e AS (SELECT condo_id, month, code, amount, category, paid, amount > 0 AS debit, {_NUMBERED.format('amount > 0')} FROM x WHERE ord % 13 <> 0)", f"l AS (SELECT condo_id, month, code, -amount AS amount, account, paid, ord, amount > 0 AS debit, {_NUMBERED.format('amount > 0')} FROM x WHERE ord % 7 <> 0)", "first AS (SELECT condo_id, month, min(account) AS fa FROM l WHERE debit GROUP BY ALL)"], f"SELECT condo_id, {M}, e.code, CAST(e.amount AS DOUBLE) AS amount, category, coalesce(account, fa) AS account, CASE WHEN account IS NULL THEN 'first_account' ELSE 'ledger' END AS source FROM e LEFT JOIN (SELECT condo_id AS lc, paid AS lp, abs(amount) AS la, debit AS ld, i AS li, account FROM l) ON lc = condo_id AND lp = paid AND la = abs(amount) AND ld = debit AND li = i LEFT JOIN first USING (condo_id, month) UNION ALL SELECT condo_id, {M}, 'L' || code, CAST(abs(amount) AS DOUBLE), CASE WHEN ord % 5 = 0 THEN '{TRANSFER}' ELSE '{UNSORTED}' END, account, 'left_over' FROM l WHERE debit AND NOT EXISTS (SELECT 1 FROM e WHERE e.condo_id = l.condo_id AND e.paid = l.paid AND e.amount = -l.amount AND e.debit AND e.i = l.i)"),
    "j22_resolved_evidence": _with(N, f"SELECT condo_id, {M}, code, CASE ord % 10 WHEN 1 THEN 'weak' WHEN 4 THEN 'read' WHEN 5 THEN 'read' WHEN 6 THEN 'empty' WHEN 7 THEN 'read' ELSE 'confirmed' END AS state, CASE WHEN ord % 10 <> 6 THEN CAST(1 AS BIGINT) END AS page, CAST(CASE ord % 10 WHEN 4 THEN amount + 30 WHEN 5 THEN amount + 10 WHEN 6 THEN NULL WHEN 7 THEN amount + 5 ELSE amount END AS DOUBLE) AS amount FROM o WHERE amount > 0"),
    "a29_account_scope": _with([_EXPENSE], f"SELECT condo_id, {M}, category, CAST(sum(amount) AS DOUBLE) AS total FROM (SELECT condo_id, month, amount, CASE WHEN condo_id % 5 = 1 AND account = 'FUNDO DE RESERVA' THEN 'Reserva' WHEN condo_id % 5 = 1 AND account = 'FUNDO DE OBRAS' THEN account WHEN condo_id % 5 = 2 AND account = 'FUNDO DE OBRAS' THEN 'Obras' ELSE category END AS category FROM expense WHERE NOT (condo_id % 5 = 0 AND account = 'FUNDO DE OBRAS') AND NOT (condo_id % 5 = 2 AND account = 'FUNDO DE RESERVA')) AS k GROUP BY condo_id, k.month, category"),
    "a22_summary_totals": _with([_EXPENSE, _INCOME, _ACCOUNT, _BALANCE, _ISSUANCE, INDICATOR, _SUMMARY], f"SELECT condo_id, {M}, {_d('budget', 'collected', 'spent', 'opening', 'delinquent')}, categories, CAST(final AS DOUBLE) AS balance, coalesce(array_to_string(list(strftime(su.month, '%Y-%m') || '=' || final) OVER (PARTITION BY condo_id ORDER BY no RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), ';'), '') AS history FROM su"),
    "p8_adjusted_questions": _with([*N, _ITEMS], f"SELECT condo_id, {M}, id, kind, state, CASE WHEN state = 'open' AND trim(asked) <> '' AND NOT contains(lower(asked), 'assembleia') AND fund > 0 THEN asked || CASE WHEN fund > 1 THEN '{FUND_MANY}' ELSE '{FUND_ONE}' END ELSE asked END AS question FROM (SELECT i.*, fund, {_ASKED} AS asked FROM i JOIN f USING (condo_id, month, id))"),
    "p10_displayed_values": _with(N, f"SELECT condo_id, {M}, code, 'divergent_amount' AS type, CAST(amount + CASE WHEN ord % 8 = 0 THEN 9 WHEN ord % 4 = 0 THEN 7 WHEN ord % 5 <> 0 THEN 100 ELSE 0 END AS DOUBLE) AS value FROM o WHERE ord % 6 <= 1 AND ord % 7 <> 0"),
    "s8_block_entries": _with([_EXPENSE], f"SELECT condo_id, {M}, CAST(1 AS BIGINT) AS block, account, category AS sub, description, {_d('amount')} FROM expense"),
    "s8_block_totals": _with([_EXPENSE], f"SELECT condo_id, {M}, CAST(1 AS BIGINT) AS block, account, sub, {_d('items')}, CAST(items + CASE WHEN condo_id % 8 = 0 AND sub IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS declared, NOT (condo_id % 8 = 0 AND sub IS NOT NULL) AS closes FROM (SELECT condo_id, month, account, category AS sub, sum(amount) AS items FROM expense GROUP BY ALL UNION ALL SELECT condo_id, month, account, NULL, sum(amount) FROM expense GROUP BY ALL)"),
    "f30_receipt_keys": _with(N, f"SELECT condo_id, {M}, code, CASE ord % 4 WHEN 1 THEN 'DEBITO ' || name WHEN 3 THEN name END AS ident, CASE WHEN ord % 4 = 1 THEN 'ABC' || lpad(CAST(ord AS VARCHAR), 12, '0') END AS auth, CASE WHEN ord % 4 = 0 THEN '1001 AGUA ' || name || ' CHAPA 77' ELSE '' END AS complement FROM o"),
}

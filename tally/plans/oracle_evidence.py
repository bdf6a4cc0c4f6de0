"""SQL of the queries on what attachments prove."""

from __future__ import annotations

from tally.plans.oracle import _EXPENSE, M, _d, _with

_ONE = """e AS (
  SELECT condo_id, month, ord, code, amount, category, CASE WHEN ord % 3 <> 0 THEN 'Limpeza mensal' ELSE ['ENEL DISTRIBUICAO', 'Água e Esgoto - conta', 'Claro', 'Gás natural'][ord % 4 + 1] END AS name,
    CASE ord % 4 WHEN 1 THEN '' WHEN 2 THEN '123456 10/02/1995 ' ELSE '10/02/1995 ' END || name || CASE WHEN ord % 4 = 3 THEN ' 1.234,56 0013' ELSE '' END AS description
  FROM (SELECT DISTINCT ON (code) * FROM expense ORDER BY code, amount, paid, account, month)
)"""
_STATE = "CASE ord % 8 WHEN 1 THEN 'payment_only' WHEN 2 THEN 'bill' WHEN 4 THEN 'bill' WHEN 5 THEN 'payment_only' WHEN 6 THEN CASE WHEN amount > 0 THEN 'payment_only' ELSE 'unknown' END ELSE 'unknown' END"
_SENT = "s AS (SELECT * FROM e WHERE ord % 11 <> 0 AND ord % 8 = 1 AND ord % 5 = 0), n AS (SELECT condo_id, month, count(*) AS items, sum(amount) AS total FROM s WHERE ord % 7 <> 0 GROUP BY ALL HAVING count(*) >= 2)"
E = [_EXPENSE, _ONE]
_KEY = "regexp_replace(lower({0}), '\\W+', '', 'g')"
_CHECKS = "v AS (SELECT condo_id, month, check_name, applied AND NOT (condo_id % 4 = 0 AND check_name = 'duplicate') AS applied FROM (SELECT DISTINCT condo_id, month, CASE WHEN (condo_id + month(month)) % 11 = 0 THEN 'xlsx' ELSE 'pdf' END AS format FROM expense) JOIN (VALUES ('pdf', 'duplicate', true), ('pdf', 'unverifiable', true), ('xlsx', 'duplicate', true), ('xlsx', 'unverifiable', false)) AS p(format, check_name, applied) USING (format))"
_FINDINGS = "f AS (SELECT condo_id, month, code, CASE WHEN ord % 6 = 0 THEN 'unverifiable' ELSE 'duplicate' END AS type, amount FROM e WHERE ord % 6 <= 1)"
SQL = {
    "f38_clean_descriptions": _with(E, "SELECT description, count(*) AS n, name AS clean, CAST(0 AS BIGINT) + CASE WHEN name LIKE '%conta' THEN 1 ELSE 0 END AS words, name LIKE 'ENEL%' OR name = 'Claro' OR (name LIKE 'Água%' AND ord % 4 <> 2) AS utility FROM e GROUP BY ALL"),
    "f32_attachment_states": _with(E, f"SELECT condo_id, {M}, code, {_STATE} AS state FROM e WHERE ord % 11 <> 0"),
    "a14_documents_not_sent": _with([*E, _SENT], f"SELECT condo_id, {M}, code, name AS description, items, {_d('amount', 'total')} FROM s JOIN n USING (condo_id, month) WHERE ord % 7 <> 0"),
    "a15_utility_bills": _with([*E, _SENT, f"u AS (SELECT * FROM e WHERE ord % 11 <> 0 AND ord % 7 <> 0 AND ord % 3 = 0 AND name <> 'Gás natural' AND {_STATE} = 'payment_only' AND NOT (ord % 8 = 1 AND ord % 5 = 0 AND EXISTS (SELECT 1 FROM n WHERE n.condo_id = e.condo_id AND n.month = e.month)))"], f"SELECT condo_id, {M}, code, name AS description, {_d('amount')}, count(*) OVER w AS items, CAST(sum(amount) OVER w AS DOUBLE) AS total FROM u WINDOW w AS (PARTITION BY condo_id, u.month)"),
    "j18_lost_signs": _with([_EXPENSE, f"o AS (SELECT condo_id, month, ord, abs(amount) AS size, CASE WHEN ord % 3 = 0 THEN abs(amount) ELSE amount END AS shown, {_KEY.format('description')} AS said, ord % 4 = 0 AS other FROM expense)", f"p AS (SELECT DISTINCT condo_id, month, code, amount, left({_KEY.format('description')}, 20) AS start FROM expense WHERE amount < 0)"], f"SELECT condo_id, {M}, code, {_d('amount', 'shown')} FROM (SELECT p.condo_id, p.month, p.code, p.amount, min({{'ord': o.ord, 'shown': o.shown}}).shown AS shown FROM p JOIN o ON o.condo_id = p.condo_id AND o.month = p.month AND o.size = -p.amount AND NOT o.other AND contains('doc' || o.said, p.start) GROUP BY ALL) WHERE shown > 0"),
    "u5_link_only": _with([*E, _FINDINGS, "l AS (SELECT condo_id, month, bool_and(condo_id % 5 = 0 OR (condo_id % 5 = 1 AND ord % 2 = 0)) AS links FROM e GROUP BY ALL)"], f"SELECT condo_id, {M}, code, type, {_d('amount')} FROM f JOIN l USING (condo_id, month) WHERE NOT (links AND type = 'unverifiable')"),
    "p7_new_categories_told": _with([*E, "h AS (SELECT condo_id, month, 'a' || code AS id, category, amount, CASE WHEN ord % 5 = 0 THEN 'informative' ELSE 'open' END AS state FROM e WHERE ord % 11 = 0)", "w AS (SELECT condo_id, month, 'b' || code AS id, category, lower(category) AS named, CAST(amount + CASE WHEN ord % 8 = 0 THEN 0.02 WHEN ord % 4 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS amount, ord % 3 <> 0 AS single FROM e WHERE ord % 22 = 0)", "c AS (SELECT w.condo_id, w.month, w.id AS source, min(h.id) AS id, min(named) AS named FROM w JOIN h ON h.condo_id = w.condo_id AND h.month = w.month AND h.category = w.category AND abs(h.amount - w.amount) <= 0.01 WHERE single AND h.state = 'open' GROUP BY ALL)"], f"SELECT condo_id, {M}, id, 'missing_evidence' AS type, {_d('amount')}, state, 'Sem comprovante.' || coalesce(' Também em subconta nova: ' || (SELECT min(named) FROM c WHERE c.condo_id = h.condo_id AND c.month = h.month AND c.id = h.id) || '.', '') AS body FROM h UNION ALL SELECT condo_id, {M}, id, 'new_category', {_d('amount')}, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.condo_id = w.condo_id AND c.month = w.month AND c.source = w.id) THEN 'informative' ELSE 'open' END, 'Subconta nova.' FROM w"),
    "u6_verification_list": _with([_EXPENSE, _CHECKS], f'SELECT condo_id, {M}, check_name AS "check", applied FROM v'),
    "u4_under_profile": _with([*E, _FINDINGS, _CHECKS], f"SELECT condo_id, {M}, code, type, {_d('amount')} FROM f WHERE EXISTS (SELECT 1 FROM v WHERE v.condo_id = f.condo_id AND v.month = f.month AND v.check_name = f.type AND v.applied)"),
}

"""SQL of the queries over files and what they say."""

from __future__ import annotations

from tally.operators.file_identity import BALANCE_WORDS, SEEN, SUFFIX
from tally.operators.matching import ACCOUNT_STOP
from tally.plans.oracle import _ACCOUNT, _EXPENSE, _INCOME, NORM, E, M, _with
from tally.plans.oracle_audits import CALENDAR
from tally.plans.oracle_named import KEY, NAMED, NF, RENAMED, A, _list, kind
from tally.sources.files import CANONICAL, WRITTEN

BUILDINGS = """buildings AS (
  SELECT n_nationkey AS condo_id, 'Edifício ' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN ' II' ELSE '' END AS name, n_nationkey % 6 = 1 AS nameless FROM nation WHERE n_nationkey < 20
), aliases AS (SELECT n_nationkey AS condo_id, 'Cond. ' || left(n_name, 4) || ' X' AS alias FROM nation WHERE n_nationkey % 3 <> 0)"""
HEADERS = """headers AS (
  SELECT m.condo_id || '-' || strftime(m.month, '%Y%m') AS file, m.condo_id, CASE (m.condo_id + year(m.month) * 12 + month(m.month)) % 8
    WHEN 0 THEN 'Prestação de contas - ' || b.name || ' saldo' WHEN 1 THEN 'DEMONSTRATIVO ' || coalesce(l.alias, o.name) || ' DESPESAS' WHEN 2 THEN 'Saldo de ' || o.name || ' receitas'
    WHEN 3 THEN 'saldo ' || b.name WHEN 4 THEN 'SALDO E DESPESAS' WHEN 5 THEN 'Saldo, despesas: Condomínio Outro Qualquer ' || month(m.month)
    WHEN 6 THEN 'SALDO DESPESAS A' || b.name || 'S' ELSE 'receitas saldo ' || regexp_replace(b.name, ' II$', '') END AS text
  FROM (SELECT DISTINCT condo_id, month FROM expense) m JOIN buildings b USING (condo_id) JOIN buildings o ON o.condo_id = (m.condo_id + 1) % 20 LEFT JOIN aliases l ON l.condo_id = m.condo_id
)"""
PHRASES = f"""phrases AS (
  SELECT condo_id, {NORM.format('name')} AS phrase, length({NORM.format('name')}) >= 3 AS own, length({NORM.format('name')}) >= 7 AS other FROM buildings
  UNION ALL SELECT condo_id, regexp_replace({NORM.format('name')}, '{SUFFIX}', ''), true, false FROM buildings UNION ALL SELECT condo_id, {NORM.format('alias')}, true, false FROM aliases
)"""
IDENTITY = f"""plain AS (SELECT file, condo_id, {NORM.format('text')} AS text FROM headers),
hits AS (SELECT p.file, p.condo_id, n.condo_id AS named, n.phrase, n.own, n.other FROM plain p JOIN phrases n ON length(n.phrase) >= 3 AND contains(' ' || p.text || ' ', ' ' || n.phrase || ' ')),
seen AS (SELECT file, bool_or(named = condo_id AND own) AS is_own, list_sort(list(DISTINCT {{'named': named, 'phrase': phrase}}) FILTER (named <> condo_id AND other)) AS others FROM hits GROUP BY ALL),
judged AS (
  SELECT p.*, s.others, CASE WHEN {' + '.join(f"contains(text, '{w}')::INT" for w in BALANCE_WORDS)} < 2 THEN 'unreadable' WHEN coalesce(is_own, false) THEN 'own'
    WHEN nameless AND coalesce(len(others), 0) = 0 THEN 'nameless' WHEN coalesce(len(others), 0) > 0 THEN 'other' ELSE 'unnamed' END AS reason
  FROM plain p LEFT JOIN seen s USING (file) LEFT JOIN buildings b USING (condo_id)
)"""
_WORDS = f"list_distinct(list_filter(string_split({{0}}, ' '), lambda t: t <> '' AND NOT list_contains({_list(ACCOUNT_STOP)}, t)))"
RESOLVED = f"""pr AS (
  SELECT n.condo_id, n.month, name, known, {NORM.format('name')} AS nn, {NORM.format('known')} AS kn, {KEY('name')} AS nk, {KEY('known')} AS kk FROM (SELECT DISTINCT * FROM nw) n JOIN (SELECT DISTINCT * FROM kw) k ON k.condo_id = n.condo_id AND k.month = n.month
), pw AS (SELECT *, {_WORDS.format('nn')} AS nt, {_WORDS.format('kn')} AS kt FROM pr), lv AS (
  SELECT condo_id, month, name, known, 1 AS lvl, 1.0::DOUBLE AS lk FROM pw WHERE nn = kn
  UNION ALL SELECT condo_id, month, name, known, 2, 1.0 FROM pw WHERE nk = kk
  UNION ALL SELECT condo_id, month, name, known, 3, 1.0 FROM pw WHERE least(len(nk), len(kk)) >= 6 AND (starts_with(nk, kk) OR starts_with(kk, nk))
  UNION ALL SELECT condo_id, month, name, known, 4, 1.0 FROM pw WHERE len(nt) > 0 AND len(kt) > 0 AND len(list_intersect(nt, kt)) = least(len(nt), len(kt))
  UNION ALL SELECT condo_id, month, name, known, 5, 1 - levenshtein(nn, kn) / CAST(greatest(len(nn), len(kn)) AS DOUBLE) FROM pw WHERE levenshtein(nn, kn) * 100 <= 23 * greatest(len(nn), len(kn)) AND nn <> '' AND kn <> ''
), tops AS (
  SELECT condo_id, month, name, lvl, count(*) AS n, min(known) AS least, max({{'lk': lk, 'known': known}}) AS best, list_sort(list(lk), 'DESC') AS lks FROM lv GROUP BY ALL
), sure AS (
  SELECT condo_id, month, name, min({{'lvl': lvl, 'known': CASE WHEN lvl = 5 THEN best.known ELSE least END}}) AS x FROM tops
  WHERE lvl <= 2 OR (lvl <= 4 AND n = 1) OR (lvl = 5 AND best.lk >= 0.82 AND (len(lks) = 1 OR lks[1] - lks[2] >= 0.05)) GROUP BY ALL
)"""
_RESOLVED = f"SELECT condo_id, {M}, name, coalesce(x.known, name) AS canonical, CAST(x.lvl AS BIGINT) AS level FROM (SELECT DISTINCT * FROM nw) LEFT JOIN sure USING (condo_id, month, name)"
MONTHS = "months AS (SELECT DISTINCT condo_id, month FROM expense)"
RESIDUALS = """base AS (SELECT condo_id, month, debits, condo_id + year(month) * 12 + month(month) AS k, (100 + (condo_id + year(month) * 12 + month(month)) % 50) * 100 AS b FROM account WHERE account = 'ORDINARIA'),
shares AS (SELECT * FROM (VALUES ('FUNDO DE RESERVA', [10, 6, 10, 6, 10, 10]), ('FUNDO DE OBRAS', [0, 4, 10, 4, 6, 10]), ('POUPANCA', [0, 0, 0, 7, 4, 6]), ('CAIXA', [0, 0, 0, 3, 0, 4])) AS v(account, tenths)),
credit AS (SELECT condo_id, month, account, b * tenths[k % 6 + 1] // 10 AS c FROM base, shares WHERE tenths[k % 6 + 1] > 0),
one AS (SELECT b.condo_id, b.month, min({'account': account, 'c': c}) AS x FROM base b JOIN credit USING (condo_id, month) WHERE abs(c - b) <= 1 GROUP BY ALL HAVING count(*) = 1),
two AS (SELECT b.condo_id, b.month, min({'account': p.account, 'c': p.c}) AS x, min({'account': q.account, 'c': q.c}) AS y FROM base b JOIN credit p USING (condo_id, month) JOIN credit q ON q.condo_id = b.condo_id AND q.month = b.month AND p.account < q.account WHERE abs(p.c + q.c - b) <= 1 GROUP BY ALL HAVING count(*) = 1),
legs AS (SELECT condo_id, month, x, 'single' AS kind FROM one UNION ALL SELECT condo_id, month, unnest([x, y]), 'pair' FROM two ANTI JOIN one USING (condo_id, month))"""
BOOK = f"""{NAMED}, book AS (
  SELECT condo_id, month, ord, code, upper(trim(coalesce(vendor, ''))) AS vendor, CASE WHEN ord % 3 <> 0 THEN CAST(invoice AS VARCHAR) END AS document, due, paid, amount, category, description,
    CASE WHEN ord % 6 = 0 THEN '' ELSE 'Nota fiscal ' || CASE WHEN ord % 4 = 0 THEN 'ilegivel' ELSE CAST(invoice AS VARCHAR) END || CASE WHEN ord % 503 = 0 THEN chr(10) || 'Complemento: CHAPA ' || (ord % 2) ELSE '' END END AS text,
    ord % 37 = 0 AS is_summary
  FROM named WHERE amount > 0
)"""
CHECKS = f"""sums AS (SELECT condo_id, month, sum(amount) AS total, count(*) AS n FROM book GROUP BY ALL),
cats AS (SELECT condo_id, month, year(month) * 12 + month(month) AS no, {NORM.format('category')} AS category, sum(amount) AS amount, count(*) AS n FROM book GROUP BY ALL),
every AS (
  SELECT condo_id, month, 'duplicate' AS check_, 'attention' AS severity, 0.8::DOUBLE AS confidence, min(code) AS subject, amount, count(*) AS n FROM book GROUP BY condo_id, month, vendor, coalesce(document, CAST(due AS VARCHAR)), amount HAVING count(*) >= 2
  UNION ALL SELECT condo_id, month, 'declared_total', 'critical', 1.0, strftime(month, '%Y-%m'), -0.05, n FROM sums WHERE (condo_id + year(month) * 12 + month(month)) % 7 = 0
  UNION ALL SELECT condo_id, month, 'late', CASE WHEN paid - business > 30 THEN 'high' ELSE 'attention' END, 1.0, code, amount, paid - business FROM book JOIN business USING (due) WHERE paid - business BETWEEN 1 AND 120
  UNION ALL SELECT condo_id, month, 'invoice', 'attention', 0.7, code, amount, 1 FROM book WHERE NOT is_summary AND {NF} <> '' AND NOT {kind('description', 'withholding')} AND NOT regexp_matches(text, '(^|[^0-9])0*' || CASE WHEN len({NF}) >= 4 THEN left({NF}, -3) || '[.\\s]?' || right({NF}, 3) ELSE {NF} END || '([^0-9]|$)')
  UNION ALL SELECT condo_id, month, 'category', 'informative', 0.5, category, amount, n FROM cats c WHERE EXISTS (SELECT 1 FROM cats p WHERE p.condo_id = c.condo_id AND p.no BETWEEN c.no - 6 AND c.no - 1) AND NOT EXISTS (SELECT 1 FROM cats p WHERE p.condo_id = c.condo_id AND p.category = c.category AND p.no BETWEEN c.no - 6 AND c.no - 1)
)"""

SQL = {
    "s6_file_identity": _with([*E, BUILDINGS, HEADERS, PHRASES, IDENTITY], f"SELECT file, condo_id, CASE reason WHEN 'own' THEN 'ok' WHEN 'unreadable' THEN 'warn' WHEN 'nameless' THEN 'warn' ELSE 'refuse' END AS state, reason, CASE reason WHEN 'other' THEN array_to_string(list_transform(others[1:3], lambda x: x.phrase), ', ') WHEN 'unnamed' THEN coalesce(nullif(trim(regexp_extract(text, '{SEEN}')), ''), left(text, 80)) END AS says FROM judged"),
    "j16_resolved_names": _with([*E, MONTHS, f"nw AS (SELECT condo_id, month, unnest({_list(WRITTEN)}) AS name FROM months)", f"kw AS (SELECT condo_id, month, known FROM (SELECT condo_id, month, unnest({_list(CANONICAL)}) AS known, unnest(range({len(CANONICAL)})) AS pos FROM months) WHERE (pos + condo_id + year(month) * 12 + month(month)) % {len(CANONICAL)} <> 0)", RESOLVED], _RESOLVED),
    "j16_canonical_names": _with([*A, "nw AS (SELECT condo_id, month, account AS name FROM renamed)", "kw AS (SELECT condo_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, account AS known FROM renamed)", RESOLVED], _RESOLVED),
    "j24_inferred_transfers": _with([_EXPENSE, _INCOME, _ACCOUNT, RESIDUALS], f"SELECT condo_id, {M}, 'ORDINARIA' AS from_account, x.account AS to_account, x.c / 100.0 AS amount, kind, 'transferência recebida de ORDINARIA' AS description, CAST(debits - b / 100.0 AS DOUBLE) AS net_debits FROM legs JOIN base USING (condo_id, month)"),
    "q3_untraced_descriptions": _with([*E, f"lines AS (SELECT condo_id, month, ord * 2 AS o, code || '  ' || left(description, length(description) - 12) AS line FROM expense WHERE ord % 13 <> 0 UNION ALL SELECT condo_id, month, ord * 2 + 1, right(description, 12) FROM expense WHERE ord % 13 <> 0)", f"texts AS (SELECT condo_id, month, string_agg({KEY('line')}, '' ORDER BY o, {KEY('line')}) AS txt FROM lines GROUP BY ALL)", "cited AS (SELECT condo_id, month, code, CASE WHEN ord % 15 = 0 THEN 'x' || description WHEN ord % 20 = 0 THEN substr(description, 8, 40) ELSE description END AS description FROM expense WHERE ord % 5 = 0)"], f"SELECT c.condo_id, strftime(c.month, '%Y-%m') AS month, code, description FROM cited c LEFT JOIN texts t USING (condo_id, month) WHERE length({KEY('left(description, 25)')}) >= 8 AND NOT contains(coalesce(txt, ''), {KEY('left(description, 25)')})"),
    "a27_cash_book": _with([*E, *CALENDAR, BOOK, CHECKS], f"SELECT condo_id, {M}, check_ AS check, severity, confidence, subject, CAST(amount AS DOUBLE) AS amount, CAST(n AS BIGINT) AS n FROM every WHERE condo_id % 4 <> 3 AND check_ <> ['duplicate', 'declared_total', 'late', 'invoice', 'category'][condo_id % 5 + 1]"),
}

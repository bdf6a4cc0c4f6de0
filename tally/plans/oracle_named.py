"""SQL of the rules over entries whose names, accounts and categories change."""

from __future__ import annotations

from tally.functions.identity import BANK_CHARGE, BANK_FEE, COMPETENCE, GENERIC, KINDS, MONTHS, NOISE, QUOTA_WAIVER, TAX, UTILITY_WORDS
from tally.plans.oracle import _ACCOUNT, _EXPENSE, _INCOME, NORM, E, M, _d, _with


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def up(x: str) -> str:
    return f"upper(strip_accents(coalesce({x}, '')))"


def kind(x: str, name: str) -> str:
    return f"regexp_matches({up(x)}, '{KINDS[name]}')"


def terms(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(regexp_replace({NORM.format(f'coalesce({x}, chr(0))')}, '[0-9]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: len(t) > 1 AND NOT list_contains({_list(NOISE)}, t))"


NAMED = """named0 AS (
  SELECT *, year(month) * 12 + month(month) AS no,
    upper(string_split(split_part(description, ' - ', 1), ' ')[2]) || CASE WHEN ord % 19 = 0 THEN 'S ' ELSE ' ' END || translate(right(vendor, 4), '0123456789', 'ABCDEFGHIJ') AS name
  FROM expense
), named AS (
  SELECT condo_id, month, no, ord, code, amount, invoice, inst_n, due, paid, name,
    CASE WHEN ord % 5 = 0 OR ord % 23 = 4 THEN NULL WHEN no % 3 = 0 THEN name || ' LTDA' WHEN no % 3 = 1 THEN name || ' ME' ELSE name END AS vendor,
    CASE ord % 23 WHEN 0 THEN 'INSS RETENCAO NF. ' || invoice WHEN 1 THEN 'TARIFA BANCARIA' WHEN 2 THEN 'CONTA DE ENERGIA TARIFA ' || name WHEN 3 THEN 'TRANSF P/ CTA APLIC'
      WHEN 4 THEN '' WHEN 5 THEN 'SALARIO ' || name WHEN 6 THEN 'FERIAS ' || name WHEN 7 THEN 'COMPRA AMAZON ' || name WHEN 8 THEN 'APROP ' || name || ' NF. ' || invoice
      WHEN 9 THEN 'PAGAMENTO DIVERSO' WHEN 10 THEN 'ISENCAO - RECIBO: ' || invoice
      ELSE CASE WHEN ord % 5 = 0 THEN 'MANUT - ' || name || ' - NF. ' || invoice WHEN ord % 7 = 0 THEN name || ' REF ' || strftime(month - INTERVAL 1 MONTH, '%m/%Y') ELSE name || ' CONSERTO' END
        || CASE WHEN inst_n IS NOT NULL THEN ' PARC ' || inst_n || '/7' ELSE '' END END AS description,
    CASE WHEN ord % 29 = 0 THEN 'AVULSO ' || name ELSE 'DESPESAS ' || category || CASE WHEN no % 2 = 0 THEN '' ELSE ' E OUTROS' END END AS category,
    account || CASE WHEN no % 2 = 0 THEN '' ELSE ' APLIC' END AS account
  FROM named0
)"""
_PARTS = r"list_filter(regexp_split_to_array(coalesce(description, ''), '\s+-\s+'), lambda p: trim(p) <> '')"
_NAMES = f"list_filter(list_transform(list_concat([coalesce(vendor, '')], CASE WHEN len(parts) >= 3 THEN list_concat([parts[2], parts[len(parts)], parts[1]], parts[3:len(parts) - 1]) ELSE parts END), lambda p: {terms('p')}), lambda t: len(t) > 0)"
KEYED = f"""keyed AS (
  SELECT *, coalesce(array_to_string(names[1][1:2], ' '), {NORM.format("coalesce(description, '')")}) AS key FROM (SELECT *, {_NAMES} AS names FROM (SELECT *, {_PARTS} AS parts FROM named))
), valid AS (
  SELECT * FROM keyed WHERE amount > 0.011 AND NOT (regexp_matches({NORM.format('category')}, '^(TRANSFERENCIA|APLICACAO RESGATE)') OR {kind('description', 'withholding')})
)"""
RENAMED = "renamed AS (SELECT * REPLACE (account || CASE WHEN no % 2 = 0 THEN '' ELSE ' APLIC' END AS account) FROM (SELECT *, year(month) * 12 + month(month) AS no FROM account))"
STATEMENTS = """statements AS (
  SELECT condo_id, month, CASE WHEN (condo_id + year(month)) % 9 = 0 THEN 'B' ELSE 'A' END AS variant, CASE WHEN (condo_id + month(month)) % 11 = 0 THEN 'xlsx' ELSE 'pdf' END AS suffix,
    condo_id % 10 <> 3 AS has_income, condo_id % 10 <> 4 AS has_yield, condo_id % 10 <> 5 AS has_entries
  FROM (SELECT DISTINCT condo_id, month FROM expense)
)"""
CONFIG = """base AS (
  SELECT DISTINCT condo_id, unnest(['R4', 'R10', 'R8', 'R9', 'G']) AS rule, unnest(['min', 'active', 'active', 'active', 'active']) AS param, unnest(['1000', 'false', 'true', 'true', 'true']) AS value FROM expense
), overlay AS (
  SELECT DISTINCT condo_id, unnest(['R4', 'R10', 'R7']) AS rule, unnest(['min', 'active', 'months']) AS param, unnest(['5000', 'true', '4']) AS value FROM expense WHERE condo_id % 4 = 0
  UNION ALL SELECT DISTINCT condo_id, 'R9', 'active', 'false' FROM expense WHERE condo_id % 4 <> 0 AND condo_id % 7 = 0
), config AS (SELECT condo_id, rule, param, coalesce(o.value, b.value) AS value FROM base b FULL JOIN overlay o USING (condo_id, rule, param))"""
KEY = lambda x: f"regexp_replace(upper(strip_accents({x})), '[^A-Z0-9]', '', 'g')"
SAME_ACCOUNT = f"({KEY('a.account')} = {KEY('p.account')} OR (least(len({KEY('a.account')}), len({KEY('p.account')})) >= 8 AND (starts_with({KEY('a.account')}, {KEY('p.account')}) OR starts_with({KEY('p.account')}, {KEY('a.account')}))))"


def same_category(a: str, b: str) -> str:
    na, nb = NORM.format(a), NORM.format(b)
    one = lambda s, g: f"((len({s}) >= 8 AND starts_with({g}, {s})) OR (len({s}) >= 7 AND starts_with({g}, {s} || ' ')))"
    return f"({na} = {nb} OR (len({na}) <= len({nb}) AND {one(na, nb)}) OR (len({nb}) < len({na}) AND {one(nb, na)}))"


N = [*E, NAMED]
K = [*N, KEYED]
A = [_EXPENSE, _INCOME, _ACCOUNT, RENAMED]
WORDS = f"list_filter(list_filter(list_distinct_in_order, lambda t: len(t) >= 3 AND NOT list_contains({_list(GENERIC)}, t) AND NOT list_contains({_list(MONTHS)}, left(t, 3))), lambda t, i: len(t) >= 4 OR i = 1)[1:3]"
_ORDERED = f"list_transform(list_sort(list_distinct(list_transform(raw, lambda t: [lpad(CAST(list_position(raw, t) AS VARCHAR), 4, '0'), t]))), lambda x: x[2])"
TELLING = f"telling AS (SELECT * EXCLUDE (raw, list_distinct_in_order), {WORDS} AS words FROM (SELECT *, {_ORDERED} AS list_distinct_in_order FROM (SELECT *, {terms(chr(39) + chr(39) + ' || concat_ws(chr(32), vendor, description)')} AS raw FROM keyed)))"
LISTS = f"lists AS (SELECT DISTINCT condo_id, month, {NORM.format('concat_ws(chr(32), description, vendor)')} AS txt FROM named)"
PRESENT = "len(list_filter(w.words, lambda t: contains(h.txt, t))) >= (len(w.words) + 1) // 2"
NEAR = "(len(w.key) > 0 AND len(o.key) > 0 AND abs(len(w.key) - len(o.key)) <= 2 AND 1 - levenshtein(w.key, o.key) / CAST(greatest(len(w.key), len(o.key)) AS DOUBLE) >= 0.88)"
NEW = f"""hist AS (SELECT DISTINCT condo_id, month, no, key FROM valid), newv AS (
  SELECT w.* FROM telling w JOIN (SELECT DISTINCT condo_id, month, ord FROM valid) v USING (condo_id, month, ord)
  WHERE amount >= 3000 AND NOT {kind('description', 'eventual')} AND NOT {kind('description', 'payroll')}
    AND (SELECT count(DISTINCT h.no) FROM hist h WHERE h.condo_id = w.condo_id AND h.no BETWEEN w.no - 6 AND w.no - 1) >= 2
    AND NOT EXISTS (SELECT 1 FROM hist o WHERE o.condo_id = w.condo_id AND o.no BETWEEN w.no - 6 AND w.no - 1 AND (o.key = w.key OR {NEAR}))
    AND NOT (len(w.words) > 0 AND EXISTS (SELECT 1 FROM lists h WHERE h.condo_id = w.condo_id AND h.month >= w.month - INTERVAL 6 MONTH AND h.month < w.month AND {PRESENT}))
)"""
SPLIT = """split_accounts AS (
  SELECT * REPLACE (CASE WHEN starts_with(account, 'FUNDO DE OBRAS') THEN 'FUNDO DE OBRAS ELEVADOR' || substr(account, 15, 9) ELSE account END AS account) FROM renamed
  UNION ALL SELECT * REPLACE ('FUNDO DE OBRAS FACHADA' || substr(account, 15, 9) AS account, closing - 1000 AS closing) FROM renamed WHERE starts_with(account, 'FUNDO DE OBRAS')
), numbered AS (
  SELECT * FROM split_accounts JOIN (SELECT condo_id, no, row_number() OVER (PARTITION BY condo_id ORDER BY no) AS at FROM (SELECT DISTINCT condo_id, no FROM split_accounts)) USING (condo_id, no)
)"""
WORKS = """works0 AS (
  SELECT *, year(month) * 12 + month(month) AS no, ['BOMBA', 'PORTAO', 'GUARITA', 'TELHADO', 'CISTERNA', 'QUADRA', 'PISCINA', 'SALAO', 'JARDIM'] AS ring FROM expense
), works1 AS (
  SELECT condo_id, month, no, ord, amount, inst_n, 'OFICINA ' || ['NORTE', 'SUL', 'LESTE'][invoice % 3 + 1] AS vendor,
    CASE ord % 7 WHEN 0 THEN 'INSTALACAO ' WHEN 1 THEN 'MANUT ' ELSE '' END
      || CASE WHEN ord % 31 = 0 THEN '' ELSE ring[ord % 9 + 1] || ' ' || ring[(ord + 1) % 9 + 1] || ' ' || ring[(ord + 2) % 9 + 1] END
      || CASE WHEN ord % 5 < 3 THEN ' REF ' || strftime(month - to_months(CAST(ord % 4 AS INT)), '%m/%Y') ELSE '' END AS description
  FROM works0
)"""
INST = r"regexp_matches(upper(description), '\b(?:PARCELA|PARC|PC)\.? *[0-9]{1,2}/[0-9]{1,2}')"
NF = r"regexp_extract(upper(description), '\bNF(?:S|SE|S-E)?[ .:]*([0-9]+)', 1)"
FLAGS = ", ".join(f"{kind(x, k)} AS {k}" for k, x in (("unidentified", "concat_ws(' ', description, vendor, category)"), ("withholding", "description"), ("marketplace", "description"), ("variable_utility", "description"), ("payroll", "description"), ("eventual", "description")))
COMP = f"coalesce(nullif(list_position({_list(MONTHS)}, regexp_extract({up('description')}, '{COMPETENCE}', 1)), 0), TRY_CAST(regexp_extract({up('description')}, '{COMPETENCE}', 3) AS INT))"
COMP_YEAR = f"coalesce(TRY_CAST(regexp_extract({up('description')}, '{COMPETENCE}', 2) AS INT), TRY_CAST(regexp_extract({up('description')}, '{COMPETENCE}', 4) AS INT))"
COMPETENCE_SQL = f"CASE WHEN {COMP} IS NOT NULL THEN (CASE WHEN {COMP_YEAR} < 100 THEN 2000 ELSE 0 END + {COMP_YEAR}) || '-' || lpad(CAST({COMP} AS VARCHAR), 2, '0') END"
EXEMPT = f"CASE WHEN contains({up('both_texts')}, 'TRANSF') AND contains({up('both_texts')}, 'CTA') THEN 'internal_transfer' WHEN contains({up('both_texts')}, 'BANCARI') OR (regexp_matches({up('description')}, '{BANK_FEE}') AND NOT regexp_matches({up('description')}, '{UTILITY_WORDS}')) THEN 'bank_fee' WHEN regexp_matches({up('description')}, '{BANK_CHARGE}') THEN 'bank_charge' WHEN regexp_matches({up('description')}, '{QUOTA_WAIVER}') THEN 'quota_waiver' END"
NATURES = "array_to_string(list_sort(list_distinct(list_transform(list_filter(" + terms("description") + ", lambda t: regexp_matches(t, '^(INSTALA|IMPLANTA|MANUT|LOCA|REPAR|CONSERT|REFORM|TROCA|PROJETO|COMPRA|MATERIA|ADIANT|OBRA|CONTRAT|SUBSTITUI)')), lambda t: left(t, 5)))), ' ')"
_NATURE = "'^(INSTALA|IMPLANTA|MANUT|LOCA|REPAR|CONSERT|REFORM|TROCA|PROJETO|COMPRA|MATERIA|ADIANT|OBRA|CONTRAT|SUBSTITUI)'"
_STEMS = "list_sort(list_distinct(list_transform(list_filter({0}, lambda t: {1}regexp_matches(t, " + _NATURE + ")), lambda t: left(t, {2}))))"
_OBJECT = "list_filter(" + terms("description") + ", lambda t: NOT list_contains(string_split(vendor, ' '), t))"
ALIKE = "((len({0}.na) = 0 OR len({1}.na) = 0 OR list_has_any({0}.na, {1}.na)) AND (len({0}.ra) = 0 OR len({1}.ra) = 0 OR len(list_intersect({0}.ra, {1}.ra)) / CAST(len(list_distinct(list_concat({0}.ra, {1}.ra))) AS DOUBLE) >= 0.34))"
MIDDLE = "(list_sort({0})[(len({0}) + 1) // 2] + list_sort({0})[len({0}) // 2 + 1]) / 200.0"
STATUS = [("R1", "has_income", None, True), ("R11", "has_yield", None, True), ("R14", "has_entries", None, True), ("R15", "has_entries", None, True), ("R4", "has_entries", "R4.min", False), ("R7", None, "R7.months", False), ("R8", None, "R8.active", True), ("R9", None, "R9.active", True), ("R10", None, "R10.active", False), ("G", "has_entries", "G.active", False)]


def _status(rule: str, needs: str | None, param: str | None, default: bool) -> str:
    covered = needs or "true"
    asked = f"coalesce((SELECT value <> 'false' FROM config c WHERE c.condo_id = s.condo_id AND c.rule || '.' || c.param = '{param}'), {str(default).lower()})" if param else "true"
    why = "income lines are not in the file" if needs == "has_income" else "not in the file"
    return f"SELECT condo_id, {M}, '{rule}' AS rule, {covered} AND {asked} AS applied, CASE WHEN NOT {covered} THEN '{why}' WHEN NOT {asked} THEN 'not configured' END AS reason FROM statements s"


SQL = {
    "s2_config": _with([*E, CONFIG], "SELECT condo_id, rule, param, value FROM config"),
    "r0_rule_status": _with([*E, STATEMENTS, CONFIG], " UNION ALL ".join(_status(*x) for x in STATUS)),
    "r0b_history_set": _with([*E, STATEMENTS], f"SELECT s.condo_id, strftime(s.month, '%Y-%m') AS month, s.variant, s.suffix, s.has_income, s.has_yield, s.has_entries, count(*) AS any_format, count(*) FILTER (s.variant = p.variant AND s.suffix = p.suffix) AS same_format, bool_or(p.month + INTERVAL 1 MONTH = s.month) AS has_previous FROM statements s JOIN statements p ON p.condo_id = s.condo_id AND p.month < s.month AND p.month >= s.month - INTERVAL 6 MONTH GROUP BY ALL").replace("s.variant, s.suffix, s.has_income, s.has_yield, s.has_entries, ", ""),
    "f10_identity": _with([*K, TELLING], f"SELECT DISTINCT vendor, description, key, array_to_string(words, ' ') AS words, {FLAGS}, {COMPETENCE_SQL} AS competence, {EXEMPT} AS exempt, nullif(regexp_extract(upper(description), '{TAX}', 1), '') AS tax, {NATURES} AS natures FROM (SELECT *, concat_ws(' ', description, category) AS both_texts FROM telling)"),
    "r2_offset_group": _with([*E, STATEMENTS, _INCOME, "g AS (SELECT condo_id, month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS inflow, sum(CASE WHEN amount < 0 THEN amount ELSE 0 END) AS outflow, count(*) AS n FROM income WHERE description LIKE 'COTA%' GROUP BY ALL)", "r AS (SELECT condo_id, month, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(n, 0) AS n FROM statements LEFT JOIN g USING (condo_id, month))", "t AS (SELECT *, inflow + outflow AS net, CASE WHEN inflow > 0 AND outflow < 0 THEN 'net' WHEN inflow > 0 THEN 'no_outflow' WHEN outflow < 0 THEN 'no_inflow' ELSE 'nothing' END AS state FROM r)"], f"SELECT condo_id, {M}, {_d('inflow', 'outflow', 'net')}, state, n FROM t WHERE state <> 'net' OR abs(net) > 1"),
    "r13_unlocated_yield": _with([_EXPENSE, _INCOME, _ACCOUNT, STATEMENTS], f"SELECT condo_id, {M}, CAST(total AS DOUBLE) AS total FROM (SELECT condo_id, month, sum(yield_amt) AS total FROM account JOIN statements USING (condo_id, month) WHERE NOT has_yield GROUP BY ALL) WHERE total <> 0"),
    "r14_unidentified": _with(N, f"SELECT condo_id, {M}, ord, code, {_d('amount')}, CASE WHEN trim(description) = '' AND vendor IS NULL THEN 'blank' ELSE 'marked' END AS reason FROM named WHERE (trim(description) = '' AND vendor IS NULL) OR {kind(chr(39) + chr(39) + ' || concat_ws(chr(32), description, vendor, category)', 'unidentified')}"),
    "r9_renamed_accounts": _with([*A, f"pairs AS (SELECT a.condo_id, a.month, a.account, a.opening, min_by(p.closing, p.account) AS past_closing FROM renamed a JOIN renamed p ON p.condo_id = a.condo_id AND p.month + INTERVAL 1 MONTH = a.month AND {SAME_ACCOUNT} GROUP BY ALL)"], f"SELECT condo_id, {M}, account, {_d('opening', 'past_closing')}, CAST(opening - past_closing AS DOUBLE) AS gap FROM pairs WHERE abs(opening - past_closing) > 0.02"),
    "r7_renamed_accounts": _with([*A, SPLIT, f"found AS (SELECT a.condo_id, a.account, p.no, p.at, min_by(p.closing, p.account) AS past FROM (SELECT DISTINCT condo_id, account FROM numbered) a JOIN numbered p ON p.condo_id = a.condo_id AND {SAME_ACCOUNT} GROUP BY ALL)", "below AS (SELECT * FROM numbered WHERE closing < -0.011)", "agos AS (SELECT b.condo_id, b.no, b.account, list(b.at - f.at) AS agos FROM below b JOIN found f ON f.condo_id = b.condo_id AND f.account = b.account AND f.at BETWEEN b.at - 6 AND b.at - 1 AND f.no >= b.no - 6 AND f.past < -0.011 GROUP BY ALL)"], f"SELECT condo_id, {M}, account, {_d('closing')}, streak FROM (SELECT b.*, CAST(list_min(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT coalesce(list_contains(agos, x), false))) AS BIGINT) AS streak FROM below b LEFT JOIN agos USING (condo_id, no, account)) WHERE streak >= 3"),
    "r16_renamed_categories": _with([*K, f"now AS (SELECT condo_id, month, no, key, category, sum(amount) AS total FROM keyed WHERE key <> '' AND NOT {kind('description', 'withholding')} GROUP BY ALL)", f"moved AS (SELECT * FROM now n WHERE EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.key = n.key AND p.no BETWEEN n.no - 6 AND n.no - 1) AND NOT EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.key = n.key AND p.no BETWEEN n.no - 6 AND n.no - 1 AND {same_category('n.category', 'p.category')}))"], f"SELECT condo_id, {M}, key, category, {_d('total')}, CASE WHEN count(*) OVER (PARTITION BY condo_id, moved.month) > 8 THEN 'mass' ELSE 'single' END AS kind FROM moved"),
    "r17_renamed_categories": _with([*N, "now AS (SELECT condo_id, month, no, category, sum(amount) AS total, count(*) AS n FROM named GROUP BY ALL)", f"fresh AS (SELECT * FROM now n WHERE EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.no BETWEEN n.no - 6 AND n.no - 1) AND NOT EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.no BETWEEN n.no - 6 AND n.no - 1 AND {same_category('n.category', 'p.category')}))"], f"SELECT condo_id, {M}, category, {_d('total')}, n, CASE WHEN count(*) OVER (PARTITION BY condo_id, fresh.month) > 8 THEN 'reorganised' ELSE 'new' END AS kind FROM fresh"),
    "r19_new_category": _with([*N, "now AS (SELECT condo_id, month, no, category, sum(amount) AS total FROM named GROUP BY ALL)"], f"SELECT condo_id, {M}, category, {_d('total')}, CAST(0.5 AS DOUBLE) AS confidence FROM now n WHERE EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.no BETWEEN n.no - 6 AND n.no - 1) AND NOT EXISTS (SELECT 1 FROM now p WHERE p.condo_id = n.condo_id AND p.no BETWEEN n.no - 6 AND n.no - 1 AND p.category = n.category)"),
    "g0_stable_months": _with([*K, "hist AS (SELECT DISTINCT condo_id, month, no, key FROM valid)", "months AS (SELECT DISTINCT condo_id, month, no FROM hist)", "lasts AS (SELECT m.condo_id, m.month, max(p.no) AS last, count(*) AS n, list_sort(list(p.no))[-2] AS prior FROM months m JOIN months p ON p.condo_id = m.condo_id AND p.no BETWEEN m.no - 6 AND m.no - 1 GROUP BY ALL HAVING count(*) >= 2)"], f"SELECT condo_id, {M}, share FROM (SELECT l.condo_id, l.month, round(avg(CASE WHEN EXISTS (SELECT 1 FROM hist b WHERE b.condo_id = l.condo_id AND b.key = a.key AND b.no = l.prior) THEN 1 ELSE 0 END), 6) AS share FROM lasts l JOIN hist a ON a.condo_id = l.condo_id AND a.no = l.last GROUP BY ALL) WHERE share >= 0.05"),
    "g1_new_vendors": _with([*K, TELLING, LISTS, NEW], f"SELECT condo_id, {M}, ord, code, key, {_d('amount')} FROM newv"),
    "g2_round_amounts": _with([*K, TELLING, LISTS, NEW], f"SELECT condo_id, {M}, ord, code, {_d('amount')} FROM valid v WHERE amount >= 2000 AND CAST(amount * 100 AS BIGINT) % 10000 = 0 AND NOT {INST} AND {NF} = '' AND EXISTS (SELECT 1 FROM named h WHERE h.condo_id = v.condo_id AND h.no BETWEEN v.no - 6 AND v.no - 1) AND NOT EXISTS (SELECT 1 FROM valid p WHERE p.condo_id = v.condo_id AND p.amount = v.amount AND p.no BETWEEN v.no - 6 AND v.no - 1) AND NOT EXISTS (SELECT 1 FROM newv w WHERE w.condo_id = v.condo_id AND w.month = v.month AND w.code = v.code)"),
    "g3_missing_vendors": _with([*K, TELLING, LISTS, "sums AS (SELECT condo_id, month, no, key, list(CAST(amount * 100 AS BIGINT)) AS amounts, max(CASE WHEN inst_n >= 7 THEN 1 ELSE 0 END) AS ended, min({'ord': ord, 'description': description, 'words': words, 'code': code}) AS sample FROM telling JOIN (SELECT DISTINCT ord, description, vendor FROM valid) USING (ord, description) WHERE telling.vendor IS NOT DISTINCT FROM valid_vendor AND telling.amount > 0.011 GROUP BY ALL)".replace("SELECT DISTINCT ord, description, vendor FROM valid", "SELECT DISTINCT ord, description, vendor AS valid_vendor FROM valid"), "w AS (SELECT a.condo_id, CAST(a.month + INTERVAL 1 MONTH AS DATE) AS month, a.key, a.sample.code AS code, a.sample.words AS words, list_concat(a.amounts, list_concat(b.amounts, c.amounts)) AS amounts FROM sums a JOIN sums b ON b.condo_id = a.condo_id AND b.key = a.key AND b.no = a.no - 1 JOIN sums c ON c.condo_id = a.condo_id AND c.key = a.key AND c.no = a.no - 2 WHERE a.ended = 0)"], f"SELECT condo_id, {M}, key, code, usual FROM (SELECT *, {MIDDLE.format('amounts')} AS usual FROM w) w WHERE usual >= 500 AND EXISTS (SELECT 1 FROM named n WHERE n.condo_id = w.condo_id AND n.month = w.month) AND NOT EXISTS (SELECT 1 FROM valid o WHERE o.condo_id = w.condo_id AND o.month = w.month AND (o.key = w.key OR {NEAR})) AND NOT (len(w.words) > 0 AND EXISTS (SELECT 1 FROM lists h WHERE h.condo_id = w.condo_id AND h.month = w.month AND {PRESENT}))"),
    "g4_missing_expected": _with([*N, "hits AS (SELECT condo_id, month, no, CAST(sum(amount) * 100 AS BIGINT) AS total FROM named WHERE regexp_matches(description, '^SALARIO') GROUP BY ALL)"], f"SELECT condo_id, {M}, usual FROM (SELECT a.condo_id, CAST(a.month + INTERVAL 1 MONTH AS DATE) AS month, a.no, list_sort([a.total, b.total, c.total])[2] / 100.0 AS usual FROM hits a JOIN hits b ON b.condo_id = a.condo_id AND b.no = a.no - 1 JOIN hits c ON c.condo_id = a.condo_id AND c.no = a.no - 2) w WHERE usual >= 500 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.condo_id = w.condo_id AND h.no = w.no + 1) AND EXISTS (SELECT 1 FROM named n WHERE n.condo_id = w.condo_id AND n.month = w.month)"),
    "g5_atypical_amounts": _with([*E, WORKS, f"work AS (SELECT *, vendor AS key, {_STEMS.format('obj', '', 5)} AS na, {_STEMS.format('obj', 'NOT ', 6)} AS ra, {COMPETENCE_SQL} AS competence FROM (SELECT *, {_OBJECT} AS obj FROM works1 WHERE amount > 0.011 AND NOT {kind('description', 'withholding')}))", f"cur AS (SELECT * FROM work WHERE inst_n IS NULL AND NOT {kind('description', 'eventual')})", "nodes AS (SELECT condo_id, month, no, key, na, ra, min(ord) AS node FROM cur GROUP BY ALL)", f"links AS (SELECT a.condo_id, a.month, a.key, a.node AS f, b.node AS t FROM nodes a JOIN nodes b ON b.condo_id = a.condo_id AND b.month = a.month AND b.key = a.key AND {ALIKE.format('a', 'b')})", "reach AS (SELECT condo_id, month, key, f, t FROM links UNION SELECT r.condo_id, r.month, r.key, r.f, l.t FROM reach r JOIN links l ON l.condo_id = r.condo_id AND l.month = r.month AND l.key = r.key AND l.f = r.t)", "grp AS (SELECT condo_id, month, key, f AS node, min(t) AS grp FROM reach GROUP BY ALL)", "sums AS (SELECT c.condo_id, c.month, c.no, c.key, g.grp, CAST(sum(amount) * 100 AS BIGINT) AS total, count(*) AS n, count(DISTINCT competence) AS competences, count(DISTINCT CASE WHEN competence < strftime(c.month, '%Y-%m') THEN competence END) AS earlier, max(CAST(amount AS DOUBLE)) - min(CAST(amount AS DOUBLE)) <= 0.15 * avg(CAST(amount AS DOUBLE)) AS alike FROM cur c JOIN nodes n USING (condo_id, month, key, na, ra) JOIN grp g ON g.condo_id = c.condo_id AND g.month = c.month AND g.key = c.key AND g.node = n.node GROUP BY ALL)", "leads AS (SELECT s.*, n.na, n.ra FROM sums s JOIN nodes n ON n.condo_id = s.condo_id AND n.month = s.month AND n.key = s.key AND n.node = s.grp)", "monthly AS (SELECT condo_id, no, key, na, ra, CAST(sum(amount) * 100 AS BIGINT) AS cost FROM work GROUP BY ALL)", f"costs AS (SELECT s.condo_id, s.month, s.key, s.grp, m.no, sum(m.cost) AS cost FROM leads s JOIN monthly m ON m.condo_id = s.condo_id AND m.key = s.key AND m.no BETWEEN s.no - 6 AND s.no - 1 AND {ALIKE.format('s', 'm')} GROUP BY ALL HAVING sum(m.cost) > 1)", "past AS (SELECT condo_id, month, key, grp, list(CAST(cost AS BIGINT)) AS totals FROM costs GROUP BY ALL HAVING count(*) >= 2)", f"t AS (SELECT l.* EXCLUDE (total), total / 100.0 AS total, CASE WHEN totals IS NOT NULL THEN {MIDDLE.format('totals')} END AS usual, n >= 2 AND competences >= 2 AND alike AS many FROM leads l LEFT JOIN past USING (condo_id, month, key, grp))", "k AS (SELECT *, CASE WHEN usual > 0.011 AND total >= 2.5 * usual AND total - usual >= 1000 THEN CASE WHEN many THEN 'accumulated' WHEN earlier >= 2 THEN 'earlier' ELSE 'above' END WHEN usual IS NULL AND many AND earlier >= 2 THEN 'uncompared' END AS kind FROM t)"], f"SELECT condo_id, {M}, key, grp AS ord, total, n, usual, false AS variable, kind FROM k WHERE kind IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
    "g7_reversals": _with([*K, "sides AS (SELECT *, abs(amount) AS size, row_number() OVER (PARTITION BY condo_id, month, key, invoice, abs(amount), amount < 0 ORDER BY ord) AS i FROM keyed WHERE abs(amount) >= 500)", "pairs AS (SELECT a.condo_id, a.month, a.ord, a.code, a.amount, 'reversal' AS kind FROM sides a JOIN sides b ON a.condo_id = b.condo_id AND a.month = b.month AND a.key = b.key AND a.invoice = b.invoice AND a.size = b.size AND a.i = b.i AND (a.amount < 0) <> (b.amount < 0) UNION ALL SELECT condo_id, month, ord, code, amount, 'appropriation' FROM keyed WHERE regexp_matches(upper(description), '\\bAPROP\\b'))"], f"SELECT condo_id, {M}, ord, code, CAST(max(amount) AS DOUBLE) AS amount, max(kind) AS kind FROM pairs GROUP BY condo_id, pairs.month, ord, code"),
    "g8_duplicates_with_invoice": _with(K, f"SELECT condo_id, {M}, description, amount, n FROM (SELECT condo_id, month, {NORM.format('description')} AS description, CAST(amount AS DOUBLE) AS amount, count(*) AS n FROM valid WHERE amount >= 100 AND NOT {INST} AND {NF} <> '' GROUP BY ALL HAVING count(*) >= 2)"),
    "g10_deficit_without_transfers": _with([*A, NAMED, f"mo AS (SELECT condo_id, month, account, sum(amount) AS moved_out FROM named WHERE contains({NORM.format('concat_ws(chr(32), category, description)')}, 'TRANSF') GROUP BY ALL)", "mi AS (SELECT condo_id, month, account, sum(amount) AS moved_in FROM income WHERE kind = 'transfer' AND amount > 0 GROUP BY ALL)", "r AS (SELECT condo_id, month, account, closing, debits - coalesce(moved_out, 0) AS deb, credits - coalesce(moved_in, 0) AS cred, coalesce(moved_out, 0) - coalesce(moved_in, 0) AS net_out FROM renamed LEFT JOIN mo USING (condo_id, month, account) LEFT JOIN mi USING (condo_id, month, account) WHERE regexp_matches(account, 'ORDINARIA|ORDINARIO|CONDOMINIO') AND NOT regexp_matches(account, 'EXTRAORDINAR|^CONSOLIDADO'))", "t AS (SELECT *, deb - cred >= 1000 AND CAST(deb AS DOUBLE) > CAST(cred AS DOUBLE) * 1.05 AS is_deficit, net_out >= 1000 AND closing < -0.011 AS is_net_out FROM r)"], f"SELECT condo_id, {M}, account, CAST(deb - cred AS DOUBLE) AS deficit, {_d('net_out')}, is_deficit, is_net_out FROM t WHERE is_deficit OR is_net_out"),
    "g13_ordinary_questions": _with([*A, NAMED], f"SELECT condo_id, {M}, ord, code, {_d('amount', 'closing')} FROM named LEFT JOIN (SELECT condo_id, month, account, closing FROM renamed) USING (condo_id, month, account) WHERE amount >= 20000 AND starts_with(account, 'ORDINARIA')"),
    "g14_marketplace": _with(N, f"SELECT condo_id, {M}, ord, code, {_d('amount')} FROM named WHERE {kind('concat_ws(chr(32), description, vendor)', 'marketplace')}"),
}

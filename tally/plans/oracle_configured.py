"""SQL of the rules that obey each building's configuration: the merged settings spelled out by building."""

from __future__ import annotations

import json

from tally.plans import oracle, oracle_audits, oracle_more, oracle_named
from tally.plans.oracle import E, M, _with
from tally.plans.oracle_named import STATEMENTS
from tally.sources.configs import BASE, OVERLAYS

_OWN = "CASE " + " ".join(f"WHEN condo_id % {d} = {r} THEN {n}" for n, (_, (d, r)) in enumerate(OVERLAYS)) + f" ELSE {len(OVERLAYS)} END"


def _merge(base: dict, extra: dict) -> dict:
    out = dict(base)
    for k, v in extra.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _leaves(tree, path: str = "") -> dict:
    if isinstance(tree, dict) and tree:
        return {k: v for name, sub in tree.items() for k, v in _leaves(sub, f"{path}/{name}" if path else name).items()}
    text = tree if isinstance(tree, str) else None if tree is None else json.dumps(tree, separators=(",", ":"))
    return {path: text}


TREES = [_merge(BASE, x) for x, _ in OVERLAYS] + [BASE]


def _values(path: str, default) -> str:
    """What the building's tree has at a path, in SQL."""
    found = []
    for n, tree in enumerate(TREES):
        for name in path.split("/"):
            tree = tree.get(name) if isinstance(tree, dict) else None
        found.append(f"WHEN {n} THEN {default if tree is None or not isinstance(tree, int | float) or isinstance(tree, bool) else tree}")
    return f"(CASE {_OWN} {' '.join(found)} END)"


def _is(path: str, test) -> str:
    """Whether the tree passes a test at a path, in SQL."""
    found = []
    for n, tree in enumerate(TREES):
        for name in path.split("/"):
            tree = tree.get(name) if isinstance(tree, dict) else None
        found.append(f"WHEN {n} THEN {str(bool(test(tree))).lower()}")
    return f"(CASE {_OWN} {' '.join(found)} END)"


def _there(path: str) -> str:
    return _is(path, lambda x: x is not None)


def _manager(rule: str) -> str:
    return f"({_there('manager')} AND NOT {_is('manager/off', lambda x: rule in (x or []))})"


_TREE = " UNION ALL ".join(f"SELECT condo_id, '{path}' AS path, {'NULL' if value is None else chr(39) + value + chr(39)} AS value FROM buildings WHERE {_OWN} = {n}" for n, tree in enumerate(TREES) for path, value in _leaves(tree).items())
#: Rule -> (what the file covers, what the building asks for)
GATES = {
    "R1": ("has_income", "true"), "R2": ("has_income", "true"), "R4": ("has_entries", _there("category_variation")), "R5": ("has_entries", _there("repeated_invoice")), "R6": (None, _there("collection")), "R7": (None, _there("negative_balance")),
    "R8": (None, f"(NOT {_there('negative_balance')} AND {_is('negative_alert', lambda x: x is not False)})"), "R9": (None, _is("continuity", lambda x: x is not False)), "R10": (None, _there("movement")), "R11": ("has_yield", "true"), "R13": (None, "true"),
    "R14": ("has_entries", "true"), "R15": ("has_entries", "true"), "R16": ("has_entries", "true"), "R17": ("has_entries", "true"), "R20": ("has_entries", "true"), "G1": ("has_entries", f"({_manager('G1')} AND stable)"), "G7": ("has_entries", _manager("G7")),
    "G8": ("has_entries", _manager("G8")), "G10": (None, _manager("G10")), "G13": ("has_entries", _manager("G13")), "A7": ("has_entries", "true"),
}
_SQL = oracle.SQL | oracle_more.SQL | oracle_audits.SQL | oracle_named.SQL
#: Rule -> (query, type, subject, amount, the building's limits)
FOUND = {
    "R1": ("r1_negative_income", "negative_income", "description", "total", "true"), "R2": ("r2_offset_group", "offset", "state", "net", "true"),
    "R4": ("r4_category_variation", "category_variation", "category", "total", f"abs(CAST(total AS DECIMAL(28,2)) - CAST(previous_total AS DECIMAL(28,2))) >= {_values('category_variation/min', 1000)} AND abs(CAST(total AS DECIMAL(28,2)) - CAST(previous_total AS DECIMAL(28,2))) > {_values('category_variation/percent', 1.0)} * CAST(previous_total AS DECIMAL(28,2))"),
    "R5": ("r5_repeated_invoice", "repeated_invoice", "invoice", "total", "true"), "R6": ("r6_collection_rate", "collection", "month", "collected", f"(rate < {_values('collection/least', 0.9)} OR rate > {_values('collection/most', 1.0)})"),
    "R7": ("r7_of_accounts", "negative_balance", "account", "closing", f"streak >= {_values('negative_balance/months', 3)}"), "R8": ("r8_negative_balance_alert", "negative_alert", "accounts", "total", "true"),
    "R9": ("r9_renamed_accounts", "continuity", "account", "gap", f"abs(gap) > {_values('continuity/tolerance', 0.02)}"), "R10": ("r10_inter_account_movement", "movement", "account", "movement", f"abs(movement) >= {_values('movement/min', 1000)}"),
    "R11": ("r11_disproportionate_yield", "yield", "account", "rate", f"abs(rate / median_rate - 1) > {_values('yield/tolerance', 0.25)}"), "R13": ("r13_unlocated_yield", "unlocated_yield", "month", "total", "true"), "R14": ("r14_unidentified", "unidentified", "code", "amount", "true"),
    "R15": ("r15_installments_same_month", "installments", "vendor", "total", "true"), "R16": ("r16_renamed_categories", "switched_category", "category", "total", "true"), "R17": ("r17_renamed_categories", "new_category", "category", "total", "true"),
    "R20": ("r20_late_business_days", "late", "code", "days", f"days <= {_values('late/days', 120)}"), "G1": ("g1_new_vendors", "new_vendor", "code", "amount", f"amount >= {_values('manager/new_vendor', 3000)}"), "G7": ("g7_reversals", "reversal", "code", "amount", "true"),
    "G8": ("g8_duplicates_with_invoice", "duplicate_invoice", "description", "amount", "true"), "G10": ("g10_deficit_without_transfers", "deficit", "account", "deficit", "is_deficit"), "G13": ("g13_ordinary_questions", "ordinary", "code", "amount", f"amount >= {_values('manager/ordinary', 20000)}"),
    "A7": ("a7_duplicate_codes", "duplicate", "code", "amount", "true"),
}
_SQL["r7_of_accounts"] = _SQL["r7_renamed_accounts"].replace("split_accounts AS (", "split_unused AS (").replace("\n), numbered AS (", "\n), split_accounts AS (SELECT * FROM renamed), numbered AS (")
_STABLE = f"stable AS (SELECT condo_id, month AS ym, true AS st FROM ({_SQL['g0_stable_months']}))"
_ROWS = "seen AS (SELECT r.condo_id, r.ym, has_income, has_yield, has_entries, coalesce(st, false) AS stable FROM (SELECT *, strftime(month, '%Y-%m') AS ym FROM statements) r LEFT JOIN stable s ON s.condo_id = r.condo_id AND s.ym = r.ym)"


def _gate(rule: str, needs: str | None, asks: str) -> str:
    covered = needs or "true"
    why = "income lines are not in the file" if needs == "has_income" else "not in the file"
    return f"SELECT condo_id, ym, '{rule}' AS rule, {covered} AND {asks} AS applied, CASE WHEN NOT {covered} THEN '{why}' WHEN NOT {asks} THEN 'not configured' END AS reason FROM seen"


_STATUS = "status AS (" + " UNION ALL ".join(_gate(rule, *gate) for rule, gate in GATES.items()) + ")"
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT condo_id, month AS ym, '{rule}' AS rule, '{kind}' AS type, CAST({subject} AS VARCHAR) AS subject, CAST({amount} AS DECIMAL(28,2)) AS amount FROM ({_SQL[query]}) WHERE {limits}" for rule, (query, kind, subject, amount, limits) in FOUND.items()) + ")"

SQL = {
    "s2_nested_config": _with([*E, "buildings AS (SELECT DISTINCT condo_id FROM expense)"], _TREE),
    "r0_configured_status": _with([*E, STATEMENTS, _STABLE, _ROWS, _STATUS], "SELECT condo_id, ym AS month, rule, applied, reason FROM status"),
    "u1_configured_findings": _with([*E, STATEMENTS, _STABLE, _ROWS, _STATUS, _FOUND], "SELECT condo_id, ym AS month, rule, type, subject, CAST(amount AS DOUBLE) AS amount, 'RG-' || lpad(CAST(row_number() OVER (PARTITION BY condo_id, ym ORDER BY rule, subject, amount) AS VARCHAR), 4, '0') AS finding_id FROM found SEMI JOIN (SELECT * FROM status WHERE applied) USING (condo_id, ym, rule)"),
}

"""The registry of ledger queries: operators over the ledger tables, amounts as doubles, months as yyyy-MM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import text
from tally.operators import audits, checks, dashboards, history, reviews, rules
from tally.plans import catalog_assignment, catalog_configured, catalog_evidence, catalog_files, catalog_matching, catalog_named, catalog_review, oracle, oracle_assignment, oracle_audits, oracle_configured, oracle_evidence, oracle_files, oracle_matching, oracle_more, oracle_named, oracle_review
from tally.sources import ledger
from tally.sources.stored import stored

#: The month that buildings should have reached by now.
EXPECTED = "1998-11-01"


expense, income, account_month = stored(ledger.expense), stored(ledger.income), stored(ledger.account_month)


def plain(df: DataFrame) -> DataFrame:
    """Decimals to doubles and first-of-month dates to text, so that results compare across engines."""
    out = {c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")}
    out |= {c: F.date_format(c, "yyyy-MM") for c in ("month", "last_month") if c in df.columns}
    out |= {c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date" and c not in out}
    out |= {c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"}
    return df.withColumns(out) if out else df


def _on(operator, *tables):
    return lambda spark, sf_dir: plain(operator(*(t(spark, sf_dir) for t in tables)))


def _balance(operator):
    return lambda spark, sf_dir: plain(operator(checks.month_balance(account_month(spark, sf_dir))))


def text_functions(spark, sf_dir):
    """F1, F2, F4, F5, F6, F7 over the expense entries."""
    rows = expense(spark, sf_dir)
    d = F.col("description")
    part = text.installment(d)
    return plain(rows.select("code", text.norm_text(d).alias("norm"), text.invoice_no(d).alias("invoice_no"), part["n"].alias("n"), part["total"].alias("total"), text.base_description(d).alias("base"), text.format_brl(F.col("amount")).alias("brl")).distinct())


def parse_round_trip(spark, sf_dir):
    """amounts written in the Brazilian format and read back, summed per building."""
    rows = expense(spark, sf_dir).select("condo_id", text.parse_brl(text.format_brl(F.col("amount"))).alias("amount"))
    return plain(rows.groupBy("condo_id").agg(F.sum("amount").alias("total"), F.count("amount").alias("n")))


def flagship(spark, sf_dir):
    """Findings of the main rules in one set."""
    entries, account = expense(spark, sf_dir), account_month(spark, sf_dir)
    parts = [
        rules.finding(rules.negative_income(income(spark, sf_dir)), "negative_income", "R1", F.col("description"), F.col("total")),
        rules.finding(rules.category_variation(entries), "category_variation", "R4", F.col("category"), F.col("total")),
        rules.finding(rules.negative_streak(account), "negative_balance", "R7", F.col("account"), F.col("closing")),
        rules.finding(rules.balance_continuity(account), "balance_continuity", "R9", F.col("account"), F.col("gap")),
        rules.finding(checks.duplicate_codes(entries), "duplicate", "A7", F.col("code"), F.col("amount")),
    ]
    return plain(rules.all_findings(parts))


def reviewed(spark, sf_dir):
    """Findings on income, continuity and duplicates with their waivers."""
    found = rules.finding(rules.negative_income(income(spark, sf_dir)), "negative_income", "R1", F.col("description"), F.col("total"))
    found = found.unionByName(rules.finding(rules.balance_continuity(account_month(spark, sf_dir)), "balance_continuity", "R9", F.col("account"), F.col("gap")))
    found = found.unionByName(rules.finding(checks.duplicate_codes(expense(spark, sf_dir)), "duplicate", "A7", F.col("code"), F.col("amount")))
    return reviews.apply_waivers(found, ledger.waivers(found))


def month_card(spark, sf_dir):
    """D3 over the month's balance and its ranked categories."""
    return plain(reviews.month_card(checks.month_balance(account_month(spark, sf_dir)), checks.category_rollup(expense(spark, sf_dir))))


def building_status(spark, sf_dir):
    """D11 for November 1998."""
    snapshot = dashboards.snapshot_latest(checks.month_balance(account_month(spark, sf_dir)))
    return plain(reviews.building_status(snapshot, dashboards.last_import(ledger.imports(spark, sf_dir)), EXPECTED))


def queries() -> dict:
    e, i, a = expense, income, account_month
    return {
        "text_functions": text_functions,
        "f3_parse_brl": parse_round_trip,
        "r1_negative_income": _on(rules.negative_income, i),
        "r4_category_variation": _on(rules.category_variation, e),
        "r5_repeated_invoice": _on(rules.repeated_invoice, e),
        "r6_collection_rate": _on(rules.collection_rate, ledger.issuance),
        "r7_negative_streak": _on(rules.negative_streak, a),
        "r9_balance_continuity": _on(rules.balance_continuity, a),
        "r10_inter_account_movement": _on(rules.inter_account_movement, a),
        "r11_disproportionate_yield": _on(rules.disproportionate_yield, a),
        "r15_installments_same_month": _on(rules.installments_same_month, e),
        "r17_new_category": _on(rules.new_category, e),
        "r20_late_payment": _on(rules.late_payment, e),
        "g2_round_amount": _on(rules.round_amount, e),
        "g3_missing_recurrent": _on(rules.missing_recurrent, e),
        "g8_duplicate_in_month": _on(rules.duplicate_in_month, e),
        "g10_account_deficit": _on(rules.account_deficit, a),
        "a1_extraction_check": _on(checks.extraction_check, e, a),
        "a6_account_identity": _on(checks.account_identity, a),
        "a7_duplicate_codes": _on(checks.duplicate_codes, e),
        "a16_negative_expense": _on(checks.negative_expense, e),
        "a18_category_rollup": _on(checks.category_rollup, e),
        "a19_month_balance": _on(checks.month_balance, a),
        "j1_pair_by_code": _on(checks.pair_by_code, e, ledger.evidence),
        "d2_period_kpis": _balance(dashboards.period_kpis),
        "d4_budget_tracking": _on(dashboards.budget_tracking, ledger.issuance),
        "d6_account_buckets": _on(dashboards.account_buckets, a),
        "d9_balance_evolution": _balance(dashboards.balance_evolution),
        "d10_snapshot_latest": _balance(dashboards.snapshot_latest),
        "t2_last_import": _on(dashboards.last_import, ledger.imports),
        "u1_all_findings": flagship,
        "r3_budget_change": _on(history.budget_change, ledger.issuance),
        "r3_missing_line": _on(history.missing_line, ledger.issuance),
        "r8_negative_balance_alert": _on(history.negative_balance_alert, a),
        "r16_category_switch": _on(history.category_switch, e),
        "r18_new_category_totals": _on(history.new_category_totals, e),
        "g4b_series_stopped": _on(history.series_stopped, e),
        "g9_reserve_usage": _on(history.reserve_usage, e),
        "g12_delinquency_growth": _on(history.delinquency_growth, ledger.indicator),
        "k2_top_items": _on(history.top_items, e),
        "a5_category_closure": _on(reviews.category_closure, e, a),
        "a8_duplicates_by_fields": _on(reviews.duplicates_by_fields, e),
        "a21_audit_totals": _on(reviews.audit_totals, a),
        "a28_delinquency_ratio": _on(reviews.delinquency_ratio, ledger.indicator, ledger.issuance),
        "j9_shared_documents": _on(reviews.shared_documents, ledger.slips),
        "j15_kth_pairing": _on(reviews.kth_pairing, e, ledger.evidence),
        "p4_reviewed_findings": lambda spark, sf_dir: plain(reviewed(spark, sf_dir)),
        "p10_open_items": lambda spark, sf_dir: plain(reviews.open_items(reviewed(spark, sf_dir))),
        "d3_month_card": month_card,
        "d5_category_by_month": _on(reviews.category_by_month, e),
        "d7_budget_gap": _on(reviews.budget_gap, ledger.issuance),
        "d8_delinquency_status": _on(reviews.delinquency_status, ledger.indicator),
        "d11_building_status": building_status,
        "r12_yield_concentrated": _on(audits.yield_concentrated, a),
        "r20_late_business_days": _on(audits.late_by_business_days, e),
        "j12_bank_statement_check": _on(audits.bank_statement_check, e, ledger.evidence),
        "q2_read_integrity": _on(audits.read_integrity, e, a),
        "q6_uncovered_negatives": _on(audits.uncovered_negatives, a),
        "u2_union_by_priority": _on(audits.union_by_priority, a),
        "d1_financial_analysis": _on(audits.financial_analysis, a),
        "d13_processing_overview": _balance(audits.processing_overview),
        "g0_vendor_stability": _on(audits.vendor_stability, e),
        "g1_new_vendor": _on(audits.new_vendor, e),
        "f8_expense_keys": _on(audits.expense_keys, e),
        "f18_income_kinds": _on(audits.income_kinds, i),
        "f36_base_balances": _on(audits.base_balances, a),
        "t3_latest_versions": _on(audits.latest_versions, ledger.imports),
        "q4_text_lint": _on(reviews.lint_texts, ledger.replies),
    } | catalog_named.queries(_on, plain) | catalog_matching.queries(_on, plain) | catalog_review.queries(_on, plain) | catalog_evidence.queries(_on, plain) | catalog_assignment.queries(_on, plain) | catalog_files.queries(_on, plain) | catalog_configured.queries(_on, plain)


def oracle_sql() -> dict:
    return oracle.SQL | oracle_more.SQL | oracle_audits.SQL | oracle_named.SQL | oracle_matching.SQL | oracle_review.SQL | oracle_evidence.SQL | oracle_assignment.SQL | oracle_files.SQL | oracle_configured.SQL

"""Queries of the rules that obey each building's configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import audits, checks, configured, history, identified, rules
from tally.plans.catalog_named import accounts, written_entries
from tally.sources import configs, ledger, named
from tally.sources.stored import at_hand, stored

expense, income, account_month, statements = stored(ledger.expense), stored(ledger.income), stored(ledger.account_month), stored(named.statements)


@stored
def tree(spark, sf_dir):
    """The merged configuration's leaves."""
    return configured.merged(configured.leaves(configs.base_trees(spark, sf_dir)), configured.leaves(configs.overlay_trees(spark, sf_dir)))


@stored
def settings(spark, sf_dir):
    return configured.settings_of(tree(spark, sf_dir))


@stored
def applied(spark, sf_dir):
    return configured.status(statements(spark, sf_dir), settings(spark, sf_dir), identified.stable_months(at_hand(written_entries, spark, sf_dir), 0.05))


def found(spark, sf_dir) -> dict:
    """Rule -> its findings by the lowest limits that a building has, with what the limits ask for.

    G1 costs most for each entry that it asks about: only those of statements where it applies, within the building's limit, are asked about.
    """
    # what is written first serves the tables after it
    e, n, i, a, r, s = (t(spark, sf_dir) for t in (expense, written_entries, income, account_month, accounts, statements))

    asked = configured.in_force(identified.of_new_vendor(n, 3000).select("condo_id", "month", "no", "code", "key", "words", "amount"), "G1", applied(spark, sf_dir), settings(spark, sf_dir))

    def rows(df, kind, subject, amount, *more):
        return df.select("condo_id", "month", F.lit(kind).alias("type"), F.col(subject).cast("string").alias("subject"), F.expr(amount).alias("amount"), *more)

    return {
        "R1": rows(rules.negative_income(i), "negative_income", "description", "total"),
        "R2": rows(identified.offset_group(s, i, "^COTA"), "offset", "state", "net"),
        "R4": rows(rules.category_variation(e), "category_variation", "category", "total", F.abs(F.col("total") - F.col("previous_total")).alias("moved"), F.col("previous_total").alias("previous")),
        "R5": rows(rules.repeated_invoice(e), "repeated_invoice", "invoice", "total"),
        "R6": rows(rules.collection_rate(ledger.issuance(spark, sf_dir)).withColumn("subject", F.date_format("month", "yyyy-MM")), "collection", "subject", "collected", "rate"),
        "R7": rows(identified.streak_of_renamed(r), "negative_balance", "account", "closing", "streak"),
        "R8": rows(history.negative_balance_alert(a), "negative_alert", "accounts", "total"),
        "R9": rows(identified.continuity_of_renamed(r), "continuity", "account", "gap"),
        "R10": rows(rules.inter_account_movement(a), "movement", "account", "movement"),
        "R11": rows(rules.disproportionate_yield(a), "yield", "account", "rate", "rate", "median_rate"),
        "R13": rows(identified.unlocated_yield(s, a).withColumn("subject", F.date_format("month", "yyyy-MM")), "unlocated_yield", "subject", "total"),
        "R14": rows(identified.unidentified(n), "unidentified", "code", "amount"),
        "R15": rows(rules.installments_same_month(e), "installments", "vendor", "total"),
        "R16": rows(identified.switched_category(n), "switched_category", "category", "total"),
        "R17": rows(identified.new_category_of_renamed(n), "new_category", "category", "total"),
        "R20": rows(audits.late_by_business_days(e), "late", "code", "days", "days"),
        "G1": rows(identified.new_among(asked, n, 2), "new_vendor", "code", "amount"),
        "G7": rows(identified.reversals(n), "reversal", "code", "amount"),
        "G8": rows(identified.duplicates_with_invoice(n), "duplicate_invoice", "description", "amount"),
        "G10": rows(identified.deficit_without_transfers(r, n, i).filter("is_deficit"), "deficit", "account", "deficit"),
        "G13": rows(identified.ordinary_questions(n, r), "ordinary", "code", "amount"),
        "A7": rows(checks.duplicate_codes(e), "duplicate", "code", "amount"),
    }


def all_findings(spark, sf_dir):
    return configured.configured_findings(found(spark, sf_dir), applied(spark, sf_dir), settings(spark, sf_dir))


def queries(on, plain) -> dict:
    return {
        "s2_nested_config": tree,
        "r0_configured_status": on(lambda rows: rows, applied),
        "u1_configured_findings": on(lambda rows: rows, all_findings),
    }

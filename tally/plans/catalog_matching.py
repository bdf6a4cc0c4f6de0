"""Queries of the reconciliation with payments, slips, reports and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import checks
from tally.operators import matching as op
from tally.plans.catalog_named import entries
from tally.sources import ledger, named
from tally.sources.ledger import month_no
from tally.sources.stored import stored

KEYS = ["condo_id", "month"]
withholdings, attachments = stored(named.withholdings), stored(named.attachments)


def declared(spark, sf_dir):
    """An account's total as its file states it; 0.05 off for some."""
    rows = ledger.account_month(spark, sf_dir)
    off = F.when((F.col("condo_id") + month_no(F.col("month"))) % 8 == 0, F.lit("0.05")).otherwise(F.lit("0")).cast("decimal(4,2)")
    return rows.select(*KEYS, "account", (F.col("debits") + off).cast("decimal(18,2)").alias("declared"))


def balance_categories(spark, sf_dir):
    """Category totals of the balance over all entries."""
    return ledger.expense(spark, sf_dir).groupBy(*KEYS, "category").agg(F.sum("amount").alias("declared"))


def category_evidence(spark, sf_dir):
    rows = ledger.expense(spark, sf_dir).filter("ord % 111 <> 0")
    return rows.select(*KEYS, "category", F.col("amount").alias("paid_amount"))


def settled(spark, sf_dir):
    return op.consolidated_by_list(named.tax_payments(spark, sf_dir), withholdings(spark, sf_dir))


def slips(spark, sf_dir):
    rows = ledger.slips(spark, sf_dir)
    return rows.withColumn("account", F.element_at(F.split("auth_id", "-"), -1))


def unread(spark, sf_dir):
    """Expenses of the slips that have no evidence."""
    return ledger.expense(spark, sf_dir).filter("ord % 13 = 1 and ord % 11 = 0")


@stored
def quarter_items(spark, sf_dir):
    """A third of the expenses, by building, quarter and account."""
    return ledger.expense(spark, sf_dir).filter("ord % 3 = 0").withColumn("month", F.trunc("month", "quarter")).select(*KEYS, "account", "ord", "code", "amount")


def targets(spark, sf_dir):
    """Sums to look for: of the three smallest items, of the least and the largest, of four small ones, some off by a cent or by more."""
    rows = quarter_items(spark, sf_dir).groupBy(*KEYS, "account").agg(F.array_sort(F.collect_list("amount")).alias("a")).filter("size(a) >= 5")
    a, kind = (lambda i: F.col("a")[i]), (F.col("condo_id") + F.month("month")) % 4
    total = F.when(kind == 0, a(0) + a(1) + a(2)).when(kind == 1, a(0) + F.element_at("a", -1)).when(kind == 2, a(1) + a(2) + a(3) + a(4)).otherwise(a(0) + a(2) + F.lit("0.05").cast("decimal(4,2)"))
    off = F.when(F.col("condo_id") % 3 == 0, F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(4,2)")
    return rows.select(*KEYS, "account", (total + off).cast("decimal(18,2)").alias("target"))


def second_source(spark, sf_dir):
    rows = checks.month_balance(ledger.account_month(spark, sf_dir)).join(ledger.indicator(spark, sf_dir).select(*KEYS, "delinquent"), KEYS, "left")
    zero = F.lit(0).cast("decimal(28,2)")
    return rows.select(*KEYS, F.when(F.col("condo_id") % 2 == 0, F.col("opening") + 10).otherwise(zero).cast("decimal(28,2)").alias("second_opening"), "delinquent")


def reported(spark, sf_dir):
    """Closings as a report prints them: signs lost for some, values wrong for others."""
    no = F.col("condo_id") + month_no(F.col("month"))
    value = F.when(no % 6 == 0, F.abs("closing")).when(no % 7 == 0, F.col("closing") + 1).otherwise(F.col("closing"))
    return ledger.account_month(spark, sf_dir).select(*KEYS, "account", value.cast("decimal(28,2)").alias("reported"))


def extracted(spark, sf_dir):
    return ledger.account_month(spark, sf_dir).select(*KEYS, "account", F.col("closing").alias("read"))


def names(spark, sf_dir):
    return named.accounts(spark, sf_dir).select(*KEYS, F.col("account").alias("name"))


def credits(spark, sf_dir):
    return ledger.income(spark, sf_dir).select(*KEYS, "account", "amount", "ord")


def receipts(spark, sf_dir):
    return credits(spark, sf_dir).filter("ord % 4 <> 0")


def queries(on, plain) -> dict:
    w, t, d, at, a = withholdings, named.tax_payments, named.day_payments, attachments, ledger.account_month
    return {
        "j2_consolidated_by_list": on(op.consolidated_by_list, t, w),
        "j3_consolidated_by_pool": on(op.consolidated_by_pool, t, w),
        "j4_many_to_one": on(op.many_to_one, w, d),
        "j5_fiscal_amounts": on(op.fiscal_amounts, w, named.fiscal_reports),
        "j6_unpaired": on(op.unpaired, entries, settled, at),
        "j7_orphan_payments": on(op.orphan_payments, d, w),
        "j8_listing_vs_attachment": on(op.listing_vs_attachment, entries, at),
        "j10_invoice_missing": on(op.invoice_missing, entries, at),
        "j14_pages_shared": on(op.pages_shared, entries, at),
        "j16_canonical_names": on(op.canonical_names, names, names),
        "j17_signs_reconciled": on(op.signs_reconciled, reported, extracted),
        "j19_reclassified_vendors": on(op.reclassified_vendors, entries),
        "j23_paired_by_value": on(op.paired_by_value, credits, receipts),
        "f24_document_facts": on(op.document_facts, at),
        "a2_sum_vs_declared": on(op.sum_vs_declared, ledger.expense, declared),
        "a4_category_vs_balance": on(op.category_vs_balance, category_evidence, balance_categories),
        "a9_repeated_documents": on(op.repeated_documents, entries),
        "a11_slip_groups": on(op.slip_groups, slips, unread),
        "a17_subset_sums": on(op.subset_sums, quarter_items, targets),
        "a20_merged_balance": lambda spark, sf_dir: plain(op.merged_balance(checks.month_balance(a(spark, sf_dir)), second_source(spark, sf_dir))),
        "a23_net_debits": on(op.debit_net_of_transfers, named.accounts, entries),
        "a24_income_source": on(op.income_source, a, ledger.income),
        "a25_missing_tax_ids": on(op.missing_tax_ids, at, entries),
        "a26_typed_evidence": on(op.typed_evidence, at),
    }

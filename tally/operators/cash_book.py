"""Checks of a cash book, whose rows are expense and receipt at once, as a building's profile asks for them.

Every check takes the same rows and gives the same columns; the profile, a table of (condo_id, check), is
joined to their union, so that buildings with different checks share one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import documents, identity
from tally.functions.calendar import next_business_days
from tally.functions.text import invoice_no, norm_text
from tally.operators.rules import KEYS, before
from tally.sources.ledger import month_no

CHECKS = ["duplicate", "declared_total", "late", "invoice", "category"]
LATE = 120


def _found(rows: DataFrame, check: str, severity: Column | str, confidence: float, subject: str, amount: Column, n: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(*KEYS, F.lit(check).alias("check"), severity.alias("severity"), F.lit(confidence).alias("confidence"), F.col(subject).cast("string").alias("subject"), amount.cast("decimal(28,2)").alias("amount"), n.cast("long").alias("n"))


def duplicates(rows: DataFrame) -> DataFrame:
    """A9 with F30: one vendor's document (or due date) and amount twice or more, unless the covers' complements or the receipts'
    signatures tell the payments apart."""
    document = F.coalesce("document", F.col("due").cast("string"))
    signature = F.to_json(documents.receipt_signature(F.col("text")))
    by = rows.groupBy(*KEYS, "vendor", document.alias("document"), "amount", documents.cover_complement(F.coalesce("text", F.lit(""))).alias("complement"), signature.alias("signature"))
    groups = by.agg(F.count("*").alias("n"), F.min("code").alias("code")).filter("n >= 2")
    return _found(groups, "duplicate", "attention", 0.8, "code", F.col("amount"), F.col("n"))


def totals(rows: DataFrame, profile: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """A2: all of a month's rows against the total that the book declares, per page or in all."""
    sums = rows.groupBy(*KEYS).agg(F.sum("amount").alias("sum"), F.count("*").alias("n"))
    off = sums.join(profile, KEYS).filter(F.abs(F.col("sum") - F.col("declared")) > tolerance).withColumn("subject", F.date_format("month", "yyyy-MM"))
    return _found(off, "declared_total", "critical", 1.0, "subject", F.col("sum") - F.col("declared"), F.col("n"))


def late(rows: DataFrame) -> DataFrame:
    """Paid after the first business day on or after the due date, up to LATE days."""
    paid = rows.join(next_business_days(rows, "due"), "due").withColumn("days", F.datediff("paid", "business")).filter(F.col("days").between(1, LATE))
    return _found(paid, "late", F.when(F.col("days") > 30, "high").otherwise("attention"), 1.0, "code", F.col("amount"), F.col("days"))


def invoices(rows: DataFrame) -> DataFrame:
    """J10 on the rows' own text: a description that names an invoice whose number the text lacks; summary lines have no text to
    look at, nor have texts without a word of an invoice."""
    number = invoice_no(F.col("description"))
    asked = rows.filter(~F.col("is_summary")).withColumn("number", number).filter(F.col("number").isNotNull() & ~identity.is_kind(F.col("description"), "withholding"))
    missing = asked.filter(~documents.invoice_in_page(F.coalesce("text", F.lit("")), F.col("number")))
    return _found(missing, "invoice", "attention", 0.7, "code", F.col("amount"), F.lit(1))


def categories(rows: DataFrame) -> DataFrame:
    """A category that none of the six months before has, where there is history."""
    sums = rows.groupBy(*KEYS, norm_text(F.col("category")).alias("category")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).withColumn("no", month_no(F.col("month")))
    months = sums.select("condo_id", "no").distinct().withColumn("past", F.count("*").over(before("condo_id"))).filter("past > 0").select("condo_id", "no")
    new = sums.withColumn("seen", F.count("*").over(before("condo_id", "category"))).filter("seen = 0").join(months, ["condo_id", "no"], "left_semi")
    return _found(new, "category", "informative", 0.5, "category", F.col("amount"), F.col("n"))


def cash_book_findings(rows: DataFrame, declared: DataFrame, profile: DataFrame) -> DataFrame:
    """All checks over ``rows``, of which a building's ``profile`` (condo_id, check) keeps those that it has."""
    every = [duplicates(rows), totals(rows, declared), late(rows), invoices(rows), categories(rows)]
    return reduce(DataFrame.unionByName, every).join(profile, ["condo_id", "check"], "left_semi")

"""Queries over files and what they say: identity, account names, transfers, facts traced to the text, cash books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import cash_book, file_identity, matching, review_layer
from tally.sources import files
from tally.sources.ledger import month_no
from tally.sources.stored import stored

KEYS = ["condo_id", "month"]
written, canonical, book = stored(files.written_accounts), stored(files.canonical_accounts), stored(files.cash_book)


def book_totals(spark, sf_dir):
    """What a month's book declares: five cents off for some."""
    rows = book(spark, sf_dir).groupBy(*KEYS).agg(F.sum("amount").alias("sum"))
    off = F.when((F.col("condo_id") + month_no(F.col("month"))) % 7 == 0, F.lit("0.05")).otherwise(F.lit("0")).cast("decimal(4,2)")
    return rows.select(*KEYS, (F.col("sum") + off).cast("decimal(28,2)").alias("declared"))


def profile(spark, sf_dir):
    """(condo_id, check): each building leaves one of the checks off, every fourth has none."""
    rows = book(spark, sf_dir).select("condo_id").distinct().filter("condo_id % 4 <> 3")
    checks = F.posexplode(F.array(*map(F.lit, cash_book.CHECKS))).alias("at", "check")
    return rows.select("condo_id", checks).filter(F.col("at") != F.col("condo_id") % len(cash_book.CHECKS)).select("condo_id", "check")


def queries(on, plain) -> dict:
    return {
        "s6_file_identity": on(file_identity.file_identity, files.headers, files.buildings, files.aliases),
        "j16_resolved_names": on(matching.resolved_names, written, canonical),
        "j24_inferred_transfers": on(matching.inferred_transfers, files.residuals),
        "q3_untraced_descriptions": on(review_layer.untraced_descriptions, files.cited, files.statement_text),
        "a27_cash_book": on(cash_book.cash_book_findings, book, book_totals, profile),
    }

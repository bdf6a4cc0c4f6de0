"""Arithmetic checks and reconciliation of expenses with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.rules import KEYS


def extraction_check(expense: DataFrame, account_month: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """A1: entries per account against the account's debits; accounts without entries are left out."""
    sums = expense.groupBy(*KEYS, "account").agg(F.sum("amount").alias("entries"))
    gap = F.col("entries") - F.col("debits")
    return sums.join(account_month.select(*KEYS, "account", "debits"), [*KEYS, "account"]).withColumn("gap", gap).filter(F.abs("gap") > tolerance)


def account_identity(account_month: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Opening + credits - debits = closing."""
    gap = F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")
    return account_month.withColumn("gap", gap).filter(F.abs("gap") > tolerance).select(*KEYS, "account", "gap")


def duplicate_codes(expense: DataFrame) -> DataFrame:
    """A code twice or more with one amount."""
    return expense.groupBy(*KEYS, "code").agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("amount")).filter("n >= 2 and least = amount").drop("least")


def negative_expense(expense: DataFrame) -> DataFrame:
    """One finding per month that lists the negative entries."""
    rows = expense.filter(F.col("amount") < -0.005)
    return rows.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.sum("amount").alias("total"))


def category_rollup(expense: DataFrame) -> DataFrame:
    """Categories of a month with their share and rank."""
    from pyspark.sql import Window as W

    sums = expense.groupBy(*KEYS, "category").agg(F.sum("amount").alias("total"))
    month = W.partitionBy(*KEYS)
    share = F.round(F.col("total").cast("double") / F.nullif(F.sum("total").over(month).cast("double"), F.lit(0.0)), 6)
    return sums.withColumn("share", share).withColumn("rank", F.row_number().over(month.orderBy(F.desc("total"), "category")))


def month_balance(account_month: DataFrame) -> DataFrame:
    """A month's totals over its accounts."""
    return account_month.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("opening", "credits", "debits", "closing", "yield_amt")), F.count("*").alias("accounts"))


def pair_by_code(expense: DataFrame, evidence: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each code once against the largest payment of its code: verified, divergent or without evidence."""
    listed = expense.groupBy(*KEYS, "code").agg(F.max("amount").alias("amount"))
    paid = evidence.groupBy(*KEYS, "code").agg(F.max("paid_amount").alias("paid_amount"))
    gap = F.abs(F.col("amount") - F.col("paid_amount"))
    kind = F.when(F.col("paid_amount").isNull(), "missing_evidence").when(gap <= tolerance, "verified").otherwise("divergent_amount")
    return listed.join(paid, [*KEYS, "code"], "left").withColumn("type", kind)

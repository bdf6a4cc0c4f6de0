"""More rules that compare a month with the months before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.operators.rules import KEYS, before, earlier, negative_streak, numbered, previous


def budget_change(issuance: DataFrame, limit: float = 0.3) -> DataFrame:
    """R3 (c): a line's budget away from its median in the history by more than ``limit``."""
    usual = earlier(issuance).groupBy(*KEYS, "line").agg(F.median(F.col("budget").cast("double")).alias("usual")).filter("usual > 0")
    moved = F.abs(F.col("budget").cast("double") / F.col("usual") - 1)
    return issuance.join(usual, [*KEYS, "line"]).filter(moved > limit).select(*KEYS, "line", "budget", F.round("usual", 4).alias("usual"))


def missing_line(issuance: DataFrame, least: int = 2) -> DataFrame:
    """R3 (a), U3: lines of all history months (``least`` or more) that the month lacks."""
    lines = issuance.select(*KEYS, "line").distinct()
    months = issuance.select(*KEYS).distinct()
    known = earlier(months).groupBy(*KEYS).agg(F.count("*").alias("months")).filter(F.col("months") >= least)
    common = earlier(lines).groupBy(*KEYS, "line").agg(F.count("*").alias("n")).join(known, KEYS).filter("n = months")
    return common.join(months, KEYS, "left_semi").join(lines, [*KEYS, "line"], "left_anti").select(*KEYS, "line", "months")


def negative_balance_alert(account_month: DataFrame, least: float = 1.0) -> DataFrame:
    """One finding per month that lists its negative accounts with their streaks."""
    rows = negative_streak(account_month, 1).filter(F.col("closing") <= -least)
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "account", "streak")))
    return rows.groupBy(*KEYS).agg(F.array_join(listed, ",").alias("accounts"), F.sum("closing").alias("total"))


def category_switch(expense: DataFrame, mass: int = 8) -> DataFrame:
    """A vendor known from the history, but never under this category; more than ``mass`` in a month are one move."""
    now = numbered(expense.groupBy(*KEYS, "vendor", "category").agg(F.sum("amount").alias("total")))
    known, here = F.count("*").over(before("condo_id", "vendor")), F.count("*").over(before("condo_id", "vendor", "category"))
    moved = now.withColumn("known", known).withColumn("here", here).filter("known > 0 and here = 0")
    counts = moved.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return moved.join(counts, KEYS).select(*KEYS, "vendor", "category", "total", F.when(F.col("n") > mass, "mass").otherwise("single").alias("kind"))


def new_category_totals(expense: DataFrame, least: float = 1000) -> DataFrame:
    """Categories of ``least`` or more that the previous month lacks, where there is a previous month."""
    now = expense.groupBy(*KEYS, "category").agg(F.sum("amount").alias("total"))
    before = previous(now.select(*KEYS, "category"))
    return now.filter(F.col("total") >= least).join(before.select(*KEYS).distinct(), KEYS, "left_semi").join(before, [*KEYS, "category"], "left_anti")


def series_stopped(expense: DataFrame) -> DataFrame:
    """Installment series that had not ended in the previous month and have no entry now; their highest number."""
    series = expense.filter("inst_n is not null").groupBy(*KEYS, "vendor", "inst_total").agg(F.max("inst_n").alias("last_n"))
    open_before = previous(series.filter("last_n < inst_total"))
    there = expense.select(*KEYS).distinct()
    return open_before.join(there, KEYS, "left_semi").join(series, [*KEYS, "vendor", "inst_total"], "left_anti").select(*KEYS, "vendor", "last_n")


def reserve_usage(expense: DataFrame, least: float = 0.01) -> DataFrame:
    """What was spent from the reserve fund."""
    rows = expense.filter(F.col("account").rlike("RESERVA") & (F.col("amount") >= least))
    return rows.groupBy(*KEYS).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def delinquency_growth(indicator: DataFrame, share: float = 0.2, least: float = 1000) -> DataFrame:
    """Delinquency up by ``share`` and ``least`` on the previous month; unknown values have no finding."""
    before = previous(indicator.select(*KEYS, F.col("delinquent").alias("previous_delinquent")))
    grown = F.col("delinquent") - F.col("previous_delinquent")
    found = (F.col("previous_delinquent") > 0) & (grown >= least) & (grown.cast("double") / F.col("previous_delinquent").cast("double") >= share)
    return indicator.join(before, KEYS).filter(found).select(*KEYS, "delinquent", "previous_delinquent")


def top_items(expense: DataFrame, most: int = 6) -> DataFrame:
    """K2: the ``most`` largest entries of each category of a month."""
    order = W.partitionBy(*KEYS, "category").orderBy(F.desc(F.abs("amount")), "code")
    rows = expense.select(*KEYS, "category", "code", "amount").distinct().withColumn("rank", F.row_number().over(order))
    return rows.filter(F.col("rank") <= most)

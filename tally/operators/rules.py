"""Ledger rules: each takes ledger tables of all buildings and months and returns its findings.

"Previous" is the calendar month before; history is the six months before. Missing months are simply absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.identity import structural_negative
from tally.functions.text import account_key, norm_text

CENT = 0.011
HISTORY = 6
KEYS = ["condo_id", "month"]


def previous(df: DataFrame) -> DataFrame:
    """The table moved one month on, to stand beside the month that follows."""
    return df.withColumn("month", F.add_months("month", 1))


def earlier(df: DataFrame, months: int = HISTORY) -> DataFrame:
    """Each row once for every month that has it in its history: an equi-join instead of a range join."""
    return df.withColumn("ago", F.explode(F.sequence(F.lit(1), F.lit(months)))).withColumn("month", F.expr("add_months(month, ago)"))


def before(*keys: str, months: int = HISTORY):
    """The rows of the same keys in the ``months`` months before, by a column ``no``: one shuffle on the keys, no copies."""
    from pyspark.sql import Window as W

    return W.partitionBy(*keys).orderBy("no").rangeBetween(-months, -1)


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("no", F.year("month") * 12 + F.month("month"))


def with_history(df: DataFrame, least: int = 1) -> DataFrame:
    """(condo_id, month) with ``least`` months or more among the six before."""
    months = numbered(df.select(*KEYS).distinct())
    return months.withColumn("n", F.count("*").over(before("condo_id"))).filter(F.col("n") >= least).select(*KEYS)


def negative_income(income: DataFrame) -> DataFrame:
    """Negative income by description without digits; movements of investments are left out."""
    described = F.trim(F.regexp_replace(norm_text(F.col("description")), " *[0-9]+ *", " "))
    return (
        income.filter((F.col("amount") < -CENT) & ~structural_negative(F.col("description")))
        .groupBy(*KEYS, described.alias("description"))
        .agg(F.sum("amount").alias("total"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("account")), ",").alias("accounts"))
    )


def category_variation(expense: DataFrame, limit: float = 1.0, least: float = 1000) -> DataFrame:
    """A category that moved by more than ``limit`` and ``least`` against the previous month."""
    now = expense.groupBy(*KEYS, "category").agg(F.sum("amount").alias("total"))
    before = previous(now).withColumnRenamed("total", "previous_total")
    moved = F.abs(F.col("total") - F.col("previous_total"))
    return now.join(before, [*KEYS, "category"]).filter((F.col("previous_total") > CENT) & (moved >= least) & (moved / F.col("previous_total") > limit))


def repeated_invoice(expense: DataFrame) -> DataFrame:
    """The same vendor and invoice in the history months; installments are exempt."""
    rows = numbered(expense.filter("inst_n is null").groupBy(*KEYS, "vendor", "invoice").agg(F.sum("amount").alias("total")))
    past = before("condo_id", "vendor", "invoice")
    return rows.withColumn("earlier_months", F.count("*").over(past)).withColumn("earlier_total", F.sum("total").over(past)).filter("earlier_months > 0").drop("no")


def collection_rate(issuance: DataFrame, least: float = 0.9, most: float = 1.0) -> DataFrame:
    """Collected over budget outside the band, with the previous month's rate."""
    rate = issuance.groupBy(*KEYS).agg(F.sum("budget").alias("budget"), F.sum("collected").alias("collected")).filter("budget > 0").withColumn("rate", F.col("collected").cast("double") / F.col("budget").cast("double"))
    before = previous(rate.select(*KEYS, F.col("rate").alias("previous_rate")))
    return rate.filter((F.col("rate") < least) | (F.col("rate") > most)).join(before, KEYS, "left")


def negative_streak(account_month: DataFrame, months: int = 3) -> DataFrame:
    """Closing below zero for ``months`` consecutive months up to HISTORY + 1; the streak's length."""
    below = account_month.filter(F.col("closing") < -CENT).select(*KEYS, "account", "closing")
    past = earlier(below.select(*KEYS, "account")).groupBy(*KEYS, "account").agg(F.collect_set("ago").alias("agos"))
    run = F.array_min(F.array_append(F.array_except(F.sequence(F.lit(1), F.lit(HISTORY)), F.coalesce("agos", F.array().cast("array<int>"))), F.lit(HISTORY + 1)))
    return below.join(past, [*KEYS, "account"], "left").withColumn("streak", run.cast("int")).filter(F.col("streak") >= months).drop("agos")


def balance_continuity(account_month: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """An opening that isn't the previous closing; accounts match by key."""
    keyed = account_month.withColumn("key", account_key(F.col("account")))
    before = previous(keyed).select(*KEYS, "key", F.col("closing").alias("previous_closing"))
    gap = F.col("opening") - F.col("previous_closing")
    return keyed.join(before, [*KEYS, "key"]).filter(F.abs(gap) > tolerance).select(*KEYS, "account", "opening", "previous_closing", gap.alias("gap"))


def inter_account_movement(account_month: DataFrame, least: float = 1000) -> DataFrame:
    """What an account's own credits and debits leave unexplained."""
    rest = F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")
    return account_month.withColumn("movement", rest).filter(F.abs("movement") >= least).select(*KEYS, "account", "movement")


def disproportionate_yield(account_month: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Yields over the mean balance away from the median of the month's accounts."""
    base = F.greatest(F.lit(0.0), (F.col("opening").cast("double") + F.col("closing").cast("double")) / 2)
    rows = account_month.withColumn("base", base).filter((F.col("base") > CENT) & (F.col("yield_amt") > 0)).withColumn("rate", F.col("yield_amt").cast("double") / F.col("base"))
    middle = rows.groupBy(*KEYS).agg(F.median("rate").alias("middle"), F.count("*").alias("n")).filter("n >= 2 and middle > 0")
    return rows.join(middle, KEYS).filter(F.abs(F.col("rate") / F.col("middle") - 1) > tolerance).select(*KEYS, "account", F.round("rate", 6).alias("rate"), F.round("middle", 6).alias("median_rate"))


def installments_same_month(expense: DataFrame) -> DataFrame:
    """Two or more different installments of one series in a month, none of them in the month before."""
    series = expense.filter("inst_n is not null").groupBy(*KEYS, "vendor", "inst_total").agg(F.array_sort(F.collect_set("inst_n")).alias("numbers"), F.sum("amount").alias("total"))
    before = previous(series).select(*KEYS, "vendor", "inst_total", F.col("numbers").alias("seen"))
    joined = series.filter(F.size("numbers") >= 2).join(before, [*KEYS, "vendor", "inst_total"], "left")
    return joined.filter(~F.coalesce(F.arrays_overlap("numbers", "seen"), F.lit(False))).select(*KEYS, "vendor", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "total")


def new_category(expense: DataFrame) -> DataFrame:
    """Subcategories that no history month has; months without any history are left out."""
    now = numbered(expense.groupBy(*KEYS, "subcategory").agg(F.sum("amount").alias("total"), F.count("*").alias("n")))
    new = now.withColumn("seen", F.count("*").over(before("condo_id", "subcategory"))).filter("seen = 0").drop("seen", "no")
    return new.join(with_history(expense), KEYS, "left_semi")


def late_payment(expense: DataFrame) -> DataFrame:
    """R20 without the holiday calendar: paid after the due date moved off weekends, up to 120 days; over 30 is high."""
    weekday = F.dayofweek("due")
    business = F.date_add("due", F.when(weekday == 7, 2).when(weekday == 1, 1).otherwise(0))
    late = F.datediff("paid", business)
    return expense.withColumn("days", late).filter("days > 0 and days <= 120").select(*KEYS, "code", "days", F.when(F.col("days") > 30, "high").otherwise("attention").alias("severity"))


def missing_recurrent(expense: DataFrame, months: int = 3, least: float = 500) -> DataFrame:
    """Vendors present in each of the last ``months`` months and absent now, median of the months' sums at least ``least``."""
    from pyspark.sql import Window as W

    sums = numbered(expense.groupBy(*KEYS, "vendor").agg(F.sum("amount").alias("total")))
    by_vendor = W.partitionBy("condo_id", "vendor").orderBy("no")
    last = sums.withColumn("totals", F.array_sort(F.collect_list(F.col("total").cast("double")).over(by_vendor.rangeBetween(1 - months, 0)))).withColumn("after", F.lead("no").over(by_vendor))
    middle = (F.get("totals", F.lit((months - 1) // 2)) + F.get("totals", F.lit(months // 2))) / 2
    gone = last.filter((F.size("totals") == months) & (F.coalesce("after", F.lit(0)) != F.col("no") + 1)).withColumn("usual", middle).filter(F.col("usual") >= least)
    return previous(gone.select(*KEYS, "vendor", F.round("usual", 2).alias("usual"))).join(expense.select(*KEYS).distinct(), KEYS, "left_semi")


def round_amount(expense: DataFrame, least: float = 2000, multiple: int = 100) -> DataFrame:
    """Round amounts without installment."""
    cents = (F.col("amount") * 100).cast("long")
    return expense.filter((F.col("amount") >= least) & (F.pmod(cents, F.lit(multiple * 100)) == 0) & F.col("inst_n").isNull()).select(*KEYS, "code", "amount")


def duplicate_in_month(expense: DataFrame, least: float = 100) -> DataFrame:
    """The same description and amount twice or more in a month, no installment."""
    rows = expense.filter((F.col("amount") >= least) & F.col("inst_n").isNull())
    return rows.groupBy(*KEYS, norm_text(F.col("description")).alias("description"), "amount").agg(F.count("*").alias("n")).filter("n >= 2")


def account_deficit(account_month: DataFrame, least: float = 1000, share: float = 0.05) -> DataFrame:
    """The ordinary account spent more than it took."""
    gap = F.col("debits") - F.col("credits")
    return account_month.filter((F.col("account") == "ORDINARIA") & (gap >= least) & (gap > F.col("credits") * share)).select(*KEYS, "account", gap.alias("deficit"))


def finding(df: DataFrame, kind: str, rule: str, subject: Column, amount: Column) -> DataFrame:
    return df.select(*KEYS, F.lit(kind).alias("type"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), amount.cast("decimal(18,2)").alias("amount"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """One set of findings with numbers per building and month, ordered by rule, subject and amount."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*KEYS).orderBy("rule", "subject", "amount")
    return reduce(DataFrame.unionByName, parts).withColumn("finding_id", F.format_string("RG-%04d", F.row_number().over(order)))

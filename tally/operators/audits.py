"""Audits over stored results, bank statements, business days and vendor history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.calendar import next_business_days
from tally.functions.text import norm_text
from tally.operators.checks import account_identity, extraction_check
from tally.operators.rules import CENT, KEYS, before, disproportionate_yield, negative_streak, numbered, previous, with_history


def yield_concentrated(account_month: DataFrame, least: float = 10000) -> DataFrame:
    """One account yields while the others hold ``least`` or more on average, and R11 found nothing in that month."""
    mean = (F.col("opening").cast("double") + F.col("closing").cast("double")) / 2
    idle = F.avg(F.when(F.col("yield_amt") <= CENT, mean))
    months = account_month.groupBy(*KEYS).agg(F.count_if(F.col("yield_amt") > CENT).alias("yielding"), F.round(idle, 2).alias("others"), F.sum("yield_amt").alias("total"))
    found = disproportionate_yield(account_month).select(*KEYS).distinct()
    return months.filter((F.col("yielding") == 1) & (F.col("others") >= least)).join(found, KEYS, "left_anti").select(*KEYS, "others", "total")


def late_by_business_days(expense: DataFrame) -> DataFrame:
    """Paid after the first business day on or after the due date, up to 120 days; over 30 is high."""
    rows = expense.join(next_business_days(expense, "due"), "due").withColumn("days", F.datediff("paid", "business"))
    return rows.filter("days > 0 and days <= 120").select(*KEYS, "code", "business", "days", F.when(F.col("days") > 30, "high").otherwise("attention").alias("severity"))


def bank_statement_check(expense: DataFrame, bank: DataFrame) -> DataFrame:
    """An expense is one of its day's outflows, or all of them together; else it isn't in the extract."""
    day = ["condo_id", "paid"]
    single = bank.select(*day, F.col("paid_amount").alias("amount")).distinct().withColumn("hit", F.lit(True))
    sums = bank.groupBy(*day).agg(F.sum("paid_amount").alias("day_total"))
    listed = expense.groupBy(*KEYS, "paid", "code").agg(F.max("amount").alias("amount"))
    state = F.when(F.col("hit"), "verified").when(F.abs(F.col("amount") - F.col("day_total")) <= 0.01, "day_total").otherwise("not_in_extract")
    return listed.join(single, [*day, "amount"], "left").join(sums, day, "left").select(*KEYS, "code", "amount", state.alias("state"))


def read_integrity(expense: DataFrame, account_month: DataFrame) -> DataFrame:
    """Q2: warnings of the extraction and identity checks per building."""
    warned = extraction_check(expense, account_month).select("condo_id", F.lit("A1").alias("check"))
    warned = warned.unionByName(account_identity(account_month).select("condo_id", F.lit("A6").alias("check")))
    return warned.groupBy("condo_id", "check").agg(F.count("*").alias("warnings"))


def uncovered_negatives(account_month: DataFrame, least: float = 1.0) -> DataFrame:
    """Q6: negative closings that no finding on negative streaks covers."""
    below = account_month.filter(F.col("closing") <= -least).select(*KEYS, "account", "closing")
    return below.join(negative_streak(account_month), [*KEYS, "account"], "left_anti")


def union_by_priority(account_month: DataFrame) -> DataFrame:
    """Streaks and single negative closings in one set, one row per account and month, the streak first."""
    streak = negative_streak(account_month).select(*KEYS, "account", "closing", F.lit("R7").alias("rule"))
    single = account_month.filter(F.col("closing") < -CENT).select(*KEYS, "account", "closing", F.lit("R8").alias("rule"))
    both = streak.unionByName(single).groupBy(*KEYS, "account").agg(F.min_by(F.struct("rule", "closing"), "rule").alias("x"))
    return both.select(*KEYS, "account", "x.rule", "x.closing")


def financial_analysis(account_month: DataFrame) -> DataFrame:
    """An account's deficit, its change on the previous month, and what deserves attention."""
    before = previous(account_month.select(*KEYS, "account", F.col("closing").alias("previous_closing")))
    rows = account_month.join(before, [*KEYS, "account"], "left")
    change = F.col("closing") - F.col("previous_closing")
    points = F.array_compact(F.array(F.when(F.col("debits") > F.col("credits"), "deficit"), F.when(F.col("closing") < 0, "negative"), F.when(change < 0, "falling")))
    return rows.select(*KEYS, "account", (F.col("credits") - F.col("debits")).alias("result"), change.alias("change"), F.array_join(points, ",").alias("attention"))


def processing_overview(balance: DataFrame) -> DataFrame:
    """Months with data and months between a building's first and last one."""
    span = F.months_between(F.max("month"), F.min("month")).cast("int") + 1
    return balance.groupBy("condo_id").agg(F.count("*").alias("processed"), span.alias("total"))


def vendor_stability(expense: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of the previous month's vendors that the month before it has too."""
    vendors = expense.select(*KEYS, "vendor").distinct()
    kept = previous(vendors).withColumn("kept", F.lit(1))
    share = F.round(F.count("kept") / F.count("*"), 6)
    month = vendors.join(kept, [*KEYS, "vendor"], "left").groupBy(*KEYS).agg(F.count("*").alias("vendors"), share.alias("share"))
    return previous(month).join(vendors.select(*KEYS).distinct(), KEYS, "left_semi").withColumn("stable", F.col("share") >= least)


def new_vendor(expense: DataFrame, least: float = 3000, months: int = 2) -> DataFrame:
    """G1 by exact names: vendors of ``least`` or more that no history month has, given ``months`` of history."""
    sums = numbered(expense.groupBy(*KEYS, "vendor").agg(F.sum("amount").alias("total")))
    new = sums.withColumn("seen", F.count("*").over(before("condo_id", "vendor"))).filter((F.col("seen") == 0) & (F.col("total") >= least)).drop("seen", "no")
    return new.join(with_history(expense, months), KEYS, "left_semi")


def expense_keys(expense: DataFrame) -> DataFrame:
    """The vendor's key, and the description's second part that stands in for it."""
    part = F.get(F.split("description", " - "), F.lit(1))
    return expense.select("vendor", F.coalesce(F.nullif(norm_text(F.col("vendor")), F.lit("")), norm_text(part)).alias("key"), norm_text(part).alias("second")).distinct()


def income_kinds(income: DataFrame) -> DataFrame:
    """income by the first keyword family that its description names."""
    d = norm_text(F.col("description"))
    kind = F.when(d.rlike("RENDIMENTO|APLICAC"), "yield").when(d.rlike("TRANSFER"), "transfer").when(d.rlike("MULTA|JUROS"), "fine_interest").when(d.rlike("COTA|TAXA COND"), "quota").otherwise("other")
    return income.groupBy(*KEYS, kind.alias("kind")).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def base_balances(account_month: DataFrame) -> DataFrame:
    """an account's base by mean, opening and closing, none below zero, and the month's last day."""
    zero, opening, closing = F.lit(0.0), F.col("opening").cast("double"), F.col("closing").cast("double")
    return account_month.select(*KEYS, "account", F.greatest(zero, (opening + closing) / 2).alias("mean_base"), F.greatest(zero, opening).alias("opening_base"), F.greatest(zero, closing).alias("closing_base"), F.last_day("month").alias("last_day"))


def latest_versions(imports: DataFrame) -> DataFrame:
    """Of the imports of a building and month, the newest one and how many there were."""
    rows = imports.withColumn("month", F.trunc("ts", "month"))
    newest = F.max_by(F.struct("event_id", "status"), F.struct("ts", "event_id"))
    return rows.groupBy(*KEYS).agg(F.count("*").cast("int").alias("version"), newest.alias("x")).select(*KEYS, "version", "x.*")

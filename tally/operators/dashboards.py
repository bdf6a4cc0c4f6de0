"""Tables behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.operators.rules import KEYS


def period_kpis(balance: DataFrame) -> DataFrame:
    """Per building, last balance and flows of the whole period."""
    last = F.max_by("closing", "month")
    return balance.groupBy("condo_id").agg(F.count("*").alias("months"), F.sum("credits").alias("inflow"), F.sum("debits").alias("outflow"), last.alias("last_balance"))


def budget_tracking(issuance: DataFrame) -> DataFrame:
    """Cumulative budget and collection with a badge on the gap."""
    month = issuance.groupBy(*KEYS).agg(F.sum("budget").alias("budget"), F.sum("collected").alias("collected"))
    up_to = W.partitionBy("condo_id").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    out = month.withColumn("budget_to_date", F.sum("budget").over(up_to)).withColumn("collected_to_date", F.sum("collected").over(up_to))
    gap = F.col("collected_to_date") - F.col("budget_to_date")
    return out.withColumn("badge", F.when(gap < -50000, "red").when(gap < -20000, "yellow").otherwise("green"))


def account_buckets(account_month: DataFrame) -> DataFrame:
    """Positive closing balances by bucket."""
    of = lambda name: F.sum(F.when((F.col("account") == name) & (F.col("closing") > 0), F.col("closing")).otherwise(0))
    return account_month.groupBy(*KEYS).agg(of("ORDINARIA").alias("ordinary"), of("FUNDO DE RESERVA").alias("reserve"), of("FUNDO DE OBRAS").alias("works"))


def balance_evolution(balance: DataFrame) -> DataFrame:
    """Closing balances in order, with the change since the row before."""
    before = F.lag("closing").over(W.partitionBy("condo_id").orderBy("month"))
    return balance.select(*KEYS, "closing", (F.col("closing") - before).alias("change"))


def snapshot_latest(balance: DataFrame) -> DataFrame:
    """Last month and number of months per building."""
    return balance.groupBy("condo_id").agg(F.max("month").alias("last_month"), F.count("*").alias("months"), F.max_by(F.struct("opening", "credits", "debits", "closing"), "month").alias("last")).select("condo_id", "last_month", "months", "last.*")


def last_import(imports: DataFrame) -> DataFrame:
    """The newest import per building."""
    return imports.groupBy("condo_id").agg(F.max_by(F.struct("event_id", "status"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("imports")).select("condo_id", "last.event_id", "last.status", "imports")

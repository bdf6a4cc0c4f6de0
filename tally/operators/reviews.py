"""Reconciliation by documents, waivers on findings, and more tables behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.operators.rules import KEYS


def category_closure(expense: DataFrame, account_month: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A5: a month's categories add up to the ordinary account's debits or to all debits; the nearest of the two."""
    categories = expense.groupBy(*KEYS).agg(F.sum("amount").alias("categories"))
    ordinary = F.sum(F.when(F.col("account") == "ORDINARIA", F.col("debits")).otherwise(0))
    debits = account_month.groupBy(*KEYS).agg(F.sum("debits").alias("all_debits"), ordinary.alias("ordinary_debits"))
    gap = F.least(F.abs(F.col("categories") - F.col("all_debits")), F.abs(F.col("categories") - F.col("ordinary_debits")))
    return categories.join(debits, KEYS).select(*KEYS, "categories", gap.alias("gap"), (gap <= tolerance).alias("closes"))


def duplicates_by_fields(expense: DataFrame) -> DataFrame:
    """The same due date, amount, category and description twice or more, each with a document number."""
    numbered = F.col("description").rlike(r"NF\. *[0-9]+|[0-9]{8,}")
    groups = expense.groupBy(*KEYS, "due", "amount", "category", "description").agg(F.count("*").alias("n"), F.bool_and(numbered).alias("numbered"))
    return groups.filter("n >= 2 and numbered").drop("numbered")


def audit_totals(account_month: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Account-months that don't close, per building and over all (building null)."""
    gap = F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")
    return account_month.rollup("condo_id").agg(F.count("*").alias("rows"), F.count_if(F.abs(gap) > tolerance).alias("failed"))


def delinquency_ratio(indicator: DataFrame, issuance: DataFrame) -> DataFrame:
    """Delinquent over collected in percent, where both are positive."""
    collected = issuance.groupBy(*KEYS).agg(F.sum("collected").alias("collected"))
    ratio = F.round(F.col("delinquent").cast("double") / F.col("collected").cast("double") * 100, 2)
    return indicator.join(collected, KEYS).filter("delinquent > 0 and collected > 0").select(*KEYS, "delinquent", "collected", ratio.alias("ratio"))


def shared_documents(slips: DataFrame) -> DataFrame:
    """Documents that two or more codes share, against the sum of those codes' expenses."""
    groups = slips.groupBy(*KEYS, "auth_id", "document_amount").agg(F.count_distinct("code").alias("codes"), F.sum("amount").alias("total")).filter("codes >= 2")
    equal = F.abs(F.col("total") - F.col("document_amount")) <= 0.02
    return groups.withColumn("confidence", F.when(equal, 0.6).otherwise(0.4))


def kth_pairing(expense: DataFrame, evidence: DataFrame) -> DataFrame:
    """The i-th entry of a date and amount with the i-th ledger line of the same; how many pair up and how many don't."""
    key = ["condo_id", "paid", "cents", "debit"]

    def numbered(rows: DataFrame, amount: str) -> DataFrame:
        keyed = rows.select("condo_id", "month", "paid", "code", (F.abs(amount) * 100).cast("long").alias("cents"), (F.col(amount) < 0).alias("debit"))
        return keyed.withColumn("i", F.row_number().over(W.partitionBy(*key).orderBy("code")))

    lines = numbered(evidence, "paid_amount").select(*key, "i", F.lit(1).alias("hit"))
    return numbered(expense, "amount").join(lines, [*key, "i"], "left").groupBy(*KEYS).agg(F.count("hit").alias("paired"), F.count_if(F.col("hit").isNull()).alias("left_over"))


def apply_waivers(findings: DataFrame, waivers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Findings that a waiver of the same type, subject and total covers become informative."""
    granted = waivers.select(*KEYS, "type", "subject", F.col("amount").alias("waived")).distinct()
    paired = findings.join(granted, [*KEYS, "type", "subject"], "left")
    covered = F.coalesce(F.abs(F.col("amount") - F.col("waived")) <= tolerance, F.lit(False))
    state = F.when(F.max(covered), "informative").otherwise("open")
    return paired.groupBy(*KEYS, "type", "rule", "subject", "amount").agg(state.alias("state"))


def open_items(reviewed: DataFrame) -> DataFrame:
    """P10: open and excluded findings of a month."""
    return reviewed.groupBy(*KEYS).agg(F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") != "open").alias("excluded"))


def month_card(balance: DataFrame, categories: DataFrame) -> DataFrame:
    """D3: a month's flows, their gap and its largest category with its share."""
    first = categories.filter("rank = 1").select(*KEYS, F.col("category").alias("top_category"), F.col("share").alias("top_share"))
    return balance.join(first, KEYS, "left").select(*KEYS, "opening", "credits", "debits", "closing", (F.col("credits") - F.col("debits")).alias("gap"), "top_category", "top_share")


def category_by_month(expense: DataFrame) -> DataFrame:
    """Categories of a year by calendar month; categories with nothing but zeros are left out."""
    rows = expense.select("condo_id", "category", F.year("month").alias("year"), F.date_format("month", "MM").alias("mm"), "amount")
    table = rows.groupBy("condo_id", "category", "year").pivot("mm", [f"{n:02d}" for n in range(1, 13)]).agg(F.sum("amount"))
    named = table.select("condo_id", "category", "year", *(F.coalesce(F.col(f"{n:02d}"), F.lit(0)).cast("decimal(28,2)").alias(f"m{n:02d}") for n in range(1, 13)))
    return named.filter(" or ".join(f"m{n:02d} <> 0" for n in range(1, 13)))


def budget_gap(issuance: DataFrame) -> DataFrame:
    """Collected against budget, with the building's mean lines."""
    month = issuance.groupBy(*KEYS).agg(F.sum("budget").cast("double").alias("budget"), F.sum("collected").cast("double").alias("collected"))
    gap = F.col("collected") - F.col("budget")
    means = month.groupBy("condo_id").agg(F.round(F.avg("budget"), 4).alias("mean_budget"), F.round(F.avg(gap), 4).alias("mean_gap"))
    share = F.when(F.col("budget") > 0, F.round(gap / F.col("budget") * 100, 4))
    return month.join(means, "condo_id").select(*KEYS, F.round(gap, 2).alias("gap"), share.alias("percent"), "mean_budget", "mean_gap")


def delinquency_status(indicator: DataFrame) -> DataFrame:
    """A month's delinquency against the building's own maximum."""
    most = indicator.groupBy("condo_id").agg(F.max("delinquent").cast("double").alias("most"))
    share = F.col("delinquent").cast("double") / F.col("most")
    status = F.when(share > 0.8, "high").when(share > 0.5, "medium").otherwise("low")
    return indicator.filter("delinquent is not null").join(most.filter("most > 0"), "condo_id").select(*KEYS, "delinquent", F.round(share, 6).alias("share"), status.alias("status"))


def building_status(snapshot: DataFrame, imports: DataFrame, expected: str) -> DataFrame:
    """Per building against the month ``expected`` (yyyy-MM-dd): current, pending, error or no_data.

    A failed last import counts only where the expected month isn't there yet.
    """
    reached = F.col("last_month") >= F.lit(expected).cast("date")
    status = F.when(F.col("last_month").isNull(), "no_data").when(reached, "current").when(F.col("status") == "error", "error").otherwise("pending")
    return snapshot.select("condo_id", "last_month").join(imports.select("condo_id", "status"), "condo_id", "full").select("condo_id", "last_month", status.alias("state"))


def lint_texts(texts: DataFrame) -> DataFrame:
    """Q4: placeholders left in a text, its questions, and whether a text that asks ends with a question mark."""
    text = F.coalesce("text", F.lit(""))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return texts.select("conv_id", "turn", text.rlike(r"\{\{|\}\}|TODO|XXX|\[\.\.\.\]").alias("placeholder"), questions.cast("long").alias("questions"), ((questions > 0) & ~text.rlike(r"\?[ \n]*$")).alias("trails"))

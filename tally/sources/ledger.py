"""Ledger tables: derived from the star schema, all buildings and months at once.

Amounts are decimals; months are first-of-month dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.sources.stored import at_hand, stored

BUILDINGS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def month_no(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(18,2)")


def expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per expense entry; entries with ord % 503 = 0 are there twice."""
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # orders come last: the rows then lie together by order, as one_per_code asks for them
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey).join(order, line.l_orderkey == order.o_orderkey)
    ord_no = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parts = F.round(F.col("l_discount") * 100).between(5, 5)
    account = F.when(F.col("l_returnflag") == "N", "ORDINARIA").when(F.col("l_returnflag") == "R", "FUNDO DE RESERVA").otherwise("FUNDO DE OBRAS")
    amount = money(F.col("l_extendedprice"))
    rows = joined.select(
        (F.col("o_custkey") % BUILDINGS).cast("int").alias("condo_id"),
        month_of(F.col("l_shipdate")).alias("month"),
        ord_no.alias("ord"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("code"),
        F.concat(F.col("p_name"), F.lit(" - "), F.col("s_name"), F.lit(" - NF. "), F.col("l_orderkey"), F.when(parts, F.concat(F.lit(" PARC "), F.col("l_linenumber"), F.lit("/7"))).otherwise("")).alias("description"),
        F.when(F.col("l_quantity") == 1, -amount).otherwise(amount).alias("amount"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_type", "p_brand").alias("subcategory"),
        account.alias("account"),
        F.col("s_name").alias("vendor"),
        F.col("l_orderkey").alias("invoice"),
        F.when(parts, F.col("l_linenumber")).cast("int").alias("inst_n"),
        F.when(parts, F.lit(7)).alias("inst_total"),
        F.date_add(F.col("o_orderdate"), 30).alias("due"),
        F.col("l_shipdate").cast("date").alias("paid"),
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("ord") % 503 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")


@stored
def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, month) of all expenses."""
    return at_hand(expense, spark, sf_dir).select("condo_id", "month").distinct()


def condos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return months(spark, sf_dir).select("condo_id").distinct()


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = read(spark, sf_dir, "orders")
    priority = F.upper("o_orderpriority")
    account = F.when(priority.rlike("^[123]"), "ORDINARIA").when(priority.rlike("^4"), "FUNDO DE RESERVA").otherwise("FUNDO DE OBRAS")
    word = F.when(F.col("o_orderstatus") == "O", "COTA").when(F.col("o_orderstatus") == "F", "MULTA").otherwise("OUTRA")
    amount = money(F.col("o_totalprice"))
    return order.select(
        (F.col("o_custkey") % BUILDINGS).cast("int").alias("condo_id"),
        month_of(F.col("o_orderdate")).alias("month"),
        F.col("o_orderkey").alias("ord"),
        account.alias("account"),
        F.concat(word, F.lit(" "), F.col("o_orderpriority")).alias("description"),
        F.when(F.col("o_orderkey") % 17 == 0, -amount).otherwise(amount).alias("amount"),
        F.when(F.col("o_orderstatus") == "O", "quota").when(F.col("o_orderstatus") == "F", "fine").otherwise("other").alias("kind"),
    )


def account_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balances(income(spark, sf_dir), at_hand(expense, spark, sf_dir))


def balances(income: DataFrame, expense: DataFrame) -> DataFrame:
    """Credits and debits per account and month; the running balance closes, and some openings break on purpose."""
    keys = ["condo_id", "month", "account"]
    zero = F.lit(0).cast("decimal(18,2)")
    moved = income.select(*keys, F.col("amount").alias("credit"), zero.alias("debit")).unionByName(expense.select(*keys, zero.alias("credit"), F.col("amount").alias("debit")))
    sums = moved.groupBy(*keys).agg(F.sum("credit").cast("decimal(18,2)").alias("credits"), F.sum("debit").cast("decimal(18,2)").alias("debits"))
    running = W.partitionBy("condo_id", "account").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    closed = sums.withColumn("closing", F.sum(F.col("credits") - F.col("debits")).over(running).cast("decimal(18,2)"))
    no = month_no(F.col("month"))
    broken = F.when((F.col("condo_id") * 7 + no + F.length("account")) % 13 == 0, F.lit(2500)).otherwise(F.lit(0)).cast("decimal(18,2)")
    share = F.round(F.abs("closing") * F.lit("0.005").cast("decimal(4,3)"), 2)
    earned = F.when((F.col("account") == "FUNDO DE OBRAS") & ((F.col("condo_id") + no) % 5 == 0), zero).when((F.col("condo_id") + no) % 7 == 0, share * 2).otherwise(share)
    return closed.select(*keys, "credits", "debits", (F.col("closing") - F.col("credits") + F.col("debits") + broken).cast("decimal(18,2)").alias("opening"), "closing", earned.cast("decimal(18,2)").alias("yield_amt"))


def issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget and collected amounts per income line of a building's month."""
    rows = income(spark, sf_dir).withColumn("line", F.split("description", " ")[0])
    paid = F.sum(F.when(F.col("kind") != "quota", F.abs("amount")).otherwise(0)).cast("decimal(18,2)")
    return rows.groupBy("condo_id", "month", "line").agg(F.round(F.sum(F.abs("amount")) * F.lit("1.05").cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("budget"), paid.alias("collected"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts: none for ord % 11 = 0, 100.00 too much for ord % 7 = 0."""
    rows = expense(spark, sf_dir).filter("ord % 11 <> 0")
    return rows.select("condo_id", "month", "code", F.when(F.col("ord") % 7 == 0, F.col("amount") + 100).otherwise(F.col("amount")).cast("decimal(18,2)").alias("paid_amount"), "paid", "account")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").otherwise("warning")
    return read(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % BUILDINGS).cast("int").alias("condo_id"), status.alias("status"))


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delinquent and recovered amounts of a month; some buildings don't declare the first."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount")).otherwise(0))
    sums = income(spark, sf_dir).groupBy("condo_id", "month").agg(of("quota").alias("quota"), of("fine").alias("recovered"))
    return sums.select("condo_id", "month", F.when(F.col("condo_id") % 10 != 0, F.col("quota")).alias("delinquent"), "recovered")


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expenses paid by a tax slip that several share; the slip's amount also covers expenses without evidence."""
    keys = ["condo_id", "month", "account"]
    rows = expense(spark, sf_dir).filter("ord % 13 = 1")
    totals = rows.groupBy(*keys).agg(F.sum("amount").alias("document_amount"))
    auth = F.concat_ws("-", "condo_id", F.date_format("month", "yyyy-MM"), "account")
    return rows.filter("ord % 11 <> 0").join(totals, keys).select("condo_id", "month", "code", "amount", auth.alias("auth_id"), "document_amount")


def waivers(findings: DataFrame) -> DataFrame:
    """Waivers of income and continuity findings in one of ten building-months, with the findings' own totals."""
    return findings.filter(F.col("rule").isin("R1", "R9") & ((F.col("condo_id") + month_no(F.col("month"))) % 10 == 0))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")

"""Entries whose names, accounts and categories change from month to month, and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import ledger
from tally.sources.stored import at_hand, stored

KEYS = ["condo_id", "month"]


def one_per_code(rows: DataFrame) -> DataFrame:
    """Of the rows of a code (the given lines repeat some), the one with the least amount, date, account and name.

    A code holds its invoice's number, by which expenses lie together already: grouped by both they stay where they are.
    """
    by = [c for c in ("invoice", "code") if c in rows.columns]
    first = [c for c in ("amount", "paid", "account", "name", "month") if c in rows.columns]
    rest = [c for c in rows.columns if c not in first and c not in by]
    return rows.groupBy(*by).agg(F.min(F.struct(*first, *rest)).alias("x")).select(*by, "x.*")


def pick(ord_no: Column, texts: dict[int, Column], other: Column) -> Column:
    out = other
    for k, text in texts.items():
        out = F.when(F.pmod(ord_no, F.lit(23)) == k, text).otherwise(out)
    return out


def entry_rows(expense: DataFrame) -> DataFrame:
    """Expenses with vendors written in several ways, renamed accounts and categories, and every kind of entry."""
    rows = expense.withColumn("no", ledger.month_no(F.col("month")))
    parts = F.split("description", " - ")
    noun, letters = F.upper(F.element_at(F.split(parts[0], " "), 2)), F.translate(F.substring("vendor", -4, 4), "0123456789", "ABCDEFGHIJ")
    rows = rows.withColumn("name", F.concat(noun, F.when(F.col("ord") % 19 == 0, "S ").otherwise(" "), letters))
    name, invoice = F.col("name"), F.col("invoice").cast("string")
    text = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("MANUT - "), name, F.lit(" - NF. "), invoice)).when(F.col("ord") % 7 == 0, F.concat(name, F.lit(" REF "), F.date_format(F.add_months("month", -1), "MM/yyyy"))).otherwise(F.concat(name, F.lit(" CONSERTO")))
    text = F.concat(text, F.when(F.col("inst_n").isNotNull(), F.concat(F.lit(" PARC "), F.col("inst_n"), F.lit("/7"))).otherwise(""))
    kinds = {
        0: F.concat(F.lit("INSS RETENCAO NF. "), invoice), 1: F.lit("TARIFA BANCARIA"), 2: F.concat(F.lit("CONTA DE ENERGIA TARIFA "), name), 3: F.lit("TRANSF P/ CTA APLIC"),
        4: F.lit(""), 5: F.concat(F.lit("SALARIO "), name), 6: F.concat(F.lit("FERIAS "), name), 7: F.concat(F.lit("COMPRA AMAZON "), name),
        8: F.concat(F.lit("APROP "), name, F.lit(" NF. "), invoice), 9: F.lit("PAGAMENTO DIVERSO"), 10: F.concat(F.lit("ISENCAO - RECIBO: "), invoice),
    }
    vendor = F.when((F.col("ord") % 5 == 0) | (F.pmod(F.col("ord"), F.lit(23)) == 4), None).when(F.col("no") % 3 == 0, F.concat(name, F.lit(" LTDA"))).when(F.col("no") % 3 == 1, F.concat(name, F.lit(" ME"))).otherwise(name)
    even = F.col("no") % 2 == 0
    return rows.select(
        *KEYS, "no", "ord", "code", "amount", "invoice", "inst_n", "due", "paid", "name",
        vendor.alias("vendor"), pick(F.col("ord"), kinds, text).alias("description"),
        F.when(F.col("ord") % 29 == 0, F.concat(F.lit("AVULSO "), name)).otherwise(F.concat(F.lit("DESPESAS "), "category", F.when(even, "").otherwise(" E OUTROS"))).alias("category"),
        F.concat("account", F.when(even, "").otherwise(" APLIC")).alias("account"),
    )


@stored
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_rows`` written first: a rule's pattern over an expression as long as a description's would else run it several times."""
    return entry_rows(at_hand(ledger.expense, spark, sf_dir))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_month with accounts renamed in odd months."""
    rows = at_hand(ledger.account_month, spark, sf_dir)
    return rows.withColumn("account", F.concat("account", F.when(ledger.month_no(F.col("month")) % 2 == 0, "").otherwise(" APLIC")))


def split_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``accounts`` whose fund for works is two accounts that begin alike."""
    rows = accounts(spark, sf_dir)
    works = F.col("account").startswith("FUNDO DE OBRAS")
    named = lambda half: F.concat(F.lit(f"FUNDO DE OBRAS {half}"), F.substring("account", 15, 9))
    second = rows.filter(works).withColumn("account", named("FACHADA")).withColumn("closing", (F.col("closing") - 1000).cast("decimal(18,2)"))
    return rows.withColumn("account", F.when(works, named("ELEVADOR")).otherwise(F.col("account"))).unionByName(second)


#: What the works of the fixture below are about; neighbours share two of three words.
RING = ["BOMBA", "PORTAO", "GUARITA", "TELHADO", "CISTERNA", "QUADRA", "PISCINA", "SALAO", "JARDIM"]


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expenses of a few workshops whose descriptions form chains: neighbours are alike, far ones share nothing."""
    rows = ledger.expense(spark, sf_dir).withColumn("no", ledger.month_no(F.col("month")))
    o = F.col("ord")
    word = lambda k: F.element_at(F.array(*map(F.lit, RING)), (F.pmod(o + k, F.lit(9)) + 1).cast("int"))
    kind = F.when(o % 7 == 0, "INSTALACAO ").when(o % 7 == 1, "MANUT ").otherwise("")
    about = F.when(o % 31 == 0, "").otherwise(F.concat_ws(" ", word(0), word(1), word(2)))
    ref = F.when(o % 5 < 3, F.concat(F.lit(" REF "), F.date_format(F.expr("add_months(month, -cast(ord % 4 as int))"), "MM/yyyy"))).otherwise("")
    vendor = F.concat(F.lit("OFICINA "), F.element_at(F.array(*map(F.lit, ("NORTE", "SUL", "LESTE"))), (F.col("invoice") % 3 + 1).cast("int")))
    return rows.select(*KEYS, "no", "ord", "code", "amount", "invoice", "inst_n", "due", "paid", vendor.alias("vendor"), F.concat(kind, about, ref).alias("description"), "category", "account")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per building and month: file, format and what the file covers."""
    months = ledger.months(spark, sf_dir)
    digit = F.col("condo_id") % 10
    return months.select(
        *KEYS,
        F.when((F.col("condo_id") + F.year("month")) % 9 == 0, "B").otherwise("A").alias("variant"),
        F.when((F.col("condo_id") + F.month("month")) % 11 == 0, "xlsx").otherwise("pdf").alias("suffix"),
        (digit != 3).alias("has_income"), (digit != 4).alias("has_yield"), (digit != 5).alias("has_entries"),
        F.when(digit == 3, "income lines are not in the file").alias("income_reason"),
    )


def base_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, rule, param, value) that all buildings share."""
    rows = [("R4", "min", "1000"), ("R10", "active", "false"), ("R8", "active", "true"), ("R9", "active", "true"), ("G", "active", "true")]
    pairs = F.array(*(F.struct(F.lit(a).alias("rule"), F.lit(b).alias("param"), F.lit(c).alias("value")) for a, b, c in rows))
    return ledger.condos(spark, sf_dir).select("condo_id", F.inline(pairs))


def overlay_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some buildings set otherwise or besides."""
    condos = ledger.condos(spark, sf_dir)
    own = F.array(F.struct(F.lit("R4").alias("rule"), F.lit("min").alias("param"), F.lit("5000").alias("value")), F.struct(F.lit("R10").alias("rule"), F.lit("active").alias("param"), F.lit("true").alias("value")), F.struct(F.lit("R7").alias("rule"), F.lit("months").alias("param"), F.lit("4").alias("value")))
    off = F.array(F.struct(F.lit("R9").alias("rule"), F.lit("active").alias("param"), F.lit("false").alias("value")))
    return condos.select("condo_id", F.inline(F.when(F.col("condo_id") % 4 == 0, own).when(F.col("condo_id") % 7 == 0, off)))


def withholdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes withheld: entries without a receipt of their own."""
    rows = one_per_code(ledger.expense(spark, sf_dir).filter("ord % 11 = 0 and amount > 0"))
    tax = F.when(F.col("ord") % 3 == 0, "INSS").when(F.col("ord") % 3 == 1, "ISS").otherwise("PIS")
    due = F.date_add(F.last_day("month"), F.when(F.col("ord") % 5 == 0, 5).otherwise(0))
    return rows.select(*KEYS, "ord", "code", "amount", tax.alias("tax"), F.lit("RECEITA FEDERAL").alias("vendor"), due.alias("due"), "paid", "account")


def tax_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for all withholdings of a tax and month: its list of codes is whole for some, cut short for others; some totals are off."""
    groups = withholdings(spark, sf_dir).groupBy(*KEYS, "tax").agg(F.sum("amount").alias("sum"), F.array_sort(F.collect_list("code")).alias("codes"))
    total = F.col("sum") + F.when((F.col("condo_id") + F.month("month")) % 7 == 0, 1).otherwise(0)
    listed = F.when(F.col("condo_id") % 2 == 0, F.col("codes")).otherwise(F.slice("codes", 1, 1))
    return groups.select(*KEYS, F.concat_ws("-", F.lit("T"), "condo_id", F.date_format("month", "yyyyMM"), "tax").alias("payment"), total.cast("decimal(18,2)").alias("total"), listed.alias("listed"))


def day_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for all withholdings of a day and account; some totals are off, some come twice."""
    groups = withholdings(spark, sf_dir).groupBy(*KEYS, "paid", "account").agg(F.sum("amount").alias("sum"))
    total = F.col("sum") + F.when((F.col("condo_id") + F.dayofmonth("paid")) % 5 == 0, 1).otherwise(0)
    rows = groups.withColumn("copy", F.explode(F.when(F.dayofmonth("paid") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(*KEYS, F.concat_ws("-", F.lit("P"), "condo_id", F.date_format("paid", "yyyyMMdd"), "account", "copy").alias("payment"), "paid", "account", total.cast("decimal(18,2)").alias("total"))


def fiscal_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that a month's fiscal report lists."""
    return withholdings(spark, sf_dir).filter("condo_id % 3 = 0").groupBy(*KEYS).agg(F.collect_set("amount").alias("amounts")).select(*KEYS, F.concat_ws("-", F.lit("F"), "condo_id", F.date_format("month", "yyyyMM")).alias("report"), "amounts")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read from the document of an entry; buildings 0 mod 9 have none in a month at all."""
    # what is left out comes after these in the order of a code's rows
    rows = at_hand(entries, spark, sf_dir).select(*KEYS, "no", "ord", "code", "amount", "invoice", "paid", "account", "name")
    rows = one_per_code(rows.filter("ord % 11 <> 0 and condo_id % 9 <> 0"))
    o = F.col("ord")
    money = F.translate(F.format_number(F.abs("amount"), 2), ",.", ".,")
    text = F.when(o % 17 == 0, "").when(o % 3 == 0, F.concat(F.lit("[Pagina 1]\nNOTA FISCAL "), "invoice", F.lit("\nvalor total: R$ "), money, F.lit("\nEmitente "), "name")).when(o % 3 == 1, F.concat(F.lit("[Pagina 1]\nComprovante de Pagamento\nvalor: R$ "), money, F.lit("\nEncaminhar a Nota Fiscal junto"))).otherwise(F.concat(F.lit("[Pagina 1]\nDARF Documento No. 12345 "), "condo_id", F.lit(" 678\nBeneficiario "), "name"))
    read = F.when(o % 17 == 0, None).when(o % 7 == 0, F.col("amount") + 100).otherwise(F.col("amount"))
    return rows.select(*KEYS, "code", text.alias("raw_text"), read.cast("decimal(18,2)").alias("read_amount"), (o % 3 == 2).alias("is_slip"))

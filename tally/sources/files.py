"""Views of files: their headers, the names and aliases of buildings, the text of statements, and accounts under other names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import ledger, named
from tally.sources.ledger import month_no

KEYS = ["condo_id", "month"]


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, name, nameless): some names end in a numeral, the files of some never have a name."""
    key = F.col("n_nationkey")
    rows = ledger.read(spark, sf_dir, "nation").filter(key < ledger.BUILDINGS)
    return rows.select(key.cast("int").alias("condo_id"), F.concat(F.lit("Edifício "), "n_name", F.when(key % 5 == 0, " II").otherwise("")).alias("name"), (key % 6 == 1).alias("nameless"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.read(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 3 != 0)
    return rows.select(F.col("n_nationkey").cast("int").alias("condo_id"), F.concat(F.lit("Cond. "), F.substring("n_name", 1, 4), F.lit(" X")).alias("alias"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, condo_id, text): the beginning of each month's file, with its own name, its alias, another's, part of one or none."""
    months = ledger.months(spark, sf_dir)
    own = buildings(spark, sf_dir).select("condo_id", "name")
    other = own.select(F.pmod(F.col("condo_id") - 1, F.lit(ledger.BUILDINGS)).cast("int").alias("condo_id"), F.col("name").alias("other"))
    alias = aliases(spark, sf_dir)
    rows = months.join(own, "condo_id").join(other, "condo_id").join(alias, "condo_id", "left")
    kind, short = (F.col("condo_id") + month_no(F.col("month"))) % 8, F.regexp_replace("name", " II$", "")
    text = (
        F.when(kind == 0, F.concat(F.lit("Prestação de contas - "), "name", F.lit(" saldo")))
        .when(kind == 1, F.concat(F.lit("DEMONSTRATIVO "), F.coalesce("alias", "other"), F.lit(" DESPESAS")))
        .when(kind == 2, F.concat(F.lit("Saldo de "), "other", F.lit(" receitas")))
        .when(kind == 3, F.concat(F.lit("saldo "), "name"))
        .when(kind == 4, F.lit("SALDO E DESPESAS"))
        .when(kind == 5, F.concat(F.lit("Saldo, despesas: Condomínio Outro Qualquer "), F.month("month")))
        .when(kind == 6, F.concat(F.lit("SALDO DESPESAS A"), "name", F.lit("S")))
        .otherwise(F.concat(F.lit("receitas saldo "), short))
    )
    return rows.select(F.concat_ws("-", "condo_id", F.date_format("month", "yyyyMM")).alias("file"), "condo_id", text.alias("text"))


#: What a statement calls its accounts, and what another block of it writes for them.
CANONICAL = ["ORDINARIA", "FUNDO DE RESERVA", "FUNDO DE OBRAS", "FUNDO DE OBRAS ELEVADOR", "PROVISAO P/13o.SAL. E FERIAS", "TAXA EXTRA PINTURA", "TAXA EXTRA FACHADA A", "TAXA EXTRA FACHADA B"]
WRITTEN = ["Ordinária", "FUNDO-DE-RESERVA.", "PROVISAO P/ 13o", "PINTURA EXTRA", "TAXA EXTRA PIMTURA", "FUNDO DE OBRA", "TAXA EXTRA FACHADA C", "FUNDO", "CAIXA", "PROVISAO P/13o.SALARIO E FERIAS"]


def canonical_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, month, known): each statement lacks one of the names."""
    months = ledger.months(spark, sf_dir)
    rows = months.select(*KEYS, F.posexplode(F.array(*map(F.lit, CANONICAL))).alias("at", "known"))
    return rows.filter((F.col("at") + F.col("condo_id") + month_no(F.col("month"))) % len(CANONICAL) != 0).drop("at")


def written_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = ledger.months(spark, sf_dir)
    return months.select(*KEYS, F.explode(F.array(*map(F.lit, WRITTEN))).alias("name"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, month, account, debits, debit_rest, credit_rest): what entries and receipts leave unexplained; the ordinary account
    sends, and of five accounts one, two or several fit."""
    sender = ledger.account_month(spark, sf_dir).filter("account = 'ORDINARIA'")
    k = F.col("condo_id") + month_no(F.col("month"))
    base = (100 + k % 50).cast("decimal(18,2)")
    share = lambda *tenths: F.element_at(F.array(*(F.lit(t) for t in tenths)), (k % 6 + 1).cast("int"))
    others = {"FUNDO DE RESERVA": share(10, 6, 10, 6, 10, 10), "FUNDO DE OBRAS": share(0, 4, 10, 4, 6, 10), "POUPANCA": share(0, 0, 0, 7, 4, 6), "CAIXA": share(0, 0, 0, 3, 0, 4)}
    zero = F.lit(0).cast("decimal(18,2)")
    money = lambda x: x.cast("decimal(18,2)")
    rows = [F.struct(F.lit("ORDINARIA").alias("account"), money(F.col("debits")).alias("debits"), base.alias("debit_rest"), zero.alias("credit_rest"))]
    rows += [F.struct(F.lit(a).alias("account"), zero.alias("debits"), zero.alias("debit_rest"), money(base * tenths / 10).alias("credit_rest")) for a, tenths in others.items()]
    return sender.select(*KEYS, F.inline(F.array(*rows)))


def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, month, ord, line): a statement's lines, two for an entry; some entries are missing."""
    rows = ledger.expense(spark, sf_dir).filter("ord % 13 <> 0")
    half = F.length("description") - 12
    lines = F.array(F.struct((F.col("ord") * 2).alias("ord"), F.concat(F.col("code"), F.lit("  "), F.expr("left(description, length(description) - 12)")).alias("line")), F.struct((F.col("ord") * 2 + 1).alias("ord"), F.expr("right(description, 12)").alias("line")))
    return rows.filter(half > 0).select(*KEYS, F.inline(lines))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condo_id, month, code, description, amount) that findings cite; some descriptions are misread."""
    rows = ledger.expense(spark, sf_dir).filter("ord % 5 = 0")
    text = F.when(F.col("ord") % 15 == 0, F.concat(F.lit("x"), "description")).when(F.col("ord") % 20 == 0, F.expr("substring(description, 8, 40)")).otherwise(F.col("description"))
    return rows.select(*KEYS, "code", text.alias("description"), "amount")


def cash_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are expense and receipt at once: (condo_id, month, ord, code, vendor, document, due, paid, amount, category, text, is_summary)."""
    rows = named.entries(spark, sf_dir).filter("amount > 0")
    o = F.col("ord")
    text = F.when(o % 6 == 0, "").otherwise(F.concat(F.lit("Nota fiscal "), F.when(o % 4 == 0, "ilegivel").otherwise(F.col("invoice").cast("string")), F.when(o % 503 == 0, F.concat(F.lit("\nComplemento: CHAPA "), (o % 2).cast("string"))).otherwise("")))
    document = F.when(o % 3 != 0, F.col("invoice").cast("string"))
    return rows.select(*KEYS, "ord", "code", F.upper(F.trim(F.coalesce("vendor", F.lit("")))).alias("vendor"), document.alias("document"), "due", "paid", "amount", "category", "description", text.alias("text"), (o % 37 == 0).alias("is_summary"))

"""Queries on what attachments prove."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import evidence as op
from tally.sources import ledger, named
from tally.sources.ledger import month_no
from tally.sources.stored import stored

KEYS = ["condo_id", "month"]
UTILITIES = ["ENEL DISTRIBUICAO", "Água e Esgoto - conta", "Claro", "Gás natural"]


@stored
def entries(spark, sf_dir):
    """One row for each code; a third are utilities by name or kind, with dates, amounts and codes around the description."""
    # of equal rows of a code the description comes before the category; what comes after it decides nothing here
    rows = named.one_per_code(ledger.expense(spark, sf_dir).select(*KEYS, "ord", "code", "description", "amount", "category", "account", "invoice", "paid"))
    at = (F.col("ord") % 4).cast("int")
    name = F.when(F.col("ord") % 3 == 0, F.element_at(F.array(*map(F.lit, UTILITIES)), at + 1)).otherwise("Limpeza mensal")
    text = F.concat(F.when(at == 1, "").when(at == 2, "123456 10/02/1995 ").otherwise("10/02/1995 "), name, F.when(at == 3, " 1.234,56 0013").otherwise(""))
    return rows.select(*KEYS, "ord", "code", "amount", "category", text.alias("description"), F.lit(None).cast("string").alias("vendor"))


def attachments(spark, sf_dir):
    """Eight kinds of documents, most of a page, and some that say that the original wasn't sent."""
    rows = entries(spark, sf_dir).filter("ord % 11 <> 0")
    kind, money = F.col("ord") % 8, F.translate(F.format_number(F.abs("amount"), 2), ",.", ".,")
    text = (
        F.when(kind == 0, "")
        .when(kind == 1, F.concat(F.lit("[Pagina 1]\nComprovante de Pagamento\nvalor: R$ "), money))
        .when(kind == 2, "[Pagina 1]\nComprovante de Pagamento\n[Pagina 2]\nFatura de março, consumo kWh 120")
        .when(kind == 3, "[Pagina 1]\n01/02 Comprovante de Pagamento")
        .when(kind == 4, F.repeat(F.lit("valor total da conta do cliente "), F.lit(12)))
        .when(kind == 5, "[Pagina 1]\nEXTRATO mensal 0099")
        .when(kind == 6, F.concat(F.lit("lido: R$ "), money))
        .otherwise(F.repeat(F.lit("qzx wvu "), F.lit(20)))
    )
    note = F.when(F.col("ord") % 5 == 0, "\nO original NÃO foi enviado para a administradora.").otherwise("")
    return rows.select(*KEYS, "code", F.lit(1).alias("part"), F.when(kind == 1, F.concat(text, note)).otherwise(text).alias("raw_text"))


def sized(spark, sf_dir):
    return attachments(spark, sf_dir).join(entries(spark, sf_dir).select(*KEYS, "code", "amount"), [*KEYS, "code"])


def verdicts(spark, sf_dir):
    return entries(spark, sf_dir).select(*KEYS, "code", F.when(F.col("ord") % 7 == 0, "unverifiable").otherwise("verified").alias("verdict"))


def descriptions(spark, sf_dir):
    """Distinct descriptions with what the functions make of them."""
    d = F.col("description")
    rows = entries(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n"))
    return rows.select("description", "n", op.clean_description(d).alias("clean"), op.readability(d).cast("long").alias("words"), op.is_utility(d, F.lit(None).cast("string")).alias("utility"))


def old_reading(spark, sf_dir):
    """The entries as an older reader had them: signs lost for some, a mark before the text, some texts replaced."""
    amount = F.when(F.col("ord") % 3 == 0, F.abs("amount")).otherwise(F.col("amount"))
    text = F.when(F.col("ord") % 4 == 0, "outro").otherwise(F.concat(F.lit("doc. "), "description"))
    return ledger.expense(spark, sf_dir).select(*KEYS, "ord", amount.cast("decimal(18,2)").alias("amount"), text.alias("description"))


def doc_findings(spark, sf_dir):
    kind = F.when(F.col("ord") % 6 == 0, "unverifiable").when(F.col("ord") % 6 == 1, "duplicate")
    return entries(spark, sf_dir).select(*KEYS, "code", kind.alias("type"), "amount").filter("type is not null")


def links(spark, sf_dir):
    """Attachments that are all links in some months, partly in others."""
    is_link = (F.col("condo_id") % 5 == 0) | ((F.col("condo_id") % 5 == 1) & (F.col("ord") % 2 == 0))
    return entries(spark, sf_dir).select(*KEYS, F.when(is_link, F.concat(F.lit("HTTPS://x/"), "code")).otherwise("[Pagina 1]\ntexto").alias("raw_text"))


def category_findings(spark, sf_dir):
    """Missing documents, and new categories of the same entries: equal, a cent off or two."""
    rows = entries(spark, sf_dir).filter("ord % 11 = 0")
    hosts = rows.select(*KEYS, F.concat(F.lit("a"), "code").alias("id"), F.lit("missing_evidence").alias("type"), "category", "amount", F.lit(1).alias("entries"), F.when(F.col("ord") % 5 == 0, "informative").otherwise("open").alias("state"), F.lit("Sem comprovante.").alias("body"))
    off = F.when(F.col("ord") % 8 == 0, F.lit("0.02")).when(F.col("ord") % 4 == 0, F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(4,2)")
    new = rows.filter("ord % 2 = 0").select(*KEYS, F.concat(F.lit("b"), "code").alias("id"), F.lit("new_category").alias("type"), F.lower("category").alias("category"), (F.col("amount") + off).cast("decimal(18,2)").alias("amount"), F.when(F.col("ord") % 3 == 0, 2).otherwise(1).alias("entries"), F.lit("open").alias("state"), F.lit("Subconta nova.").alias("body"))
    return hosts.unionByName(new)


def profiles(spark, sf_dir):
    checks = F.array(*(F.struct(F.lit(f).alias("format"), F.lit(c).alias("check"), F.lit(a).alias("applied")) for f, c, a in (("pdf", "duplicate", True), ("pdf", "unverifiable", True), ("xlsx", "duplicate", True), ("xlsx", "unverifiable", False))))
    return named.statements(spark, sf_dir).select(F.inline(checks)).distinct()


def overrides(spark, sf_dir):
    own = F.array(F.struct(F.lit("duplicate").alias("check"), F.lit(False).alias("applied")))
    return named.statements(spark, sf_dir).filter("condo_id % 4 = 0").select("condo_id").distinct().select("condo_id", F.inline(own))


def verification(spark, sf_dir):
    return op.verification_list(named.statements(spark, sf_dir), profiles(spark, sf_dir), overrides(spark, sf_dir))


def queries(on, plain) -> dict:
    return {
        "f38_clean_descriptions": on(lambda rows: rows, descriptions),
        "f32_attachment_states": on(op.attachment_states, sized),
        "a14_documents_not_sent": on(op.documents_not_sent, entries, attachments, verdicts),
        "a15_utility_bills": on(op.utility_bills_missing, entries, attachments, verdicts),
        "j18_lost_signs": on(op.lost_signs, ledger.expense, old_reading),
        "u5_link_only": on(op.without_link_noise, doc_findings, links),
        "p7_new_categories_told": on(op.new_categories_told, category_findings),
        "u6_verification_list": on(lambda rows: rows, verification),
        "u4_under_profile": on(op.under_profile, doc_findings, verification),
    }

"""What attachments prove: utility bills, documents not sent, links, lost signs, and new categories told within other findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import documents
from tally.functions.text import norm_text, strip_accents
from tally.operators.rules import KEYS

# fixed values: words and patterns of documents
COMMON_WORDS = r"(?i)\b(?:de|da|do|das|dos|para|valor|total|data|nota|fiscal|cnpj|cpf|cliente|pagamento|documento|servi[cç]os?|banco|conta|vencimento|numero|n[uú]mero|descri[cç][aã]o|empresa|endere[cç]o)\b"
UTILITY_NAMES = r"\b(?:ENEL|ELETROPAULO|SABESP|COMGAS|NATURGY|VIVO|CLARO|TELEFONICA|NET|TIM|CPFL|ENERGISA)\b"
UTILITY_KINDS = r"^\s*(?:[0-9]{2}/[0-9]{2}/[0-9]{4}\s+)?(?:ENERGIA\s+ELETRICA|AGUA\s*(?:E|/)\s*ESGOTO|GAS)\s*-\s"
BILL = r"\bFATURA\b|NOTA\s+FISCAL|CONTA\s+DE\s+(?:ENERGIA|AGUA|GAS|TELEFONE|LUZ)|\bLEITURA\b|NUMERO\s+DA\s+INSTALA|CODIGO\s+(?:DO\s+CLIENTE|DE\s+INSTALA)|NUMERO\s+DO\s+CLIENTE|CONSUMO\s+(?:EM|FATURADO|MEDIDO|KWH|M3)|HISTORICO\s+DE\s+CONSUMO|DEMONSTRATIVO\s+DE\s+CONSUMO|TOTAL\s+(?:A\s+PAGAR|DA\s+FATURA)|VALOR\s+DA\s+FATURA"
EXTRACT = r"(?i)Rela[cç][aã]o\s+de\s+Lan[cç]amentos|EXTRATO"
PAGE_COUNT = r"(?<![0-9/.,])0?([0-9]{1,2})/0?([0-9]{1,2})(?![0-9/.,])"
NOT_SENT = "não foi enviado para a administradora"
HOSTS = ["missing_evidence", "invoice_missing", "divergent_amount", "unverifiable"]
READABLE = 8


def readability(text: Column) -> Column:
    """how many common words of documents a text holds; READABLE or more make it legible."""
    return F.regexp_count(text, F.lit(COMMON_WORDS))


def clean_description(text: Column) -> Column:
    """without a number of six digits or more and a date in front, and without amounts and a code behind."""
    front = F.regexp_replace(text, r"^(?:[0-9]{6,}\s+)?[0-9]{2}/[0-9]{2}/[0-9]{4}\s+", "")
    return F.trim(F.regexp_replace(front, r"(?:\s+[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})+(?:\s+[0-9]{1,5})?\s*$", ""))


def is_utility(description: Column, vendor: Column) -> Column:
    """F32: a utility by its name in description or vendor, or by the kind that the description begins with."""
    plain = lambda c: F.upper(strip_accents(F.coalesce(c, F.lit(""))))
    return F.rlike(F.concat_ws(" ", plain(description), plain(vendor)), F.lit(UTILITY_NAMES)) | F.rlike(plain(description), F.lit(UTILITY_KINDS))


def page_state(text: Column, amount: Column) -> Column:
    """F32: what one page is: "bill", "unknown" or, deciding nothing, "payment"."""
    legible, size = readability(text) >= READABLE, F.length(text)
    return (
        F.when(F.length(F.trim(text)) < 10, "unknown")
        .when(F.upper(strip_accents(text)).rlike(BILL), "bill")
        .when((size >= 1800) & legible, "bill")
        .when(documents.is_payment_page(text) | text.rlike(EXTRACT) | documents.is_bank_slip(text), "payment")
        .when((size >= 300) & legible, "bill")
        .when(((size < 60) & documents.amount_in_text(text, amount)) | ((size >= 60) & legible), "payment")
        .otherwise("unknown")
    )


def declared_pages(text: Column) -> Column:
    """The largest number of pages that counters such as 01/02 in a text declare, 0 without one."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAGE_COUNT), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(PAGE_COUNT), F.lit(2)).alias("b"))
    totals = F.transform(pairs, lambda p: F.when(p["a"].cast("int").between(1, p["b"].cast("int")) & (p["b"].cast("int") <= 30), p["b"].cast("int")).otherwise(0))
    return F.coalesce(F.array_max(totals), F.lit(0))


def attachment_states(attachments: DataFrame) -> DataFrame:
    """F32: for each code with attachments (code, part, raw_text, amount): bill, payment_only or unknown.

    The first page that decides does so; where counters declare more pages than were read, the state is unknown. A null text
    is an empty one; a text without page marks is one page.
    """
    text = F.coalesce("raw_text", F.lit(""))
    parts = F.split(text, r"\[P[aá]gina [0-9]+\]\n?")
    pages = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    rows = attachments.select(*KEYS, "code", "part", "amount", declared_pages(text).alias("declared"), F.size(pages).alias("read"), F.posexplode(pages).alias("page", "page_text"))
    states = rows.withColumn("state", page_state(F.col("page_text"), F.col("amount")))
    first = F.min(F.when(F.col("state") != "payment", F.struct("part", "page", "state")))["state"]
    whole = states.groupBy(*KEYS, "code").agg(F.max("declared").alias("declared"), F.sum(F.when(F.col("page") == 0, F.col("read"))).alias("read"), first.alias("first"))
    return whole.select(*KEYS, "code", F.when(F.col("declared") > F.col("read"), "unknown").otherwise(F.coalesce("first", F.lit("payment_only"))).alias("state"))


def not_sent(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(NOT_SENT)), F.lit(False))


def with_totals(items: DataFrame) -> DataFrame:
    """The items of one finding for each building and month, with its number of items and total."""
    sums = items.groupBy(*KEYS).agg(F.count("*").alias("items"), F.sum("amount").alias("total"))
    return items.join(sums, KEYS)


def documents_not_sent(entries: DataFrame, attachments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified entries whose attachment says that the original wasn't sent, where a building and month has two or more: the
    items of one finding that replaces theirs."""
    said = attachments.filter(not_sent(F.col("raw_text"))).select(*KEYS, "code")
    verified = verdicts.filter("verdict = 'verified'").select(*KEYS, "code")
    items = entries.join(verified, [*KEYS, "code"], "left_semi").join(said, [*KEYS, "code"], "left_semi")
    return with_totals(items.select(*KEYS, "code", clean_description(F.col("description")).alias("description"), "amount")).filter("items >= 2")


def utility_bills_missing(entries: DataFrame, attachments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Utilities whose attachments only show a payment: the items of one finding for each building and month.

    Entries with an open finding on their document are left out, and so are those whose document wasn't sent where A14 has a
    finding for the month.
    """
    utilities = entries.filter(is_utility(F.col("description"), F.col("vendor")))
    paid = attachment_states(attachments.join(utilities.select(*KEYS, "code", "amount"), [*KEYS, "code"])).filter("state = 'payment_only'")
    told = verdicts.filter(F.col("verdict").isin("unverifiable", "missing_evidence", "divergent_amount")).select(*KEYS, "code")
    merged = documents_not_sent(entries, attachments, verdicts).select(*KEYS).distinct()
    withheld = attachments.filter(not_sent(F.col("raw_text"))).join(merged, KEYS, "left_semi").select(*KEYS, "code")
    left = utilities.join(paid, [*KEYS, "code"], "left_semi").join(told.unionByName(withheld), [*KEYS, "code"], "left_anti")
    return with_totals(left.select(*KEYS, "code", F.substring(clean_description(F.col("description")), 1, 60).alias("description"), "amount"))


def lost_signs(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Negative entries that the evidence holds as positive: equal to the cent, with the first 20 letters and digits of the
    entry's description in the evidence's; of several such rows the first (``ord``) counts."""
    key = lambda c: F.regexp_replace(F.lower(c), r"\W+", "")
    negative = entries.filter("amount < 0").select(*KEYS, "code", "amount", F.substring(key(F.col("description")), 1, 20).alias("start"), F.abs("amount").alias("size")).filter("start <> ''").distinct()
    there = evidence.select(*KEYS, F.abs("amount").alias("size"), F.col("amount").alias("shown"), F.col("ord"), key(F.col("description")).alias("text"))
    pairs = negative.join(there, [*KEYS, "size"]).filter(F.contains("text", "start"))
    first = pairs.groupBy(*KEYS, "code", "amount").agg(F.min(F.struct("ord", "shown"))["shown"].alias("shown"))
    return first.filter("shown > 0")


def without_link_noise(findings: DataFrame, attachments: DataFrame) -> DataFrame:
    """Findings without the "unverifiable" ones of months whose attachments are all links."""
    links = attachments.groupBy(*KEYS).agg(F.bool_and(F.startswith(F.lower(F.coalesce("raw_text", F.lit(""))), F.lit("http"))).alias("links"))
    marked = findings.join(links.filter("links"), KEYS, "left")
    return marked.filter(~((F.col("type") == "unverifiable") & F.coalesce("links", F.lit(False)))).drop("links")


def new_categories_told(findings: DataFrame) -> DataFrame:
    """Findings (id, type, category, amount, entries, state, body) in which an open new category of a single entry becomes
    informative where another open finding has the same entry (amount to the cent, category); that one's text then says so.

    Of several hosts the first id is taken.
    """
    category = F.regexp_replace(norm_text(F.coalesce("category", F.lit(""))), " ", "")
    rows, cents = findings.withColumn("same", category), F.round(F.col("amount") * 100).cast("long")
    still = rows.filter("state = 'open'")
    single = still.filter("type = 'new_category' and entries = 1").select(*KEYS, "same", F.col("id").alias("source"), F.col("category").alias("named"), F.explode(F.array(cents - 1, cents, cents + 1)).alias("cents"))
    hosts = still.filter(F.col("type").isin(HOSTS)).select(*KEYS, "same", "id", cents.alias("cents"))
    chosen = single.join(hosts, [*KEYS, "same", "cents"]).groupBy(*KEYS, "source").agg(F.min("id").alias("id"), F.min("named").alias("named"))
    notes = chosen.groupBy(*KEYS, "id").agg(F.count("*").alias("n"), F.min("named").alias("named"))
    told = rows.join(chosen.select(*KEYS, F.col("source").alias("id"), F.lit(True).alias("told")), [*KEYS, "id"], "left").join(notes, [*KEYS, "id"], "left")
    body = F.when(F.col("n").isNotNull(), F.concat("body", F.lit(" Também em subconta nova: "), "named", F.lit("."))).otherwise(F.col("body"))
    return told.select(*KEYS, "id", "type", "amount", F.when(F.col("told"), "informative").otherwise(F.col("state")).alias("state"), body.alias("body"))


def verification_list(statements: DataFrame, profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Which checks apply to a statement: those of its format (format, check, applied), which a building may set otherwise."""
    rows = statements.join(profiles, statements["suffix"] == profiles["format"]).select(*KEYS, "check", "applied")
    own = overrides.select("condo_id", "check", F.col("applied").alias("own"))
    return rows.join(own, ["condo_id", "check"], "left").select(*KEYS, "check", F.coalesce("own", "applied").alias("applied"))


def under_profile(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """U4: the findings of checks that apply to their statement."""
    return findings.join(checks.filter("applied").select(*KEYS, F.col("check").alias("type")), [*KEYS, "type"], "left_semi")

"""What the text of an attached document says: amounts, invoices, slips, payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.text import norm_text, says

# fixed values: patterns of documents
PAYMENT_PAGE = r"(?i)Comprovante\s+de\s+(?:Pagamento|Transfer|Opera[cç]|Dep[oó]sito|Agendamento|Liquida)|Dados\s+do\s+(?:Lan[cç]amento|Pagamento)|Comprovante\s+PIX|Pagamento\s+realizado|Valor\s+(?:do\s+)?lan\S*to|Conta\s+de\s+d[eé]bito|Data\s+d[ao]\s+(?:pagamento|transfer)"
AUTHENTICATION, MECHANICAL = r"(?i)Autentica[cç][aã]o", r"(?i)Autentica[cç][aã]o\s+mec[aâ]nica"
INVOICE_MARKER = r"(?i)NOTA\s+FISCAL|NOTA\s+FATURA|NFS-?E|DANF[A-Z]?|NF-?E\b|CHAVE\s+DE\s+ACESSO|Identifica\S*\s+do\s+Emitente|Documento\s+Auxiliar|NOTA\s+DE\s+REEMBOLSO|C[oó]digo\s+de\s+Verifica\S*o|C[aá]lculo\s+do\s+ISS|VALOR\s+TOTAL\s+DOS\s+SERVI|TOMADOR\s+D[EO]\s+SERVI|PRESTADOR\s+D[EO]\s+SERVI"
FALSE_MARKER = r"(?i)PRESTADORES\s+PESSOA[\s\S]{0,2500}|prestador\s+de\s+servi[cç]o\s+(?:n[aã]o|deve)[^\n]{0,200}|NF-?e\s+n[aã]o\s+\w+|encaminhar[^.;\n]{0,100}Nota\s+Fiscal[^.;\n]{0,120}|Nota\s+Fiscal[^.;\n]{0,40}Solicita[cç][aã]o\s+de\s+Pagamento[^\n]{0,80}|NF\s+ser[aá]\s+emitida[^\n]{0,60}"
BANK_SLIP = r"(?i)Benefici[aá]rio|Linha\s+Digit|Recibo\s+do\s+Pagador|Sacador|Ficha\s+de\s+Compensa"
SLIP_IDS = [r"(?i)Recibo\s*Declara.{0,4}:?\s*([0-9]{5,})", r"(?i)N[uú]mero\s+do\s+Documento:?\s*([0-9]{2}[0-9.\-\s]{10,24}[0-9])", r"(?i)Documento No\.?\s*([0-9\s]{8,20}[0-9])"]
TOTALS = [r"(?i)valor\s+total:?\s*R?\$?\s*([0-9.]+,[0-9]{2})", r"(?i)valor\s+do\s+pagamento:?\s*R?\$?\s*([0-9.]+,[0-9]{2})", r"(?i)\bvalor:?\s*R\$\s*([0-9.]+,[0-9]{2})"]
CODES = r"(?i)identifica[çc][ãa]o\s+(?:no\s+extrato|do\s+comprovante)\s*:?\s*((?:D[0-9]{3,6}\b[^0-9D\n]{0,30}){1,15})"

# fixed values: words of which one stands in whatever the pattern finds
PAYMENT_WORDS, SLIP_WORDS = ["comprovante", "dados", "realizado", "lan", "bito", "data"], ["benefici", "linha", "recibo", "sacador", "ficha"]
INVOICE_WORDS, FALSE_WORDS = ["nota", "nf", "chave", "identifica", "auxiliar", "verifica", "iss", "servi"], ["prestador", "nf", "encaminhar", "solicita"]
SLIP_ID_WORDS = ["recibo", "mero", "documento no"]

RECEIPT = r"\[RECIBO OCR pag\. [0-9]+\]\n"
RECEIPT_ID = r"(?i)Identifica\S*\s+no\s+extrato\s+(.+)"
RECEIPT_AUTH = r"(?i)autentica\S*\s*:?\s*([A-Za-z0-9]{12,})"
COVER = r"(?s)Destina-se a:[^\n]*\n(.*?)\n\s*Valor Emitido"


def first_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def amount_in_text(text: Column, amount: Column) -> Column:
    """whether an amount stands in a text in the Brazilian format, with or without separators, not inside a longer number."""
    whole = F.translate(F.format_number(F.floor(F.abs(amount)), 0), ",", "#")
    cents = F.lpad((F.round(F.abs(amount) * 100) % 100).cast("int").cast("string"), 2, "0")
    short = F.when(cents.endswith("0") & (cents != "00"), F.concat(F.lit("(?:"), cents, F.lit("|"), F.substring(cents, 1, 1), F.lit(")"))).otherwise(cents)
    # most texts lack the last digits in front of the comma, or hold the amount as it is printed; the others take the pattern
    printed = F.concat(F.translate(whole, "#", "."), F.lit(","), cents)
    at = F.instr(text, printed)
    alone = (at > 0) & ((at == 1) | ~F.substring(text, at - 1, F.lit(1)).rlike("[0-9.,]")) & ~F.substring(text, at + F.length(printed), F.lit(1)).rlike("[0-9]")
    pattern = F.concat(F.lit(r"(?:^|[^0-9.,]|[^0-9][.,])"), F.replace(whole, F.lit("#"), F.lit(r"[.,\s]?")), F.lit(r"\s?[,.]\s?"), short, F.lit(r"(?:[^0-9]|$)"))
    return F.coalesce((amount > 0) & F.contains(text, F.substring_index(whole, "#", -1)) & (alone | F.rlike(text, pattern)), F.lit(False))


def is_payment_page(text: Column) -> Column:
    """a payment's words; an authentication counts unless it is only the slip's place for a mechanical one."""
    return (says(text, *PAYMENT_WORDS) & text.rlike(PAYMENT_PAGE)) | (says(text, "autentica") & F.regexp_replace(text, MECHANICAL, " ").rlike(AUTHENTICATION))


def is_bank_slip(text: Column) -> Column:
    return says(text, *SLIP_WORDS) & text.rlike(BANK_SLIP)


def has_invoice_marker(text: Column) -> Column:
    """an invoice's words outside phrases that only speak of one."""
    said = F.when(says(text, *FALSE_WORDS), F.regexp_replace(text, FALSE_MARKER, " ")).otherwise(text)
    return says(text, *INVOICE_WORDS) & said.rlike(INVOICE_MARKER)


def invoice_in_page(page: Column, number: Column) -> Column:
    """the number in a page that is neither payment nor slip, lines that repeat the listing left out; zeros in front and a
    dot before the last three digits are allowed."""
    bare = F.regexp_replace(number.cast("string"), "^0+(?=.)", "")
    body = F.when(F.length(bare) >= 4, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 3), F.lit(r"[.\s]?"), F.substring(bare, F.length(bare) - 2, F.lit(3)))).otherwise(bare)
    lines = F.filter(F.split(page, "\n"), lambda x: ~x.rlike(r"(?i)\bN\.?F\.?S?\.?-?E?\.?:?\s*[0-9]{2,}"))
    return F.coalesce(~is_payment_page(page) & ~is_bank_slip(page) & F.rlike(F.array_join(lines, "\n"), F.concat(F.lit("(?:^|[^0-9])0*"), body, F.lit("(?:[^0-9]|$)"))), F.lit(False))


def slip_id(text: Column) -> Column:
    """the number of a tax slip, without spaces."""
    found = [F.when(says(text, word), first_of(text, [p])) for p, word in zip(SLIP_IDS, SLIP_ID_WORDS)]
    return F.regexp_replace(F.coalesce(*found), r"\s+", "")


def total_paid(text: Column) -> Column:
    """the total that a payment states, by the first pattern that finds one."""
    return F.translate(F.replace(first_of(text, TOTALS), F.lit("."), F.lit("")), ",", ".").try_cast("decimal(18,2)")


def listed_codes(text: Column) -> Column:
    """the codes that a payment lists."""
    return F.regexp_extract_all(F.coalesce(F.regexp_extract(text, CODES, 1), F.lit("")), F.lit("D([0-9]{3,6})"), F.lit(1))


def record_key(page: Column, code: Column) -> Column:
    """F29."""
    return F.concat(F.lit("pag"), page, F.when(code.isNotNull(), F.concat(F.lit("_cod"), code)).otherwise(""))


def receipt_signature(text: Column) -> Column:
    """struct(ident, auth) of a receipt that was read from its image, either of them null where it isn't told; null without any."""
    body = F.when(text.rlike(RECEIPT), F.element_at(F.split(text, RECEIPT, 2), 2))
    ident = F.upper(F.trim(F.regexp_replace(first_of(body, [RECEIPT_ID]), r"\s+", " ")))
    auth = F.upper(first_of(body, [RECEIPT_AUTH]))
    return F.when(ident.isNotNull() | auth.isNotNull(), F.struct(ident.alias("ident"), auth.alias("auth")))


def cover_complement(text: Column) -> Column:
    """what a cover says between purpose and amount, without amounts; empty without such a part."""
    part = F.coalesce(F.regexp_extract(text, COVER, 1), F.lit(""))
    return norm_text(F.regexp_replace(part, r"(?<![0-9.,])[0-9.]+,[0-9]{2}(?![0-9])", " "))


def pages_of(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row for each "[Pagina N]" part of ``text``: page and page_text."""
    parts = F.slice(F.split(F.col(text), r"\[P[aá]gina "), 2, 100_000)
    # worked out before the rows part: a filter on the text would else do so for each of its words
    page = lambda p: F.struct(F.regexp_extract(p, r"^([0-9]+)\]", 1).cast("int").alias("page"), F.regexp_replace(p, r"^[0-9]+\]\n", "").alias("page_text"))
    return rows.select("*", F.inline(F.transform(parts, page)))

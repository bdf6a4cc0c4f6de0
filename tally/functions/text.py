"""Scalar text functions of the ledger, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented Latin letters and their plain forms
ACCENTED = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def strip_accents(text: Column) -> Column:
    # a text of single bytes has none
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, ACCENTED, PLAIN))


def says(text: Column, *words: str) -> Column:
    """Whether one of the words (lower case, without accents) stands in the text, whatever its case: what a pattern can't match without,
    asked before it."""
    return reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in words))


def norm_text(text: Column) -> Column:
    """Upper case without accents; letters and digits with single spaces."""
    # one class: a pattern of alternatives takes several times as long
    return F.trim(F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]+", " "))


def account_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]", "")


def invoice_no(description: Column) -> Column:
    """The number after NF, NFS or NFSe; null without one."""
    number = F.regexp_extract(F.upper(description), r"\bNF(?:S|SE|S-E)?[ .:]*([0-9]+)", 1)
    return F.nullif(F.when(says(description, "nf"), number), F.lit(""))


def installment(description: Column) -> Column:
    """struct(n, total) of "PARC n/total" where 1 <= n <= total <= 99, else null."""
    pattern = r"\b(?:PARCELA|PARC|PC)\.? *([0-9]{1,2})/([0-9]{1,2})"
    n, total = (F.regexp_extract(F.upper(description), pattern, i).try_cast("int") for i in (1, 2))
    # most texts have no slash or no such word and need no pattern
    return F.when(F.contains(description, F.lit("/")) & says(description, "parc", "pc"), F.when((n >= 1) & (n <= total), F.struct(n.alias("n"), total.alias("total"))))


def base_description(description: Column) -> Column:
    """The description without installment, invoice number and other numbers."""
    cut = F.regexp_replace(F.upper(description), r"\b(?:PARCELA|PARC|PC)\.? *[0-9]{1,2}/[0-9]{1,2}", " ")
    cut = F.regexp_replace(cut, r"\bNF(?:S|SE|S-E)?[ .:]*[0-9]+", " ")
    return norm_text(F.regexp_replace(cut, "[0-9]+", " "))


def parse_brl(text: Column) -> Column:
    """Money in the Brazilian format as a decimal: brackets or a minus at either end mean negative; null if it isn't money."""
    bare = F.regexp_replace(text, r"[R$\s()-]", "")
    number = F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    value = number.try_cast("decimal(18,2)")
    return F.when(text.rlike(r"^\s*(?:R\$)?\s*\(.*\)\s*$|^\s*(?:R\$\s*)?-|-\s*$"), -value).otherwise(value)


def format_brl(value: Column) -> Column:
    """R$ 1.234,56, with a minus in front."""
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("R$ "), F.translate(F.format_number(F.abs(value), 2), ",.", ".,"))

"""Who and what a ledger entry stands for: vendor keys, equal accounts and categories, kinds of entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.functions.text import account_key, norm_text, strip_accents

# fixed values: words of a vendor's name that say nothing about who it is
NOISE = "DEB CC C REF NF NFE NFS NFSE INST COD FORNECIMENTO PARC PARCELA PC DE DA DO DAS DOS E A O PGTO PAGTO PAGAMENTO REFERENTE PROPORCIONAL SERV SERVICO SERVICOS JAN FEV MAR ABR MAI JUN JUL AGO SET OUT NOV DEZ JANEIRO FEVEREIRO MARCO ABRIL MAIO JUNHO JULHO AGOSTO SETEMBRO OUTUBRO NOVEMBRO DEZEMBRO LTDA ME EPP SA S FORN FORNEC AUT NFTS MES ANO KWH M3 FNC RECIBO".split()
# fixed values: words that many vendors' entries share
GENERIC = "MANUTENCAO MANUT ASSESSORIA ADMINISTRACAO CONSULTORIA LOCACAO COMPRA MATERIAIS MATERIAL EQUIPAMENTOS EQUIPAMENTO SEGURANCA ELEVADORES ELEVADOR LIMPEZA PORTARIA CONDOMINIO PREDIAL TECNOLOGIA ENGENHARIA PRODUTOS SERVICOS TRANSPORTE REFEICAO ALIMENTACAO GINASTICA JARDINAGEM PROJETO INSTALACAO REPARO REPAROS HONORARIOS ADVOCATICIOS JURIDICO JURIDICOS CUSTAS REEMBOLSAVEIS ADIANTAMENTO".split()
# fixed values: months as the entries abbreviate them
MONTHS = "JAN FEV MAR ABR MAI JUN JUL AGO SET OUT NOV DEZ".split()
# fixed values: patterns over upper-case text without accents
NATURE = "^(INSTALA|IMPLANTA|MANUT|LOCA|REPAR|CONSERT|REFORM|TROCA|PROJETO|COMPRA|MATERIA|ADIANT|OBRA|CONTRAT|SUBSTITUI)"
COMPETENCE = r"\b(?:(JAN|FEV|MAR|ABR|MAI|JUN|JUL|AGO|SET|OUT|NOV|DEZ)[A-Z]*\.?\s*[/.\-]\s*([0-9]{4}|[0-9]{2})|(0?[1-9]|1[0-2])\s*/\s*(20[0-9]{2}))\b"
UTILITY = r"\b(SABESP|ENEL|COMGAS|CPFL|ELETROPAULO|EDP|LIGHT|NATURGY|VIVO|CLARO|TIM|OI|NET|SUPERGASBRAS|ULTRAGAZ)\b"
KINDS = {
    "structural_negative": r"APLICACAO|RESGATE|\bIOF\b|IR\s*/\s*IOF|\bIR\s+INVESTIMENTO",
    "adjustment": "CORRECAO|AJUSTE|ESTORNO|DEVOLUCAO",
    "unidentified": r"\bNAO\s+IDENTIF|\bSEM\s+IDENTIFICA|\bA\s+IDENTIFICAR\b|\bDESCONHECID|\bDEBITO\s+(?:/\s*)?CREDITO\s+NAO|\bPAGAMENTO\s+DIVERSO|\bSEM\s+HISTORICO",
    "withholding": r"^\s*(?:INSS|ISS|IRRF?|PIS|COFINS|CSLL|IR\b)|RETENCAO|CSLL\s*/\s*COFINS\s*/\s*PIS",
    "generic_payee": "^(RECEITA FEDERAL|SECRETARIA DA RECEITA( FEDERAL)?|PREVIDENCIA SOCIAL|INSS|FGTS|IRRF|DARF|GPS|MUNICIPIO DE SAO PAULO|PREFEITURA( MUNICIPAL)?( DE SAO PAULO)?|CAIXA ECONOMICA FEDERAL|ISS|ISSQN)$",
    "marketplace": r"MERCADO\s*PAGO|MERCADO\s*LIVRE|MERCADOLIVRE|AMAZON|MAGAZINE\s*LUIZA|MAGALU|SHOPEE|ALIEXPRESS|KABUM|AMERICANAS|SHEIN|CASAS\s*BAHIA|PONTO\s*FRIO|SUBMARINO|PAGSEGURO|PAGSEG\b|PAYPAL|\bPICPAY\b",
    "variable_utility": r"\b(?:ENEL|ELETROPAULO|SABESP|COMGAS|NATURGY|VIVO|CLARO|TELEFONICA|NET|TIM|CPFL|ENERGISA|SUPERGASBRAS|ULTRAGAZ)\b|ENERGIA\s+ELETRICA|AGUA\s*(?:E|/)\s*ESGOTO|FATURA\s+(?:DO\s+)?CARTAO|CARTAO\s+DE\s+CREDITO",
    "payroll": r"^\s*(?:[0-9]+\s*[O]?\s*)?(?:FOLHA\s+DE\s+PAGAMENTO|SALARIO|PRO[\s-]*LABORE|ADIANTAMENTO\s+SALARIAL|VALE\s+TRANSPORTE)\b",
    "eventual": r"FERIAS|13\s*[O]?\s*(?:SAL|PROP)|DECIMO|RESCIS|I\.?\s?P\.?\s?T\.?\s?U|ADIANTAMENTO|ISENCAO|\bCUSTAS\b|\bAPROP\b",
}
#: Words (upper case, plain) without one of which no text is of the kind: asked before its pattern.
NEEDED = {"unidentified": ("IDENTIF", "DESCONHECID", "CREDITO", "DIVERSO", "HISTORICO")}
BANK_FEE = r"\bTAR(?:IFAS?)?\b"
UTILITY_WORDS = r"ENERGIA|ELETRIC|\bAGUA\b|ESGOTO|\bGAS\b|TELEFON|SABESP|COMGAS|\bENEL\b|\bVIVO\b|\bCLARO\b|\bTIM\b|INTERNET"
QUOTA_WAIVER = r"\bISENCAO\s*-?\s*RECIBO"
BANK_CHARGE = r"\bI\.?\s?R\.?\s?S?\s?/\s?RESGATE|\bIR\s+S/\s*RESGATE|\bIOF\b|JUROS\s+S/\s*SALDO\s+DEVEDOR"
TAX = r"^\s*(INSS|PCC|ISS|IRRF|PIS|COFINS|CSLL|CSRF)\b"


def plain_upper(text: Column) -> Column:
    return F.upper(strip_accents(F.coalesce(text, F.lit(""))))


def is_kind(text: Column, kind: str) -> Column:
    """whether a text is of one of KINDS."""
    plain = plain_upper(text)
    matches = plain.rlike(KINDS[kind])
    return reduce(Column.__or__, map(plain.contains, NEEDED[kind])) & matches if kind in NEEDED else matches


def structural_negative(description: Column) -> Column:
    """movements of investments, unless the text speaks of an adjustment."""
    return is_kind(description, "structural_negative") & ~is_kind(description, "adjustment")


def structural(category: Column, description: Column) -> Column:
    """transfers, redemptions and withholdings."""
    plain = plain_upper(category)
    named = (plain.contains("TRANSFERENCIA") | plain.contains("APLICACAO")) & norm_text(category).rlike("^(TRANSFERENCIA|APLICACAO RESGATE)")
    return F.coalesce(named, F.lit(False)) | is_kind(description, "withholding")


def terms(text: Column) -> Column:
    """The words of a name without digits, noise and single letters."""
    return F.filter(F.split(plain_upper(text), "[^A-Z]+"), lambda t: (F.length(t) > 1) & ~t.isin(*NOISE))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vendor_key2(vendor: Column, description: Column) -> Column:
    """the first two terms of the vendor, else of the description's second, last, first or another part."""
    none = F.array().cast("array<string>")

    def ordered(parts: Column) -> Column:
        inner = F.when(F.size(parts) > 3, F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(1)))).otherwise(none)
        return F.when(F.size(parts) >= 3, F.concat(F.array(F.get(parts, F.lit(1)), F.element_at(parts, -1), F.get(parts, F.lit(0))), inner)).otherwise(parts)

    def first_two(texts: Column) -> Column:
        named = F.filter(F.transform(texts, terms), lambda t: F.size(t) > 0)
        return F.array_join(F.slice(F.get(named, F.lit(0)), 1, 2), " ")

    # the description is looked at only where the vendor says nothing
    parts = bound(F.filter(F.split(F.coalesce(description, F.lit("")), r"\s+-\s+"), lambda p: F.trim(p) != ""), ordered)
    return F.coalesce(first_two(F.array(F.coalesce(vendor, F.lit("")))), first_two(F.coalesce(parts, none)), norm_text(F.coalesce(description, F.lit(""))))


def vendor_label(text: Column, key: Column) -> Column:
    """the utility that a text names, else its part before the invoice number if that holds the key and is short, else the key."""
    utility = F.nullif(F.regexp_extract(plain_upper(text), UTILITY, 1), F.lit(""))
    name = F.trim(F.regexp_extract(text, r"^(.*?)(?:\s+-\s+NF|\s+NF\.?\s*[0-9]|$)", 1))
    fits = (name != "") & norm_text(name).contains(norm_text(key)) & (F.length(name) <= 60)
    return F.coalesce(utility, F.when(fits, name), key)


def competence(description: Column) -> Column:
    """the month that a description names, as its first day."""
    text = plain_upper(description)
    part = lambda i: F.nullif(F.regexp_extract(text, COMPETENCE, i), F.lit(""))
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(1)), F.lit(0)).cast("int"), part(3).cast("int"))
    year = F.coalesce(part(2), part(4)).cast("int")
    return F.make_date(F.when(year < 100, year + 2000).otherwise(year), month, F.lit(1))


def same_account(a: Column, b: Column) -> Column:
    """equal keys, or one of 8 letters or more that the other begins with."""
    ka, kb = account_key(a), account_key(b)
    return (ka != "") & (kb != "") & ((ka == kb) | ((F.least(F.length(ka), F.length(kb)) >= 8) & (F.startswith(ka, kb) | F.startswith(kb, ka))))


def same_category(a: Column, b: Column) -> Column:
    """equal names; or one of 8 letters or more that the other begins with; or of 7, followed by a space."""
    na, nb = norm_text(a), norm_text(b)
    short, long = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    return (na == nb) | ((F.length(short) >= 8) & F.startswith(long, short)) | ((F.length(short) >= 7) & F.startswith(long, F.concat(short, F.lit(" "))))


def near_name(a: Column, b: Column, least: float = 0.88) -> Column:
    """lengths at most 2 apart and an edit distance of at most 12 % of the longer name."""
    longer = F.greatest(F.length(a), F.length(b))
    return (a != "") & (b != "") & (F.abs(F.length(a) - F.length(b)) <= 2) & (1 - F.levenshtein(a, b) / longer >= least)


def presence_words(vendor: Column, description: Column) -> Column:
    """F16: up to three words that tell an entry from others: four letters or more (the first may have three), not generic,
    no month."""
    # the conditions of ``terms`` among the others: a word is looked at once
    words = F.split(plain_upper(F.concat_ws(" ", vendor, description)), "[^A-Z]+")
    good = F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*NOISE, *GENERIC) & ~F.substring(t, 1, 3).isin(*MONTHS)))
    return F.slice(F.filter(good, lambda t, i: (i == 0) | (F.length(t) >= 4)), 1, 3)


def natures(words: Column) -> Column:
    """the kinds of work that words name, by their first five letters."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda t: t.rlike(NATURE)), lambda t: F.substring(t, 1, 5))))


def stems(words: Column) -> Column:
    """the first six letters of the words that name no kind of work."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda t: ~t.rlike(NATURE)), lambda t: F.substring(t, 1, 6))))


def same_work(na: Column, ra: Column, nb: Column, rb: Column) -> Column:
    """F17 over natures and stems: kinds of work meet where both have some, and a third of the stems are shared where both have some."""
    apart = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    shared = F.size(F.array_intersect(ra, rb)) / F.greatest(F.size(F.array_union(ra, rb)), F.lit(1))
    return ~apart & ((F.size(ra) == 0) | (F.size(rb) == 0) | (shared >= 0.34))


def same_service(a: Column, b: Column) -> Column:
    """F17 over two word lists."""
    return same_work(natures(a), stems(a), natures(b), stems(b))


def exempt_reason(description: Column, category: Column) -> Column:
    """why an entry needs no receipt, null if it does."""
    both, text = plain_upper(F.concat_ws(" ", description, category)), plain_upper(description)
    return (
        F.when(both.contains("TRANSF") & both.contains("CTA"), "internal_transfer")
        .when(both.contains("BANCARI") | (text.contains("TAR") & text.rlike(BANK_FEE) & ~text.rlike(UTILITY_WORDS)), "bank_fee")
        .when((text.contains("RESGATE") | text.contains("IOF") | text.contains("JUROS")) & text.rlike(BANK_CHARGE), "bank_charge")
        .when(text.contains("ISENCAO") & text.rlike(QUOTA_WAIVER), "quota_waiver")
    )


def tax_of(description: Column) -> Column:
    """the tax that a description begins with."""
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(description, F.lit(""))), TAX, 1), F.lit(""))

"""Literal rows for what stands beside the entries."""

from pyspark.sql import functions as F

from tally.functions import documents
from tally.operators import assignment
from tally.sources import readers

KEYS = "condo_id int, month date"
M = "2024-01-01"


def frame(spark, rows, columns):
    """``rows`` of the first building in January 2024; money and dates are given as text."""
    names = [c.split(" ") for c in columns.split(", ")]
    plain = ", ".join(f"{n} {'string' if k in ('money', 'date') else k}" for n, k in names)
    df = spark.createDataFrame(rows, plain) if rows else spark.createDataFrame([], plain)
    casts = [F.col(n).cast("decimal(18,2)" if k == "money" else k).alias(n) for n, k in names]
    return df.select(F.lit(1).alias("condo_id"), F.to_date(F.lit(M)).alias("month"), *casts)


def test_pages_by_amount_number_and_name(spark):
    entries = frame(
        spark,
        [
            ("a", "10.00", None, "Água Clara Ltda"), ("b", "20.00", "NF 777", "Fonte Nova"), ("c", "30.00", "R 1", "x"), ("d", "40.00", "R 1", "x"),
            ("e", "50.00", None, "BANCO Azul Norte"), ("f", "60.00", None, None), ("g", "70.00", None, "Clara"), ("h", "80.00", None, "Agua Clara"), ("i", "10.00", None, "Água Clara Ltda"),
        ],
        "code string, amount money, document string, name string",
    )
    pages = frame(spark, [(5, "pago 10,00"), (6, "AGUA CLARA total 10,00"), (7, "nota 777"), (8, "nota 1777"), (9, "soma 70,00"), (10, "banco azul norte 50,00"), (11, "agua clara"), (12, "agua clara"), (13, None)], "group long, text string")
    got = {r["code"]: (r["group"], r["points"]) for r in assignment.content_match(entries, pages).collect()}
    assert got == {"a": (6, 5), "i": (6, 5), "b": (7, 3), "c": (9, 3), "d": (9, 3), "e": (None, None), "f": (None, None), "g": (9, 3), "h": (6, 2)}
    none = frame(spark, [], "group long, text string")
    assert {r["group"] for r in assignment.content_match(entries, none).collect()} == {None}


def test_ledger_lines_give_accounts_and_new_entries(spark):
    entries = frame(spark, [("a", "5.00", "c", "2024-01-02"), ("b", "5.00", "c", "2024-01-02"), ("c", "9.00", "c", "2024-01-02"), ("d", "-5.00", "c", "2024-01-02")], "code string, amount money, category string, paid date")
    lines = frame(spark, [("1", "x", "-5.00", "B", "2024-01-02"), ("2", "TRANSF", "-7.00", "A", "2024-01-02"), ("3", "y", "5.00", "C", "2024-01-02"), ("4", "z", "-8.00", "B", "2024-01-03")], "line string, description string, amount money, account string, paid date")
    got = sorted((r["code"], r["account"], r["source"], r["category"], float(r["amount"])) for r in assignment.ledger_entries(entries, lines).collect())
    assert got == [
        ("2", "A", "left_over", assignment.TRANSFER, 7.0), ("4", "B", "left_over", assignment.UNSORTED, 8.0), ("a", "B", "ledger", "c", 5.0),
        ("b", "A", "first_account", "c", 5.0), ("c", "A", "first_account", "c", 9.0), ("d", "C", "ledger", "c", -5.0),
    ]


def test_invoices_on_pages_of_other_codes(spark):
    listed = frame(spark, [("a", "0012345", "INSS FORT"), ("b", "678", "INSS RETENCAO"), ("c", "99", "FORT"), ("d", None, "FORT")], "code string, invoice_text string, description string")
    pages = frame(spark, [("x", "[Pagina 1]\nNOTA FISCAL 12.345 Forte"), ("y", "[Pagina 1]\nNOTA FISCAL 678"), ("c", "[Pagina 1]\nNOTA FISCAL 99 FORT"), ("z", "[Pagina 1]\nComprovante de Pagamento NOTA FISCAL 99 FORT"), ("w", None)], "code string, raw_text string")
    assert sorted(tuple(r)[2:] for r in assignment.invoice_elsewhere(listed, pages).collect()) == [("a", "12345"), ("b", "678")]


def test_sheet_blocks(spark):
    texts = [
        ("Condomínio: X", None), ("", None), ("Demonstrativo de Despesas Período 1 a 2", None), ("ORDINÁRIA", None), ("Direto", "1.00"), ("Limpeza", None), ("Sabão", "2.00"), ("Vassoura", "3.00"),
        ("TOTAL DA CONTA Limpeza", "5.50"), ("TOTAL DA CONTA ORDINÁRIA", "6.00"), ("RESERVA", None), ("Obra", "4.00"), ("TOTAL DA CONTA RESERVA", "4.00"), ("Condomínio: X", None), ("Resumo", None), ("Conta", "9.00"),
    ]
    cells = frame(spark, [(i, t, a) for i, (t, a) in enumerate(texts)], "row int, text string, amount money")
    entries = sorted((r["account"], r["sub"] or "", r["description"]) for r in readers.block_entries(cells).collect())
    assert entries == [("ORDINÁRIA", "", "Direto"), ("ORDINÁRIA", "Limpeza", "Sabão"), ("ORDINÁRIA", "Limpeza", "Vassoura"), ("RESERVA", "", "Obra")]
    totals = {(r["account"], r["sub"]): (float(r["items"]), r["closes"]) for r in readers.block_totals(cells).collect()}
    assert totals == {("ORDINÁRIA", None): (6.0, True), ("ORDINÁRIA", "Limpeza"): (5.0, False), ("RESERVA", None): (4.0, True)}


def test_receipt_keys(spark):
    text = "capa\n[RECIBO OCR pag. 3]\nIdentificação no extrato  débito  12\nautenticação: abcDEF1234567"
    df = spark.createDataFrame([(text,), ("[RECIBO OCR pag. 3]\nx",), ("Destina-se a: y\n10 Gás 1.000,00\nB\n Valor Emitido",), (None,)], "t string")
    got = [(r["s"] and (r["s"]["ident"], r["s"]["auth"]), r["c"]) for r in df.select(documents.receipt_signature(F.col("t")).alias("s"), documents.cover_complement(F.col("t")).alias("c")).collect()]
    assert got == [(("DÉBITO 12", "ABCDEF1234567"), ""), (None, ""), (None, "10 GAS B"), (None, "")]


def test_evidence_of_an_amount(spark):
    pad = " do fornecedor em conta corrente da agência do centro da cidade, com a descrição dos itens"
    paid = "Comprovante de Pagamento" + pad
    expected = frame(spark, [(c, "100.00") for c in "abcdefgh"], "code string, amount money")
    pages = [
        ("a", 1, "item 100,00" + pad, None), ("a", 2, paid + " 100,00", None), ("b", 1, "item 100,00" + pad, None), ("b", 2, paid, "90.00"), ("c", 1, "item 100,00" + pad, None), ("c", 2, paid + " (CONSOLIDADO)", "90.00"),
        ("d", 1, paid, "60.00"), ("d", 2, paid, "15.00"), ("d", 3, paid, "40.00"), ("e", 1, "100,00", "100.00"), ("f", 1, pad + " 130,00 e 1.600,00", "32.00"), ("g", 1, pad, "60.00"), ("g", 2, pad, "60.00"), ("g", 3, pad, "40.00"),
    ]
    pages = frame(spark, [*pages, ("z", 1, None, None)], "code string, page int, text string, page_amount money")
    read = lambda final: {r["code"]: (r["state"], r["page"], None if r["amount"] is None else float(r["amount"])) for r in assignment.resolved_evidence(expected, pages, final=final).collect()}
    first = read(False)
    assert first == {
        "a": ("confirmed", 2, 100.0), "b": ("weak", 1, 100.0), "c": ("confirmed", 1, 100.0), "d": ("confirmed", 1, 100.0),
        "e": ("empty", None, None), "f": ("read", 1, 130.0), "g": ("confirmed", 1, 100.0), "h": ("empty", None, None),
    }
    assert read(True) == first | {"b": ("read", 2, 90.0)}


def test_questions_and_displayed_values(spark):
    items = frame(spark, [("1", "new_vendor", "open", "c", "Quem é e onde está a nota fiscal?"), ("2", "new_vendor", "open", "c", "Quem é e onde está a nota fiscal?"), ("3", "new_category", "open", "Nova", "?"), ("4", "late_payment", "informative", "c", "Por quê?"), ("5", "late_payment", "open", "c", "")], "id string, kind string, state string, category string, question string")
    cited = frame(spark, [("1", "5.00", 1, "Fundo de Reserva"), ("2", "5.00", 1, "A"), ("2", "6.00", 1, "A"), ("4", "5.00", 1, "FUNDO RESERVA"), ("5", "5.00", 1, "FUNDO RESERVA")], "id string, amount money, page int, account string")
    listed = frame(spark, [("x", "5.00", 2, 1), ("y", "-5.00", 1, 2), ("z", "6.00", 3, 3)], "code string, amount money, page int, ord int")
    known = spark.createDataFrame([(1, "Água")], "condo_id int, category string")
    got = {r["id"]: r["question"] for r in assignment.adjusted_questions(items, cited, listed, frame(spark, [("y",), ("z",)], "code string"), frame(spark, [("z",)], "code string"), known).collect()}
    assert got["1"] == "Quem é?" + assignment.FUND_ONE and got["2"] == "Quem é e onde está a nota fiscal?" and got["3"].startswith('A subconta "Nova"') and got["4"] == "Por quê?" and got["5"] == ""
    findings = frame(spark, [("a", "t", "open", "5.00", "6.00"), ("b", "t", "open", "5.00", None), ("c", "t", "informative", "5.00", None)], "code string, type string, state string, expected money, found money")
    checks = frame(spark, [("a", "5.00", "1.00", 1), ("a", "5.00", "2.00", 2), ("b", "-5.00", "1.00", 1)], "code string, listed money, shown money, place int")
    assert sorted((r["code"], float(r["value"])) for r in assignment.displayed_values(findings, checks).collect()) == [("a", 2.0), ("b", 5.0)]

"""Files and what they say: literal rows."""

from pyspark.sql import functions as F

from tally.operators import cash_book, file_identity, matching, review_layer

KEYS = "condo_id int, month string, "


def test_whose_file_it_is(spark):
    buildings = spark.createDataFrame([(1, "Edifício São João II", False), (2, "Go Barra", False), (3, "Elo", True), (4, "Parque Saint Afonso", False)], "condo_id int, name string, nameless boolean")
    aliases = spark.createDataFrame([(2, "Go B.")], "condo_id int, alias string")
    head = "Prestação de contas: saldo, despesas e receitas "
    rows = [
        ("own", 1, head + "EDIFICIO SAO JOAO II"), ("short", 1, head + "Edifício São João - bloco"), ("alias", 2, head + "(GO B)"), ("glued", 2, head + "GO BARRAS"), ("other", 2, head + "PARQUE SAINT AFONSO e Edificio Sao Joao II"),
        ("not_shortened", 2, head + "Edificio Sao Joao"), ("nameless", 3, head), ("nameless_other", 3, head + "Go Barra"), ("blank", 4, None), ("one_word", 4, "saldo Go Barra"), ("unknown", 4, head + "Condomínio Vila Matilde"), ("tail", 4, "saldo receitas Afonso Parque Saint"),
    ]
    got = {r["file"]: (r["state"], r["reason"], r["says"]) for r in file_identity.file_identity(spark.createDataFrame(rows, "file string, condo_id int, text string"), buildings, aliases).collect()}
    start = "PRESTACAO DE CONTAS SALDO DESPESAS E RECEITAS"
    assert got == {
        "own": ("ok", "own", None), "short": ("ok", "own", None), "alias": ("ok", "own", None), "glued": ("refuse", "unnamed", start + " GO BARRAS"), "other": ("refuse", "other", "EDIFICIO SAO JOAO II, PARQUE SAINT AFONSO"),
        "not_shortened": ("refuse", "unnamed", "EDIFICIO SAO JOAO"), "nameless": ("warn", "nameless", None), "nameless_other": ("refuse", "other", "GO BARRA"), "blank": ("warn", "unreadable", None), "one_word": ("warn", "unreadable", None),
        "unknown": ("refuse", "unnamed", "CONDOMINIO VILA MATILDE"), "tail": ("refuse", "unnamed", "SALDO RECEITAS AFONSO PARQUE SAINT"),
    }


def test_every_level_of_account_names(spark):
    known = ["ORDINARIA", "Fundo-Reserva", "PROVISAO P/13o.SAL. E FERIAS", "TAXA EXTRA PINTURA", "TAXA EXTRA FACHADA A", "TAXA EXTRA FACHADA B"]
    want = {
        "Ordinária": ("ORDINARIA", 1), "FUNDO RESERVA": ("Fundo-Reserva", 1), "FUNDORESERVA": ("Fundo-Reserva", 2), "PROVISAO P/13": ("PROVISAO P/13o.SAL. E FERIAS", 3), "PINTURA DA TAXA": ("TAXA EXTRA PINTURA", 4), "TAXA EXTRA PIMTURA": ("TAXA EXTRA PINTURA", 5),
        "TAXA EXTRA FACHADA C": ("TAXA EXTRA FACHADA C", None), "TAXA EXTRA": ("TAXA EXTRA", None), "CAIXA": ("CAIXA", None), "": ("", None),
    }
    now, past = spark.createDataFrame([(1, "m", n) for n in want], KEYS + "name string"), spark.createDataFrame([(1, "m", n) for n in known] + [(2, "m", "CAIXA")], KEYS + "known string")
    assert {r["name"]: (r["canonical"], r["level"]) for r in matching.resolved_names(now, past).collect()} == want


def test_transfers_to_one_or_to_a_pair(spark):
    def found(*accounts):
        df = spark.createDataFrame([(1, "m", a, 900.0, out, into) for a, out, into in accounts], KEYS + "account string, debits double, debit_rest double, credit_rest double")
        df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debits", "debit_rest", "credit_rest")})
        return sorted((r["from_account"], r["to_account"], float(r["amount"]), r["kind"], float(r["net_debits"])) for r in matching.inferred_transfers(df).collect())

    assert found(("A", 100.0, 0.0), ("B", 0.0, 100.01), ("C", 0.0, 50.0)) == [("A", "B", 100.01, "single", 800.0)]
    assert found(("A", 100.0, 0.0), ("B", 0.0, 60.0), ("C", 0.0, 40.0)) == [("A", "B", 60.0, "pair", 800.0), ("A", "C", 40.0, "pair", 800.0)]
    assert found(("A", 100.0, 0.0), ("B", 0.0, 100.0), ("C", 0.0, 100.0)) == []  # two singles, no pair
    assert [x[1] for x in found(("A", 100.0, 0.0), ("B", 0.0, 100.0), ("C", 0.0, 100.0), ("D", 0.0, 70.0), ("E", 0.0, 30.0))] == ["D", "E"]
    assert found(("A", 100.0, 0.0), ("B", 0.0, 60.0), ("C", 0.0, 40.0), ("D", 0.0, 70.0), ("E", 0.0, 30.0)) == []  # two pairs
    assert found(("A", 100.0, 100.0), ("B", 100.0, 0.0)) == [("B", "A", 100.0, "single", 800.0)]  # an account sends nothing to itself
    assert found(("A", 100.0, 0.0), ("B", 100.0, 0.0), ("C", 0.0, 100.0)) == [("A", "C", 100.0, "single", 800.0)]  # the credit goes to the first sender


def test_descriptions_are_traced_over_line_ends(spark):
    long = "ABCDE " * 300
    lines = [(1, "m", 1, long), (1, "m", 2, "pago a Oficina São"), (1, "m", 3, "José Ltda. ref 12"), (1, "m", 4, None), (2, "m", 1, "nada")]
    text = spark.createDataFrame(lines, KEYS + "ord int, line string")
    rows = [(1, "m", "a", "OFICINA SAO JOSE LTDA"), (1, "m", "b", "Oficina Sao Jorge"), (1, "m", "c", "curta"), (2, "m", "d", "OFICINA SAO JOSE"), (3, "m", "e", "sem texto algum"), (1, "m", "f", "ABCDEABCDE pago a"), (1, "m", "g", None), (1, "m", "h", "ref 12 e mais"), (1, "m", "i", "OFICINA SAO JOSE LTDA. REF 12 e o que passa de 25 letras")]
    got = review_layer.untraced_descriptions(spark.createDataFrame(rows, KEYS + "code string, description string"), text)
    assert sorted(r["code"] for r in got.collect()) == ["b", "d", "e", "h"]


def test_cash_book_by_profile(spark):
    cover = "Destina-se a: taxa\nCHAPA {}\nValor Emitido 10,00"
    rows = [
        ("2024-01-01", 1, "a", "V", "7", "2024-01-10", "2024-01-10", 10.0, "LUZ", "conta NF 4455", "NOTA 4455", False), ("2024-01-01", 2, "b", "V", "7", "2024-01-10", "2024-01-10", 10.0, "LUZ", "x", "", False),
        ("2024-02-01", 3, "c", "W", None, "2024-02-10", "2024-02-20", 20.0, "LUZ", "x", cover.format(1), False), ("2024-02-01", 4, "d", "W", None, "2024-02-10", "2024-02-14", 20.0, "LUZ", "x", cover.format(2), False),
        ("2024-02-01", 5, "e", "X", "9", "2024-02-10", "2024-02-10", 30.0, "OBRAS", "obra NF 7788", "nada", False), ("2024-02-01", 6, "f", "Y", "8", None, None, 40.0, "LUZ", "obra NF 7799", "nada", True),
    ]
    names = "condo_id int, month string, ord int, code string, vendor string, document string, due string, paid string, amount double, category string, description string, text string, is_summary boolean"
    book = spark.createDataFrame([(condo, *r) for condo in (1, 2) for r in rows], names).withColumns({c: F.to_date(c) for c in ("month", "due", "paid")}).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    declared = spark.createDataFrame([(1, "2024-01-01", 20.0), (1, "2024-02-01", 100.0), (2, "2024-02-01", 110.0)], "condo_id int, month string, declared double").withColumn("month", F.to_date("month")).withColumn("declared", F.col("declared").cast("decimal(18,2)"))

    def found(*profile):
        df = cash_book.cash_book_findings(book, declared, spark.createDataFrame(list(profile), "condo_id int, check string"))
        return sorted((r["condo_id"], r["check"], r["subject"], r["severity"], r["n"]) for r in df.collect())

    late, invoice, category = (1, "late", "c", "attention", 6), (1, "invoice", "e", "attention", 1), (1, "category", "OBRAS", "informative", 1)  # carnival: 10 to 14 February
    every = [category, (1, "declared_total", "2024-02", "critical", 4), (1, "duplicate", "a", "attention", 2), invoice, late]
    assert found(*((1, c) for c in cash_book.CHECKS)) == every
    for off in cash_book.CHECKS:  # each check on its own can be left out
        assert found(*((1, c) for c in cash_book.CHECKS if c != off)) == [x for x in every if x[1] != off]
    assert found((2, "duplicate"), (1, "late")) == [late, (2, "duplicate", "a", "attention", 2)]

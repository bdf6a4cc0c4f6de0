"""What the joins make in between grows with their input: rows counted in small tables of common words, near names and equal amounts."""

import itertools

from pyspark.sql import functions as F

from tally.functions import documents, identity
from tally.functions.text import norm_text
from tally.operators import assignment, configured, identified, likeness, matching, review_layer
from tally.plans import catalog_assignment, catalog_named, catalog_review
from tally.sources import ledger, named, readers
from tally.sources.stored import stored
from tests.test_ledger import entry_rows

KEYS = "condo_id int, month string, "


def most_rows(spark, run):
    """The result of ``run`` and the most rows that a step of its plans gave out."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    ran = store.executionsCount()
    result = run().collect()
    bus.waitUntilEmpty()
    most, every = 0, store.executionsList()
    for at in range(ran, every.size()):
        number = every.apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for metric in (m.apply(j) for m in (nodes.apply(i).metrics() for i in range(nodes.size())) for j in range(m.size())):
            value = values.get(metric.accumulatorId())
            if metric.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return result, most


def test_near_names_of_one_long_word(spark):
    """names that share a long piece meet only near ones."""
    names = [f"BLANCHED {''.join(x)}" for x in itertools.product("ABCDE", repeat=4)]
    df = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    got, most = most_rows(spark, lambda: likeness.near_names(df, df, ["k"], "name"))
    assert len(got) == len(names) * 17 and most < 60_000


def test_words_that_begin_alike(spark):
    """words with the same first letters meet only the tokens that hold them."""
    df = spark.createDataFrame([(1, f"CASA{''.join(x)}") for x in itertools.product("ABCDE", repeat=3)], "k int, word string")
    got, most = most_rows(spark, lambda: likeness.words_within(df, df.withColumnRenamed("word", "text"), ["k"]))
    assert len(got) == 125 and most < 5_000
    longer = spark.createDataFrame([(1, "CONSTRUCAOX"), (1, "CONSTRUCAO")], "k int, word string")
    texts = spark.createDataFrame([(1, "A RECONSTRUCAOX"), (1, "CONSTRUCA CONSTRUCAO")], "k int, text string")
    assert {tuple(r)[1:] for r in likeness.words_within(longer, texts, ["k"]).collect()} == {("CONSTRUCAOX", "A RECONSTRUCAOX"), ("CONSTRUCAO", "A RECONSTRUCAOX"), ("CONSTRUCAO", "CONSTRUCA CONSTRUCAO")}


def test_pages_with_common_words_and_numbers(spark):
    """names of one common word and documents of one number meet the first page of what they ask for."""
    n = 300
    rows = [(1, "1995-01-01", i, f"c{i}", 10.0 + i, i, "F 100" if i % 2 else None, f"COMUM NOME{chr(65 + i // 26)}{chr(65 + i % 26)}") for i in range(n)]
    entries = spark.createDataFrame(rows, KEYS + "ord int, code string, amount double, invoice int, document string, name string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    pages = spark.createDataFrame([(1, "1995-01-01", 1000 + i, f"Nota 100 COMUM NOME{chr(65 + i // 26)}{chr(65 + i % 26)} {i + 500}") for i in range(n)], KEYS + "group long, text string")
    got, most = most_rows(spark, lambda: assignment.content_match(entries, pages))
    assert {r["code"]: (r["group"], r["points"]) for r in got} == {f"c{i}": (1000 + i, 5 if i % 2 else 2) for i in range(n)} and most < 10_000


def test_descriptions_that_begin_alike(spark):
    """beginnings with the same eight letters are compared by equality."""
    n = 2000
    cited = spark.createDataFrame([(1, "1995-01-01", f"c{i}", f"MANUTENCAO DE {i:06}") for i in range(n)], KEYS + "code string, description string")
    lines = spark.createDataFrame([(1, "1995-01-01", i, f"MANUTENCAO DE {i:06}") for i in range(1, n)], KEYS + "ord int, line string")
    got, most = most_rows(spark, lambda: review_layer.untraced_descriptions(cited, lines))
    assert [r["code"] for r in got] == ["c0"] and most < 50_000


def test_many_items_of_few_amounts(spark):
    """items of one amount stand for each other, the first of them is taken."""
    items = spark.createDataFrame([(1, "1995-01-01", "a", i, f"{i:03}", 10.0 + i % 10) for i in range(600)], KEYS + "account string, ord int, code string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    targets = spark.createDataFrame([(1, "1995-01-01", "a", 19.0 * 3), (1, "1995-01-01", "a", 40.0)], KEYS + "account string, target double").withColumn("target", F.col("target").cast("decimal(18,2)"))
    got, most = most_rows(spark, lambda: matching.subset_sums(items, targets))
    assert {float(r["target"]): (r["items"], r["used"], r["codes"]) for r in got} == {57.0: (600, 3, "009,019,029"), 40.0: (600, 3, "000,001,009")} and most < 20_000


def test_half_sums_that_reach_no_target(spark):
    # 300 amounts, 45,150 pairs of them; a target near the least sum lets few of them begin a subset
    items = spark.createDataFrame([(1, 1000 + i, str(i), (i * i * 7919 % 1_000_003 + 1000) / 100) for i in range(300)], "k int, ord long, code string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    four = sorted((a, c) for _, _, c, a in items.collect())[1:5]
    targets = spark.createDataFrame([(1, sum(a for a, _ in four))], "k int, target decimal(18,2)")
    found, most = most_rows(spark, lambda: matching.subset_sums(items, targets, 4, 0, ("k",)))
    assert found[0]["used"] == 4 and set(found[0]["codes"].split(",")) == {c for _, c in four}
    assert most < 2_000


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_text_by_one_class(spark):
    """A plain text takes no pattern of alternatives, and is the same."""
    rows = spark.createDataFrame([(" a  b-c ",), ("Água/Luz\t7",), ("x\u2028ß.",), ("--",), (None,)], "t string")
    plain = rows.select(norm_text(F.col("t")).alias("n"))
    assert [r["n"] for r in plain.collect()] == ["A B C", "AGUA LUZ 7", "X SS", "", None] and "|[" not in plan_of(plain)


def test_transfers_without_a_pattern(spark):
    """a word without signs is looked for as it is."""
    accounts = spark.createDataFrame([(1, "1995-01-01", "ORDINARIA", 9000.0, 1000.0, 5.0)], KEYS + "account string, debits double, credits double, closing double")
    entries = spark.createDataFrame([(1, "1995-01-01", "ORDINARIA", "DESPESAS", x, 1000.0) for x in ("Transf. p/ conta", "transferência", "TRANS F", None)], KEYS + "account string, category string, description string, amount double")
    money = lambda df, *names: df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})
    income = spark.createDataFrame([], KEYS + "account string, kind string, amount double")
    got = identified.deficit_without_transfers(money(accounts, "debits", "credits", "closing"), money(entries, "amount"), money(income, "amount"))
    assert [float(r["deficit"]) for r in got.collect()] == [6000.0] and "Contains(upper(" in plan_of(got)


def test_page_texts_worked_out_once(spark):
    """the filter on pages doesn't work out their text for each word that it asks for."""
    attachments = spark.createDataFrame([(1, "1995-01-01", "a", "[Pagina 1]\nNOTA FISCAL 77\n[Pagina 2]\nx")], KEYS + "code string, raw_text string")
    pages = documents.pages_of(attachments).filter(documents.has_invoice_marker(F.col("page_text")) & ~documents.is_payment_page(F.col("page_text")))
    assert [(r["page"], r["page_text"]) for r in pages.collect()] == [(1, "NOTA FISCAL 77\n")] and plan_of(pages).count("[0-9]+\\]") == 1


def test_page_facts_worked_out_once(spark):
    """what a page says of an amount isn't asked again for every sum."""
    expected = spark.createDataFrame([(1, "1995-01-01", "a", 30.0)], KEYS + "code string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    paid = "Comprovante de Pagamento " + "x" * 80
    pages = spark.createDataFrame([(1, "1995-01-01", "a", 1, paid, 10.0), (1, "1995-01-01", "a", 2, paid, 20.0)], KEYS + "code string, page int, text string, page_amount double").withColumn("page_amount", F.col("page_amount").cast("decimal(18,2)"))
    got = assignment.resolved_evidence(expected, pages)
    assert [tuple(r)[3:5] for r in got.collect()] == [("confirmed", 1)] and "Comprovante" not in plan_of(got)


def test_words_asked_before_a_pattern(spark):
    """no pattern finds what the words asked before it leave out."""
    texts = ["NOTA FISCAL 1", "nota  fatura", "nfs-e", "DANFE", "NF-e", "chave de acesso", "Identificação do Emitente", "documento auxiliar", "nota de reembolso", "Código de Verificação", "cálculo do ISS", "valor total dos serviços", "tomador de serviço", "prestador do servi", "encaminhar a Nota Fiscal.", "NF será emitida", "Comprovante de Depósito", "dados do lançamento", "Pagamento realizado", "valor do lançto", "conta de débito", "Data da transferência", "autenticação", "Autenticação mecânica", "beneficiário", "linha digitável", "Recibo do pagador", "sacador", "ficha de compensação", "x", "", None]
    texts += ["Recibo Declarado: 12345", "Número do Documento: 12 345678901 2", "Documento No 12345678 9"]
    df, t = spark.createDataFrame([(x,) for x in texts], "t string"), F.col("t")
    D = documents
    pairs = [
        (D.is_payment_page(t), t.rlike(D.PAYMENT_PAGE) | F.regexp_replace(t, D.MECHANICAL, " ").rlike(D.AUTHENTICATION)), (D.is_bank_slip(t), t.rlike(D.BANK_SLIP)),
        (D.has_invoice_marker(t), F.regexp_replace(t, D.FALSE_MARKER, " ").rlike(D.INVOICE_MARKER)), (D.slip_id(t), F.regexp_replace(D.first_of(t, D.SLIP_IDS), r"\s+", "")),
    ]
    assert all(df.filter(~a.eqNullSafe(b)).isEmpty() and not df.filter(b.isNotNull()).isEmpty() for a, b in pairs)
    amounts = [("R$ 1.234,50 ", True), ("1234,5", True), ("91.234,50", False), ("1.234,505", False), ("x.1.234,50", True), ("7.1.234,50 1 234 , 50", True), ("1.234,5 1.234,51", True), ("234,50", False), (None, False)]
    shown = spark.createDataFrame(amounts, "t string, shown boolean").filter(D.amount_in_text(t, F.lit("1234.50").cast("decimal(18,2)")) != F.col("shown"))
    assert shown.isEmpty()


def test_new_vendors_look_at_the_months_asked_about(spark):
    """entries of other months than the history of those asked about give no parts of words."""
    old = [("2020-01-01", i, 10.0, f"NOME {''.join(x) * 5}", "", "C") for i, x in enumerate(itertools.product("ABCDE", repeat=4))]
    past = [(f"2024-0{m}-01", 1000 + m, 5000.0, "CONHECIDO SILVA", "", "C") for m in (1, 2)]
    rows = entry_rows(spark, [*old, *past, ("2024-03-01", 2000, 5000.0, "CONHECIDO SILVA", "", "C"), ("2024-03-01", 2001, 5000.0, "ALHEIO", "", "C")])
    asked = identified.of_new_vendor(rows, 3000).filter("month = '2024-03-01'")
    got, most = most_rows(spark, lambda: identified.new_among(asked, rows, 2).select("key"))
    assert [r["key"] for r in got] == ["ALHEIO"] and most < 5_000


def test_vendors_of_one_month_meet_no_categories(spark):
    """R16 compares categories only of vendors that another month near has."""
    names = [f"NOME {''.join(x)}" for x in itertools.product("ABCDE", repeat=4)]
    rows = [("2024-03-01", i, 10.0, n, "x", "CONSUMO DE AGUA" + "A" * (i % 40)) for i, n in enumerate(names)]
    rows += [("2024-02-01", 2000, 10.0, names[0], "x", "OBRAS NOVAS"), ("2024-02-01", 2001, 10.0, names[1], "x", "CONSUMO DE AGUA")]
    df = entry_rows(spark, rows)
    got, most = most_rows(spark, lambda: identified.switched_category(df))
    assert [(r["key"], r["category"]) for r in got] == [(names[0], "CONSUMO DE AGUA")] and most < 5_000


def test_rules_are_asked_where_they_apply(spark):
    """rows of other statements, or below the building's own limit, don't reach a rule that costs much for each."""
    own = configured.settings_of(configured.leaves(spark.createDataFrame([(1, '{"manager": {"new_vendor": 20}}'), (2, '{"manager": {}}')], "condo_id int, tree string")))
    rows = spark.createDataFrame([(c, m, a) for c in (1, 2) for m in ("1995-01-01", "1995-02-01") for a in (10.0, 20.0, 3000.0)], KEYS + "amount double")
    applied = spark.createDataFrame([(1, "1995-01-01", "G1", True), (2, "1995-01-01", "G1", True), (1, "1995-02-01", "G1", False), (1, "1995-02-01", "G8", True)], KEYS + "rule string, applied boolean")
    got = configured.in_force(rows, "G1", applied, own)
    assert got.columns == rows.columns and sorted(tuple(r) for r in got.collect()) == [(1, "1995-01-01", 20.0), (1, "1995-01-01", 3000.0), (2, "1995-01-01", 3000.0)]


def test_written_expenses_serve_the_tables_after_them(spark):
    """once a session has written the expenses, no table made of them joins the star schema again."""
    sf_dir = "/root/testdata/sf0.001"
    stored(ledger.expense)(spark, sf_dir)
    tables = [ledger.account_month(spark, sf_dir), named.entries.table(spark, sf_dir), ledger.months.table(spark, sf_dir)]
    assert not any("lineitem" in path for df in tables for path in df.inputFiles())
    want = ledger.expense(spark, sf_dir).groupBy("condo_id", "month").agg(F.sum("amount").alias("debits"))
    got = tables[0].groupBy("condo_id", "month").agg(F.sum("debits").alias("debits")).filter("debits <> 0")
    assert got.exceptAll(want.select(got.columns).withColumn("debits", F.col("debits").cast(got.schema["debits"].dataType))).isEmpty()


def test_words_asked_before_a_kind(spark):
    """what the words asked before a kind's pattern leave out isn't of the kind."""
    texts = ["Não  identificado", "sem identificação", "a identificar", "A IDENTIFICARX", "Desconhecida", "débito / crédito não", "DEBITO CREDITO NAO", "pagamento diverso", "sem histórico", "historico", "credito", "", None, "luz"]
    df, t = spark.createDataFrame([(x,) for x in texts], "t string"), F.col("t")
    plain = identity.plain_upper(t).rlike(identity.KINDS["unidentified"])
    assert df.filter(identity.is_kind(t, "unidentified") != plain).isEmpty() and df.filter(plain).count() == 8
    assert "Contains(" in plan_of(df.filter(identity.is_kind(t, "unidentified")))


def test_findings_join_expenses_once(spark):
    """the review layer's findings read what they ask of expenses from one narrow table."""
    sf_dir = "/root/testdata/sf0.001"
    assert catalog_review.amounts(spark, sf_dir).columns == [*configured.KEYS, "account", "code", "amount"]
    found = catalog_review.findings.table(spark, sf_dir)
    assert not any("lineitem" in path for path in found.inputFiles()) and found.count() > 0


def test_sheets_join_expenses_once(spark):
    """F8, F9 (round 4): all parts of a sheet read the expenses that were joined and written for them."""
    assert "Join" not in plan_of(catalog_assignment.cells(spark, "/root/testdata/sf0.001"))
    totals = readers.block_totals(catalog_assignment.cells(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan_of(totals)


def test_identity_is_written_once(spark):
    """F4, F7 (round 4): entries aren't written before their identity, and G1 carries only what it is asked for."""
    sf_dir = "/root/testdata/sf0.001"
    wanted = identified.of_new_vendor(catalog_named.written_entries(spark, sf_dir), 3000)
    assert wanted.columns == [*configured.KEYS, "no", "ord", "code", "key", "words", "amount"]
    # as before the change: the first good word with three letters or more, those after it with four
    texts = ["ABC DEF GHIJ KLM NOPQ RST UVWX", "DE ABC", "JANELA LIMPEZA ABCD EF GHIJ GHIJ", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(identity.presence_words(F.col("t"), F.lit(None).cast("string")).alias("w"))
    assert [r["w"] for r in got.collect()] == [["ABC", "GHIJ", "NOPQ"], ["ABC"], ["ABCD", "GHIJ"], [], []]
    fresh = spark.newSession()
    assert "Join" in plan_of(catalog_named.written_entries.table(fresh, "/root/testdata/sf0.001/"))


def test_documents_are_made_of_written_entries(spark):
    """F6 (round 4): attachments read the entries that the session has written, and join no star schema of their own."""
    sf_dir = "/root/testdata/sf0.001"
    named.entries(spark, sf_dir)
    assert "Join" not in plan_of(named.attachments(spark, sf_dir))


def test_no_row_holds_the_text_of_a_month(spark):
    """F3 (round 4): a line takes what follows from the lines behind it, and its segments are as long however many lines there are."""
    lines = spark.createDataFrame([(1, "1995-01-01", i, x) for i, x in enumerate(["-", *"OFICINA", None, *"DEPINTURA", " ", *"NORTELTDA", "Z" * 200])], KEYS + "ord int, line string")
    cited = spark.createDataFrame([(1, "1995-01-01", c, d) for c, d in (("a", "Oficina de Pintura Norte"), ("b", "Oficina de Pintura Norte Ltd"), ("c", "Oficina de Pintura Sul"), ("d", "ltda " + "z" * 20), ("e", "z" * 30))], KEYS + "code string, description string")
    assert [r["code"] for r in review_layer.untraced_descriptions(cited, lines).collect()] == ["c"]
    segments = review_layer.text_segments(lines)
    assert "Aggregate" not in plan_of(segments) and segments.agg(F.sum("own")).first()[0] == 7 + 9 + 9 + 200


def test_payable_entries_are_narrow(spark):
    """F5 (round 4): what J13 and J22 ask of an entry is chosen, shuffled and written without the rest, and is the same."""
    sf_dir = "/root/testdata/sf0.001"
    columns = [*configured.KEYS, "ord", "code", "amount", "invoice", "name"]
    narrow = catalog_assignment.payees(spark, sf_dir).select(*columns)
    whole = catalog_assignment.ones(spark, sf_dir).select(*columns)
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()
    assert narrow.count() > 0 and not {"due", "vendor", "description", "category"} & set(catalog_assignment.payees(spark, sf_dir).columns)

"""Ledger queries against their SQL, and literal rows for the functions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tally.functions import calendar, documents, identity, text
from tally.operators import audits, checks, evidence, identified, matching, review_layer, rules
from tally.plans import catalog

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "fiu":
            frame[c] = frame[c].astype(float).round(6)
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert rows(catalog.queries()[name](spark, DIR).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_functions_on_literals(spark):
    df = spark.createDataFrame([("Água NF. 123 PARC 2/7", "(1.234,56)"), ("Taxa", "R$ 5,06-"), (None, "x")], "d string, m string")
    d = F.col("d")
    got = df.select(text.norm_text(d), text.invoice_no(d), text.installment(d)["n"], text.base_description(d), text.parse_brl(F.col("m")).cast("double")).collect()
    assert tuple(got[0]) == ("AGUA NF 123 PARC 2 7", "123", 2, "AGUA", -1234.56)
    assert tuple(got[1]) == ("TAXA", None, None, "TAXA", -5.06)
    assert got[2][4] is None and got[2][0] is None


def test_mutations_are_found(spark):
    income = spark.createDataFrame([(1, "2024-01-01", "A", "TEST INCOME", "-123.45", 1)], "condo_id int, month string, account string, description string, amount string, ord long")
    income = income.withColumn("month", F.to_date("month")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    assert [r["total"] for r in rules.negative_income(income).collect()] == [income.first()["amount"]]
    twice = income.select("condo_id", "month", F.lit("c").alias("code"), "amount")
    assert checks.duplicate_codes(twice.unionAll(twice)).count() == 1 and checks.duplicate_codes(twice).count() == 0


def test_business_days(spark):
    easter = calendar.with_easter(spark.createDataFrame([(1998,), (2000,), (2024,)], "y int")).collect()
    assert [str(r["easter"]) for r in easter] == ["1998-04-12", "2000-04-23", "2024-03-31"]
    dates = spark.createDataFrame([("2024-02-10",), ("2024-03-29",), ("2024-05-30",), ("2024-06-03",), (None,)], "d string").select(F.to_date("d").alias("due"))
    got = {str(r["due"]): str(r["business"]) for r in calendar.next_business_days(dates, "due").collect()}
    assert got == {"2024-02-10": "2024-02-14", "2024-03-29": "2024-04-01", "2024-05-30": "2024-05-31", "2024-06-03": "2024-06-03"}


def test_concentrated_yield(spark):
    rows = [(1, "A", 1000.0, 1000.0, 5.0), (1, "B", 20000.0, 20000.0, 0.0), (2, "A", 1000.0, 1000.0, 5.0), (2, "B", 100.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "condo_id int, account string, opening double, closing double, yield_amt double").withColumn("month", F.to_date(F.lit("2024-01-01")))
    assert [(r["condo_id"], r["others"], r["total"]) for r in audits.yield_concentrated(df).collect()] == [(1, 20000.0, 5.0)]


def test_latest_versions(spark):
    rows = [(1, "2024-01-05", 7, "warning"), (1, "2024-01-09", 3, "error"), (1, "2024-01-09", 4, "success"), (1, "2024-02-01", 1, "error"), (2, None, 9, "error")]
    df = spark.createDataFrame(rows, "condo_id int, ts string, event_id long, status string").withColumn("ts", F.to_timestamp("ts"))
    got = audits.latest_versions(df)
    assert sorted((r["condo_id"], str(r["month"]), r["version"], r["event_id"], r["status"]) for r in got.collect()) == [(1, "2024-01-01", 3, 4, "success"), (1, "2024-02-01", 1, 1, "error"), (2, "None", 1, 9, "error")]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_identity_on_literals(spark):
    rows = [("FUNDO DE RESERVA", "Fundo de Reserva Aplic."), ("CAIXA", "CAIXA GERAL"), ("ORDINARIA", "EXTRAORDINARIA")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(identity.same_account(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    pairs = [("MANUTENÇÕES EVENTUAIS", "MANUTENCOES EVENTUAIS E AQUISICOES", True), ("CONSUMO", "CONSUMO DE GAS", True), ("CONSUM", "CONSUMO", False), ("LUZ", "LUZ E AGUA", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert [r[0] for r in df.select(identity.same_category(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    df = spark.createDataFrame([("JJS SOLUCOES", "JS SOLUCOES", True), ("ABC", "ABD", False), ("", "", False)], "a string, b string, near boolean")
    assert [r[0] for r in df.select(identity.near_name(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    rows = [(None, "Manut - USECORP LTDA - NF 18763", "USECORP"), ("ENEL SA REF JUL", "x", "ENEL"), (None, "NF 12", "NF 12"), ("TK ELEVADORES BRASIL LTDA", None, "TK ELEVADORES")]
    df = spark.createDataFrame(rows, "v string, d string, key string")
    assert [r[0] for r in df.select(identity.vendor_key2(F.col("v"), F.col("d"))).collect()] == [r[2] for r in rows]
    rows = [("Taxa JUL/26", "2026-07-01"), ("Ref 07/2026", "2026-07-01"), ("ref. ago.2025", "2025-08-01"), ("13/2026", None)]
    df = spark.createDataFrame(rows, "d string, m string")
    assert [str(r[0]) for r in df.select(identity.competence(F.col("d"))).collect()] == [str(r[1]) for r in rows]
    rows = [("TRANSF.P/CTA APLIC", None, "internal_transfer"), ("TAR PIX", "x", "bank_fee"), ("CONTA DE ENERGIA TARIFA", None, None), ("IOF", None, "bank_charge"), ("ISENCAO - RECIBO: 4", None, "quota_waiver")]
    df = spark.createDataFrame(rows, "d string, c string, r string")
    assert [r[0] for r in df.select(identity.exempt_reason(F.col("d"), F.col("c"))).collect()] == [r[2] for r in rows]
    same = spark.createDataFrame([(["INSTALACAO", "PORTAO"], ["MANUTENCAO", "PORTAO"]), (["ELEVADORES"], ["ELEVADOR"]), (["POSTAGENS"], ["TARIFAS"]), ([], ["X"])], "a array<string>, b array<string>")
    assert [r[0] for r in same.select(identity.same_service(F.col("a"), F.col("b"))).collect()] == [False, True, False, True]


def test_documents_on_literals(spark):
    rows = [("valor 1.573,55", 573.55, False), ("R$ 1.573,55", 1573.55, True), ("pago 1573.55", 1573.55, True), ("R$ 368,1 ", 368.10, True), ("R$ 15,00", 5.0, False), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "t string, a double, shown boolean").withColumn("a", F.col("a").cast("decimal(18,2)"))
    assert [r[0] for r in df.select(documents.amount_in_text(F.col("t"), F.col("a"))).collect()] == [r[2] for r in rows]
    rows = [("NF-e nao disponivel", False), ("Encaminhar a Nota Fiscal junto", False), ("DANFE 12", True), ("Codigo de Verificacao: A1", True), ("Cálculo do ISS", True), ("Identificação do Emitente", True)]
    rows += [("prestador de serviço deve emitir DANFE", False), ("PRESTADORES PESSOA JURIDICA: " + "x\n" * 900 + "NOTA FISCAL", False), ("DANFE\nprestador de servico nao emite NOTA FISCAL", True)]
    df = spark.createDataFrame(rows, "t string, i boolean")
    assert [r[0] for r in df.select(documents.has_invoice_marker(F.col("t"))).collect()] == [r[1] for r in rows]
    rows = [("Autenticação 12AB", True), ("Autenticação mecânica", False), ("Valor do lançamento: 10", True), ("valor lancamento", True), ("Autenticacao mecanica, autenticacao 9", True), ("recibo", False)]
    df = spark.createDataFrame(rows, "t string, p boolean")
    assert [r[0] for r in df.select(documents.is_payment_page(F.col("t"))).collect()] == [r[1] for r in rows]
    df = spark.createDataFrame([("NOTA FISCAL No 001.378", "1378", True), ("Comprovante de Pagamento 1378", "1378", False), ("NF. 1378 taxa", "1378", False), ("nota 21378", "1378", False)], "t string, n string, found boolean")
    assert [r[0] for r in df.select(documents.invoice_in_page(F.col("t"), F.col("n"))).collect()] == [True, False, False, False]
    one = spark.createDataFrame([("identificação no extrato: D1213 D1217 valor total: R$ 1.000,10",)], "t string").select(documents.listed_codes(F.col("t")), documents.total_paid(F.col("t")).cast("double")).first()
    assert (one[0], one[1]) == (["1213", "1217"], 1000.1)


def entry_rows(spark, rows):
    df = spark.createDataFrame(rows, "month string, ord long, amount double, vendor string, description string, category string")
    df = df.select(F.lit(1).alias("condo_id"), F.to_date("month").alias("month"), (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("no"), "ord", F.col("ord").cast("string").alias("code"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit(1).cast("long").alias("invoice"), F.lit(None).cast("int").alias("inst_n"), F.to_date("month").alias("due"), "vendor", "description", "category", F.lit("ORDINARIA").alias("account"))
    return identified.with_identity(df)


def test_renamed_names_raise_no_alarm_and_new_ones_do(spark):
    past = [(f"2024-0{m}-01", m, 5000.0, "JJS SOLUCOES LTDA", "limpeza", "MANUTENCOES") for m in (1, 2, 3)] + [(f"2024-0{m}-01", 10 + m, 900.0, "ZELADOR OK", "servico", "PORTARIA GERAL") for m in (1, 2, 3)]
    now = [("2024-04-01", 20, 5100.0, "JS SOLUCOES ME", "limpeza", "MANUTENCOES EVENTUAIS"), ("2024-04-01", 21, 7000.0, "NOVATO OBRAS", "pintura", "OBRAS NOVAS"), ("2024-04-01", 22, 8000.0, "FULANO", "SALARIO", "FOLHA"), ("2024-04-01", 23, 300.0, "INSS", "INSS RETENCAO", "X")]
    df = entry_rows(spark, past + now)
    assert [r["code"] for r in identified.new_vendors(df).collect()] == ["21"]
    assert [r["key"] for r in identified.missing_vendors(df).collect()] == ["ZELADOR OK"]
    assert sorted(r["category"] for r in identified.new_category_of_renamed(df).collect()) == ["FOLHA", "OBRAS NOVAS", "X"]
    assert [r["key"] for r in identified.switched_category(df).collect()] == []
    moved = entry_rows(spark, past + [("2024-04-01", 30, 900.0, "ZELADOR OK", "servico", "OUTRA COISA")])
    assert [r["category"] for r in identified.switched_category(moved).collect()] == ["OUTRA COISA"]


def test_reconciliation_on_literals(spark):
    keys = "condo_id int, month string, "
    w = spark.createDataFrame([(1, "m", "a", 10.0, "d", "x"), (1, "m", "b", 5.0, "d", "x"), (1, "m", "c", 7.0, "e", "x")], keys + "code string, amount double, paid string, account string")
    p = spark.createDataFrame([(1, "m", "P1", "d", "x", 15.0), (1, "m", "P2", "d", "x", 15.0), (1, "m", "P3", "e", "x", 7.0)], keys + "payment string, paid string, account string, total double")
    assert [(r["payment"], r["expenses"], r["total"]) for r in matching.many_to_one(w, p).collect()] == [("P1", 2, 15.0)]
    assert sorted(r["payment"] for r in matching.orphan_payments(p, w).collect()) == ["P2", "P3"]
    t = spark.createDataFrame([(1, "m", "T1", 15.0, ["a", "b"]), (1, "m", "T2", 22.0, ["a", "z"])], keys + "payment string, total double, listed array<string>")
    assert sorted((r["code"], r["payment"]) for r in matching.consolidated_by_list(t, w).collect()) == [("a", "T1"), ("b", "T1")]


def test_a_sound_review_has_no_faults(spark):
    found = spark.createDataFrame([(1, "m", "t", "s")], "condo_id int, month string, type string, subject string")
    good = found.withColumns({"severity": F.lit("high"), "proposed": F.lit("high"), "reason": F.lit(None).cast("string"), "confidence": F.lit(0.5), "body": F.lit("x")})
    assert review_layer.invalid_reviews(found, good).count() == 0
    assert [r["fault"] for r in review_layer.invalid_reviews(found, good.withColumn("severity", F.lit("low"))).collect()] == ["severity", "no_reason"]


def test_attachment_states_on_literals(spark):
    bill, paid, extract = "Leitura atual 10, consumo kWh", "Comprovante de Pagamento de 10/01", "EXTRATO do mes de janeiro"
    rows = [
        ("null", 1, None), ("short", 1, "[Pagina 1]\nabc"), ("paid", 1, f"[Pagina 1]\n{paid}"), ("two", 1, f"[Página 1]\n{paid}\n[Página 2]\n{bill}"),
        ("parts", 1, paid), ("parts", 2, bill), ("unread", 1, f"01/02 {paid}"), ("blank_first", 1, f"[Pagina 1]\n\n[Pagina 2]\n{bill}"), ("extract", 1, extract), ("date", 1, f"{extract} 01/02/2024"),
        ("value", 1, "lido: 1.234,50"), ("other", 1, "lido: 1.234,51"), ("long", 1, "valor total da conta do banco " * 11), ("noise", 1, "qwe rty " * 60),
    ]
    df = spark.createDataFrame([(1, "2024-01", c, p, t) for c, p, t in rows], "condo_id int, month string, code string, part int, raw_text string").withColumn("amount", F.lit(1234.5))
    got = {r["code"]: r["state"] for r in evidence.attachment_states(df).collect()}
    unknown = dict.fromkeys(("null", "short", "unread", "blank_first", "other", "noise"), "unknown")
    assert got == unknown | dict.fromkeys(("paid", "extract", "date", "value"), "payment_only") | dict.fromkeys(("two", "parts", "long"), "bill")
    assert evidence.attachment_states(df.limit(0)).count() == 0


def test_descriptions_and_utilities_on_literals(spark):
    rows = [("06/07/2026 DA ELETROPAULO 18680192 101,27 0013", "DA ELETROPAULO 18680192", True), ("123456 06/07/2026 GÁS - jan 1,00 2,00", "GÁS - jan", False), ("GÁS - jan", "GÁS - jan", True), ("Planeta NETO", "Planeta NETO", False), ("", "", False), (None, None, False)]
    df = spark.createDataFrame([(d,) for d, _, _ in rows], "d string")
    got = df.select(evidence.clean_description(F.col("d")), evidence.is_utility(F.col("d"), F.lit(None).cast("string"))).collect()
    assert [tuple(r) for r in got] == [(c, u) for _, c, u in rows]


def test_links_and_lost_signs_on_literals(spark):
    found = spark.createDataFrame([(1, "2024-01", "unverifiable"), (1, "2024-01", "duplicate"), (2, "2024-01", "unverifiable"), (3, "2024-01", "unverifiable")], "condo_id int, month string, type string")
    papers = spark.createDataFrame([(1, "2024-01", "http://a"), (1, "2024-01", "HTTPS://b"), (2, "2024-01", "http://a"), (2, "2024-01", None)], "condo_id int, month string, raw_text string")
    assert sorted((r["condo_id"], r["type"]) for r in evidence.without_link_noise(found, papers).collect()) == [(1, "duplicate"), (2, "unverifiable"), (3, "unverifiable")]
    kinds = "condo_id int, month string, ord int, code string, amount double, description string"
    negative = spark.createDataFrame([(1, "2024-01", 1, "a", -5.0, "Estorno, água"), (1, "2024-01", 2, "b", -6.0, "Estorno"), (1, "2024-01", 3, "c", -7.0, "--")], kinds)
    seen = spark.createDataFrame([(1, "2024-01", 9, "", 5.0, "x ESTORNO ÁGUA y"), (1, "2024-01", 1, "", -6.0, "estorno"), (1, "2024-01", 2, "", 6.0, "estorno"), (1, "2024-01", 3, "", 7.0, "--")], kinds)
    assert [(r["code"], r["shown"]) for r in evidence.lost_signs(negative, seen).collect()] == [("a", 5.0)]

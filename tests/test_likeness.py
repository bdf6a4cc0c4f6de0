"""Likeness joins against comparing every name with every other, and the rules that use them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tally.functions import identity
from tally.operators import identified, likeness, matching
from tests.test_ledger import entry_rows


def variants(n, seed=3):
    draw, names = random.Random(seed), set()
    while len(names) < n:
        name = list("".join(draw.choice("ABCDE ") for _ in range(draw.randint(1, 40))).strip() or "A")
        names.add("".join(name))
        for _ in range(5):
            other = list(name)
            for _ in range(draw.randint(1, 5)):
                at, kind = draw.randrange(len(other) + 1), draw.random()
                if kind < 0.33 or not other:
                    other.insert(at, draw.choice("ABCDE"))
                elif kind < 0.66:
                    other.pop(min(at, len(other) - 1))
                else:
                    other[min(at, len(other) - 1)] = draw.choice("ABCDE")
            names.add("".join(other) or "B")
    return sorted(names)


def pairs(df, left, right):
    return {(r[left], r[right]) for r in df.collect()}


def test_near_names_are_all_found(spark):
    df = spark.createDataFrame([(1, n) for n in variants(2000)], "k int, name string")
    every = df.select("name").crossJoin(df.select(F.col("name").alias("other")))
    want = pairs(every.filter(identity.near_name(F.col("name"), F.col("other"))), "name", "other")
    assert pairs(likeness.near_names(df, df, ["k"], "name"), "name", "other") == want and len(want) > 3000
    apart = likeness.near_names(df, df.withColumn("k", F.lit(2)), ["k"], "name")
    assert apart.count() == 0


@pytest.mark.parametrize(("kind", "same"), [("account", identity.same_account), ("category", identity.same_category)])
def test_names_that_begin_alike_are_all_found(spark, kind, same):
    names = ["CONSUMO", "CONSUMO DE GAS", "CONSUMO DE GA", "CONSUM", "FUNDO DE OBRAS ELEVADOR", "FUNDO DE OBRAS FACHADA", "FUNDO DE OBRAS", "FUNDO DE", "FUNDO D", "Água e Esgoto", "AGUA E ESGOTO SABESP", "LUZ", "LUZ E AGUA", "", " - ", "fundo de obras"]
    df = spark.createDataFrame([(1, n) for n in names + variants(300)] + [(1, None)], "k int, name string")
    every = df.select("name").crossJoin(df.select(F.col("name").alias("other")))
    assert pairs(likeness.same_by_start(df, ["k"], "name", kind), "name", "other") == pairs(every.filter(same(F.col("name"), F.col("other"))), "name", "other")


def test_words_within_texts(spark):
    texts = ["THYSSENKRUPP ELEVADORES", "TK ELEVADOR", "USECORP", "A B", "", "12 ABC12DEF"]
    df = spark.createDataFrame([(1, t) for t in texts], "k int, text string")
    words = ["ELEVADOR", "KRUPP", "TK", "USE", "ABC", "DEF", "ELEVADORES", "CORPO"]
    asked = spark.createDataFrame([(1, w) for w in words if len(w) >= 3], "k int, word string")
    assert pairs(likeness.words_within(asked, df, ["k"]), "word", "text") == {(w, t) for w in words if len(w) >= 3 for t in texts if w in t}


def test_components_of_long_chains(spark):
    edges = [("x", i, i + 1) for i in range(0, 60)] + [("x", 100, 101), ("y", 1, 50), ("y", 50, 30)]
    df = spark.createDataFrame(edges, "k string, a long, b long")
    got = {(r["k"], r["node"]): r["component"] for r in likeness.components(df, ["k"]).collect()}
    assert got == {("x", i): 0 for i in range(61)} | {("x", 100): 100, ("x", 101): 100} | {("y", i): 1 for i in (1, 30, 50)}
    assert likeness.components(df.limit(0), ["k"]).count() == 0


def test_renamed_category_is_not_new(spark):
    rows = [("2024-01-01", 1, 10.0, "V", "x", "CONSUMO"), ("2024-02-01", 2, 10.0, "V", "x", "CONSUMO DE GAS"), ("2024-02-01", 3, 10.0, "V", "x", "CONSUMIVEIS")]
    assert [r["category"] for r in identified.new_category_of_renamed(entry_rows(spark, rows)).collect()] == ["CONSUMIVEIS"]


def streaks(spark, rows):
    df = spark.createDataFrame([(1, f"2024-{m:02}-01", a, c) for m, a, c in rows], "condo_id int, month string, account string, closing double").withColumn("month", F.to_date("month"))
    return sorted((r["month"].month, r["account"], r["streak"]) for r in identified.streak_of_renamed(df).collect())


def test_accounts_that_begin_alike_stay_apart(spark):
    two = [(m, f"FUNDO DE OBRAS {x}", -5.0) for m in range(1, 5) for x in ("ELEVADOR", "FACHADA")]
    assert streaks(spark, two) == [(m, f"FUNDO DE OBRAS {x}", m) for m in (3, 4) for x in ("ELEVADOR", "FACHADA")]
    three = [(1, "FUNDO DE OBRAS A", -5.0), (2, "FUNDO DE OBRAS B", -5.0), (3, "FUNDO DE OBRAS C", -5.0)]
    assert streaks(spark, three) == []
    renamed = [(1, "FUNDO DE OBRAS", -1.0), (2, "Fundo de Obras Aplic.", -1.0), (4, "FUNDO DE OBRAS", -1.0), (5, "FUNDO DE OBRAS", 1.0), (6, "FUNDO DE OBRAS", -1.0)]
    assert streaks(spark, renamed) == [(4, "FUNDO DE OBRAS", 3)]  # March has no statement, May ends the row
    assert streaks(spark, [(m, "CONSOLIDADO", -1.0) for m in range(1, 5)]) == []


def test_near_vendor_is_not_new(spark):
    past = [(f"2024-0{m}-01", m, 5000.0, "XABCDEFGHIJKLMNOPQRY", "", "C") for m in (1, 2)]
    now = [("2024-03-01", 3, 5000.0, "ZABCDEFGHIJKLMNOPQRW", "", "C"), ("2024-03-01", 4, 5000.0, "ALHEIO", "", "C")]
    assert [r["key"] for r in identified.new_vendors(entry_rows(spark, past + now)).collect()] == ["ALHEIO"]


def test_parts_of_words_count_as_presence(spark):
    past = [(f"2024-0{m}-01", m, 5000.0, None, "pago a THYSSENKRUPP", "C") for m in (1, 2)]
    now = [("2024-03-01", 3, 5000.0, "KRUPP BRASIL", "", "C"), ("2024-03-01", 4, 5000.0, "KRUPPEN BRASIL", "", "C")]
    assert [r["key"] for r in identified.new_vendors(entry_rows(spark, past + now)).collect()] == ["KRUPPEN BRASIL"]


def test_round_amounts_leave_new_vendors_out(spark):
    past = [(f"2024-0{m}-01", m, 2500.0 + m, "CONHECIDO SILVA", "", "C") for m in (1, 2)]
    now = [("2024-03-01", 3, 4000.0, "CONHECIDO SILVA", "", "C"), ("2024-03-01", 4, 4000.0, "NOVATO", "", "C"), ("2024-03-01", 5, 2000.0, "OUTRO", "", "C"), ("2024-03-01", 6, 2000.5, "OUTRO", "", "C")]
    assert sorted(r["code"] for r in identified.round_amounts(entry_rows(spark, past + now)).collect()) == ["3", "5"]


def test_works_join_in_chains(spark):
    chain = ["BOMBA PORTAO GUARITA", "PORTAO GUARITA TELHADO", "GUARITA TELHADO QUADRA", "TELHADO QUADRA SALAO"]  # the first and the last share nothing
    past = [(f"2024-0{m}-01", m, 1000.0, "OFICINA SUL", chain[0], "C") for m in (1, 2)]
    now = [("2024-03-01", 10 + i, 1000.0, "OFICINA SUL", d, "C") for i, d in enumerate(chain)] + [("2024-03-01", 20, 900.0, "OFICINA SUL", "JARDIM FLORES", "C")]
    got = [tuple(r)[2:] for r in identified.atypical_amounts(entry_rows(spark, past + now)).collect()]
    assert got == [("OFICINA SUL", 10, 4000.0, 4, 1000.0, False, "above")]


def test_competences_paid_at_once(spark):
    months = [f"TAXA PORTAO REF 0{m}/2024" for m in (1, 2, 3)]
    past = [(f"2024-0{m}-01", m, 1000.0, "OFICINA SUL", f"TAXA PORTAO REF 0{m}/2024", "C") for m in (1, 2)]
    now = [("2024-03-01", 10 + i, 1000.0, "OFICINA SUL", d, "C") for i, d in enumerate(months)]
    assert [tuple(r)[3:] for r in identified.atypical_amounts(entry_rows(spark, past + now)).collect()] == [(10, 3000.0, 3, 1000.0, False, "accumulated")]
    fresh = identified.atypical_amounts(entry_rows(spark, past[:1] + now))
    assert [tuple(r)[3:] for r in fresh.collect()] == [(10, 3000.0, 3, None, False, "uncompared")]
    uneven = now[:2] + [("2024-03-01", 12, 3000.0, "OFICINA SUL", months[2], "C")]
    assert [r["kind"] for r in identified.atypical_amounts(entry_rows(spark, past + uneven)).collect()] == ["earlier"]


def brute_subset(items, target, max_n):
    for n in range(1, max_n + 1):
        for chosen in itertools.combinations(items, n):
            if abs(sum(x for _, x in chosen) - target) <= 1:
                return n, ",".join(c for c, _ in chosen)
    return None, None


def test_subset_sums(spark):
    draw = random.Random(7)
    keys, groups, targets = "condo_id int, month string, account string, ", {}, {}
    for g in range(8):  # forty items; targets of the smallest, of all sizes, and of none
        groups[g] = [(f"{g}-{i:02}", draw.randrange(1000, 90_000_00)) for i in range(40)]
        chosen = sorted(groups[g], key=lambda x: x[1])[: 1 + g % 6] if g < 6 else [("x", 7)] if g == 6 else draw.sample(groups[g], 4)
        targets[g] = sum(x for _, x in chosen) + (g % 2)
    groups[8], targets[8] = [(f"8-{i:02}", 10_000 - 100 * i) for i in range(11)], 9_000  # the eleventh largest
    groups[9], targets[9] = [("9-00", 500), ("9-01", 500), ("9-02", 500), ("9-03", -200)], 800
    targets[10] = 5
    items = [(g, "m", "a", i, c, cents / 100) for g, own in groups.items() for i, (c, cents) in enumerate(own)]
    left = spark.createDataFrame(items, keys + "ord int, code string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    right = spark.createDataFrame([(g, "m", "a", t / 100) for g, t in targets.items()], keys + "target double").withColumn("target", F.col("target").cast("decimal(18,2)"))
    for max_n in (1, 4, 5):
        got = {r["condo_id"]: (r["items"], r["used"], r["codes"]) for r in matching.subset_sums(left, right, max_n).collect()}
        assert got == {g: (len(groups.get(g, [])), *brute_subset(groups.get(g, []), t, max_n)) for g, t in targets.items()}


def test_rows_of_a_code_stay_with_their_order(spark, monkeypatch):
    """One shuffle less where expenses lie by order, and the buildings are worked out once."""
    from tally.operators import checks
    from tally.sources import configs, ledger, named

    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = "hashpartitioning(code"
        plan = named.one_per_code(ledger.expense(spark, sf))._jdf.queryExecution().executedPlan().toString()
        assert by not in plan and "hashpartitioning(invoice" not in plan and "hashpartitioning(l_orderkey" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "l_orderkey" not in configs.base_trees(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, "1995-01-01", "a", 5.0), (1, "1995-01-01", "a", 5.0), (1, "1995-01-01", "b", 5.0), (1, "1995-01-01", "b", 6.0), (1, "1995-01-01", "c", None), (1, "1995-01-01", "c", None), (1, "1995-01-01", "d", None), (1, "1995-01-01", "d", 2.0)]
    found = checks.duplicate_codes(spark.createDataFrame(rows, "condo_id int, month string, code string, amount double"))
    assert sorted((r.code, r.n, r.amount) for r in found.collect()) == [("a", 2, 5.0), ("d", 2, 2.0)]


def test_a_query_works_out_only_the_identity_it_asks_for(spark):
    """Entries are written without vendor keys and words, in files that many tasks can read."""
    from tally.plans import catalog
    from tally.sources import named, stored

    catalog.queries()["g14_marketplace"](spark, "/root/testdata/sf0.001").collect()
    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001", "tally.sources.named.entries")
    assert key in stored._WRITTEN
    assert {"key", "words", "object"}.isdisjoint(named.entries(spark, "/root/testdata/sf0.001").columns)
    assert not any(k[2] == "tally.plans.catalog_named.entries" for k in stored._WRITTEN)

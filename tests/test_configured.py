"""Nested configurations, and rules that obey them."""

import json
import random

from pyspark.sql import functions as F

from tally.operators import configured, identified, rules
from tests.test_ledger import entry_rows


def merge(base, extra):
    out = dict(base)
    for k, v in extra.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(tree, path=""):
    if isinstance(tree, dict) and (tree or path):
        return {k: v for name, sub in tree.items() for k, v in leaves(sub, f"{path}/{name}" if path else name).items()} if tree else {path: "{}"}
    return {path: tree if isinstance(tree, str) else None if tree is None else json.dumps(tree, separators=(",", ":"))} if path else {}


def random_tree(draw, depth):
    kinds = [lambda: draw.randint(0, 9), lambda: draw.choice(["a", "false", ""]), lambda: None, lambda: [1, "x"], lambda: {}, lambda: draw.random() < 0.5]
    return {name: random_tree(draw, depth - 1) if depth and draw.random() < 0.5 else draw.choice(kinds)() for name in draw.sample("abcd", draw.randint(0, 3))}


def test_trees_are_merged_as_trees(spark):
    draw = random.Random(5)
    pairs = {i: (random_tree(draw, 3), random_tree(draw, 3)) for i in range(300)}
    pairs |= {1000: ({"a": {"b": 1, "c": 2}}, {"a": 5}), 1001: ({"a": 5}, {"a": {"b": 1}}), 1002: ({"a": {"b": 1}}, {"a": {}}), 1003: ({"a": 1}, {"a": {}}), 1004: ({"a": {}}, {"a": {"b": {"c": 1}}}), 1005: ({"a": {"b": 1}}, {"a": None})}
    table = lambda at: spark.createDataFrame([(i, json.dumps(p[at])) for i, p in pairs.items()], "condo_id int, tree string")
    got: dict = {i: {} for i in pairs}
    for r in configured.merged(configured.leaves(table(0)), configured.leaves(table(1))).collect():
        assert r["path"] not in got[r["condo_id"]]
        got[r["condo_id"]][r["path"]] = r["value"]
    assert got == {i: leaves(merge(*p)) for i, p in pairs.items()}
    alone = configured.merged(configured.leaves(table(0)), configured.leaves(table(1).limit(0)))
    assert alone.count() == sum(len(leaves(p[0])) for p in pairs.values())


def settings(spark, trees):
    return configured.settings_of(configured.leaves(spark.createDataFrame([(i, json.dumps(t)) for i, t in trees.items()], "condo_id int, tree string")))


def test_buildings_have_their_own_limits(spark):
    own = settings(spark, {1: {"category_variation": {}}, 2: {"category_variation": {"min": 5000}}, 3: {"continuity": False}, 4: {"category_variation": None}})
    states = spark.createDataFrame([(i, "2024-02-01", i != 5, None) for i in range(1, 6)], "condo_id int, month string, has_entries boolean, income_reason string")
    states = states.withColumn("month", F.to_date("month")).withColumn("has_income", F.col("condo_id") != 3).withColumn("has_yield", F.lit(True))
    stable = states.filter("condo_id = 1").select("condo_id", "month")
    applied = configured.status(states, own, stable)
    why = {(r["condo_id"], r["rule"]): (r["applied"], r["reason"]) for r in applied.collect()}
    assert len(why) == 5 * len(configured.RULES) and len(configured.RULES) >= 20
    assert why[1, "R4"] == (True, None) == why[2, "R4"] and why[3, "R4"] == (False, "not configured") == why[4, "R4"] and why[5, "R4"] == (False, "not in the file")
    assert why[3, "R9"] == (False, "not configured") and why[1, "R9"] == (True, None) and why[3, "R1"] == (False, "not in the file") and why[1, "G1"] == (False, "not configured")
    moved = spark.createDataFrame([(i, "2024-02-01", "t", "c", 6000.0, m, 100.0) for i in range(1, 6) for m in (1500.0, 5500.0)], "condo_id int, month string, type string, subject string, amount double, moved double, previous double")
    got = configured.configured_findings({"R4": moved.withColumn("month", F.to_date("month"))}, applied, own)
    assert sorted((r["condo_id"], r["finding_id"]) for r in got.collect()) == [(1, "RG-0001"), (1, "RG-0002"), (2, "RG-0001")]


def test_all_mutations_surface(spark):
    """A sound month has none of the findings; each fault put into it has its own."""
    sound = [("2024-03-01", 1, 500.0, "ZELADORIA OK", "servico PARC 2/7", "PORTARIA"), ("2024-03-01", 2, 900.0, "LUZ E FORCA", "conta do mes", "LUZ")]

    def faults(rows):
        df = entry_rows(spark, rows).withColumn("inst_n", F.regexp_extract("description", r"PARC (\d+)/", 1).try_cast("int")).withColumn("inst_total", F.when(F.col("inst_n").isNotNull(), 7))
        return identified.unidentified(df).count(), rules.installments_same_month(df).count()

    assert faults(sound) == (0, 0)
    assert faults([*sound, ("2024-03-01", 3, 10.0, None, "", "X")]) == (1, 0)
    assert faults([*sound, ("2024-03-01", 3, 500.0, "ZELADORIA OK", "servico PARC 3/7", "PORTARIA")]) == (0, 1)
    income = spark.createDataFrame([(1, "2024-03-01", "A", "RECEITA TESTE", -10.0), (1, "2024-03-01", "A", "RESGATE APLICACAO", -10.0), (1, "2024-03-01", "A", "ESTORNO DE APLICACAO", -3.0)], "condo_id int, month string, account string, description string, amount double")
    assert sorted(r["description"] for r in rules.negative_income(income.withColumn("month", F.to_date("month"))).collect()) == ["ESTORNO DE APLICACAO", "RECEITA TESTE"]

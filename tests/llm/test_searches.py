"""Run detection and the two searches against plain versions."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import catalog, collision_search, lexical_search, periodic_runs
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def views(tables, folder=DIR):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def same_as_sql(spark, name, tables, key):
    want = views(tables).execute(catalog.oracle_sql()[name]).df().sort_values(key).reset_index(drop=True)
    got = catalog.queries()[name](spark, DIR).toPandas().sort_values(key).reset_index(drop=True)
    assert len(got) == len(want) > 0
    for column in want.columns:
        assert got[column].fillna(-1).tolist() == want[column].fillna(-1).tolist(), column


def test_runs_of_random_words():
    draw = np.random.default_rng(11)
    texts = []
    for n in draw.integers(0, 60, 1500):
        words = draw.integers(0, draw.integers(1, 4), n)
        if n > 8 and draw.random() < 0.5:
            s, p = draw.integers(0, n // 2), draw.integers(1, n // 4 + 1)
            words[s:] = words[s + np.arange(n - s) % p]
        texts.append([b"%d" % w for w in words])
    offsets, found, _ = periodic_runs.search(texts)
    want = [(o + s, n, q) for text, o in zip(texts, offsets.tolist(), strict=True) for s, n, q in brute.periodic_runs(text)]
    assert list(zip(*(x.tolist() for x in found), strict=True)) == want and len(want) > 500


def test_runs_of_awkward_documents(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (5, "a a a a a"), (6, "x a b a b a b a b\ta\x0bb y"), (7, "é é " * 6),
        (8, long), (None, "b b b b b b"), (4, "a a a a a a"), (9, "a b c a b c a b c a b d d d d d d d"), (10, "A a A a A a"),
    ]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        found = brute.periodic_runs(words) if t != long else [(0, 60_000, 9973)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(words), found, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert got == sorted(want, key=str)
    digest = {r["doc_id"]: r for r in periodic_runs.digest(periodic_runs.find_runs(df)).collect()}
    assert tuple(digest[1])[1:] == (0, None, None, None, None, sha(""), sha(""))
    assert tuple(digest[6])[1:] == (1, 1, 10, 2, 5000, sha("1,10,2\n"), sha("x a b y"))
    assert periodic_runs.digest(periodic_runs.find_runs(df.limit(0))).count() == 0


def test_runs_same_as_sql(spark):
    same_as_sql(spark, "op11_periodic_runs", ["documents"], ["doc_id"])


@pytest.mark.parametrize(("pairs", "cells"), [(lexical_search.PAIRS, lexical_search.CELLS), (40, 640)])  # one group and block, or many
def test_lexical_search(spark, monkeypatch, pairs, cells):
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    draw = np.random.default_rng(12)
    word = lambda: f"W{min(draw.zipf(1.3), 400)}"
    docs = [(i, " ".join(word() for _ in range(draw.integers(1, 80)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "!? --"), (None, "rare W1 w2"), (403, "rare W1 w2"), (404, "rare W1 w2"), (404, "rare W1 w2"), (405, "w1 " * 20_000 + "rare"), (406, "\u00c9t\u00e9 x-Y_z")]
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "rare rare W1"), (24, "w1"), (25, "\u00c9T\u00c9 \u00c9t\u00e9 y"), (None, "w2 w3"), (3, "w5 rare")]
    left = spark.createDataFrame([(i, t, 5, 1.0) for i, t in docs], "doc_id long, text string, n int, score double").repartition(3)
    right = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, rank string").repartition(2)
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in lexical_search.search(left, right).collect()}
    assert got == brute.ranked(docs, items) and (22, 1) not in got and got[25, 1][0] == 406
    assert lexical_search.search(left.limit(0), right).count() == 0 == lexical_search.search(left, right.limit(0)).count()


def test_best_positions_stop_early():
    draw = np.random.default_rng(5)
    owner, term = np.repeat(np.arange(5000), 3), np.tile(np.arange(3), 5000)
    impact = draw.integers(1, 1000, (5000, 3))
    impact[:20] += 5000  # twenty documents far ahead in every list
    block = lexical_search.Block(owner, term, impact.ravel(), 5000, 3)
    docs, scores = block.best(np.arange(3), np.array([3, 2, 1]), 10, np.zeros(0, np.int64))
    want = np.sort(impact @ [3, 2, 1])[-10:]
    assert sorted(scores.tolist())[-10:] == want.tolist() and block.read < 200
    flat = lexical_search.Block(owner, term, np.full(15_000, 7), 5000, 3)  # all alike: a stop below the k-th would lose ties
    assert len(flat.best(np.arange(3), np.ones(3, np.int64), 10, np.zeros(0, np.int64))[0]) == 5000


def test_lexical_search_same_as_sql(spark):
    same_as_sql(spark, "op12_lexical_search", ["documents", "benchmark"], ["item_id", "rank"])


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize(("shard", "queries", "together"), [(collision_search.SHARD, collision_search.QUERIES, collision_search.TOGETHER), (40, 3, 2)])  # one shard, or many
def test_collision_search(spark, monkeypatch, shard, queries, together):
    for name, value in (("SHARD", shard), ("QUERIES", queries), ("TOGETHER", together)):
        monkeypatch.setattr(collision_search, name, value)
    draw = np.random.default_rng(13)
    centres = draw.standard_normal((8, 12)) * 4
    rows = [(i, (centres[i % 8] + draw.standard_normal(12)).tolist()) for i in range(1, 400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # copies: ties of distance 0
    rows += [(500, None), (510, [0.0] * 12), (520, [float("nan")] * 12), (530, []), (540, [1.0, 2.0]), (541, [2.0, 1.0]), (550, [None] * 12), (None, rows[0][1]), (560, [1e200] * 12), (570, [1e-200] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("r")).withColumn("rank", F.lit(1)).repartition(3)
    got = found(collision_search.search(df, every=10))
    want = brute.nearest(rows, {i for i, _ in rows if i is not None and i % 10 == 0})
    assert got == want and got[540, 1][0] == 541 and (540, 2) not in got and [got[400, r][0] for r in range(1, 4)] == [1, 401, 402]
    assert collision_search.search(df.limit(0)).count() == 0
    twice = found(collision_search.search(df.filter("vec_id = 10").unionByName(df.filter("vec_id = 10"))))
    assert twice == {}  # 10 is no multiple of 100
    assert found(collision_search.search(df.filter("vec_id = 540").unionByName(df.filter("vec_id = 540")), every=10)) == {(540, 1): (540, 0.0)}


def test_collision_search_recall_and_work():
    draw = np.random.default_rng(7)
    vectors = np.repeat(draw.standard_normal((40, 32)) * 10, 100, axis=0) + draw.standard_normal((4000, 32))
    m, least = collision_search.plan(1e-5)
    shard = collision_search.Shard(vectors, np.arange(4000), np.arange(4000), m, least, 13)
    asked = np.arange(0, 4000, 100)
    best = shard.nearest(vectors[asked], asked, 10, np.full(40, np.inf))
    right = 0
    for q, (places, _) in zip(asked, best, strict=True):
        far = collision_search.distances(vectors, vectors[q])
        far[q] = np.inf
        right += len(set(places) & set(np.argsort(far)[:10]))
    assert right >= 0.99 * 400 and shard.verified < 0.05 * 40 * 4000  # of 40 clusters a query verifies little more than its own


def test_collision_search_same_as_sql(spark):
    same_as_sql(spark, "op13_collision_search", ["embeddings"], ["query_id", "rank"])

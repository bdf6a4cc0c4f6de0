"""Approximate nearest neighbours by collision counting over sorted projections, centred on the query.

The rows are dealt into shards of bounded size. A shard's index is one sorted array for each random projection; a query opens
a window round its own projection in each array, and each vector inside counts a collision. Windows grow by virtual rehashing
(their width is in proportion to the search radius, which grows by a factor); a vector that has collided in enough
projections is verified by its exact distance. A query is through in a shard once its k-th nearest lies within the radius:
whatever is nearer has then been counted, but for the chance that ``plan`` bounds.

Each query is searched in one shard first. Its k-th distance there bounds what the other shards can add, so they look no
further than that. A task holds a shard and a block of queries, whatever the table's size; queries x shards rows travel, each
with k results at most. No list of pairs is made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import materialize

#: Vectors in a shard, and queries beside it, about.
SHARD, QUERIES = 16_384, 4_096
#: Half a window's width for a radius of 1: a vector at the radius collides in a projection with probability 0.83.
HALF = 1.36
#: By how much the radius grows from round to round.
GROWTH = 2.0
#: Queries that a task takes on at once.
TOGETHER = 256


def plan(miss: float, share: float = 0.6) -> tuple[int, int]:
    """(projections, collisions that make a candidate): at the radius a vector is missed with probability ``miss`` at most.

    ``share`` lies below the chance of a collision at the radius (0.83) and above that at twice the radius (0.50), so that
    most vectors beyond 1.6 times the radius aren't verified.
    """
    chance = math.erf(HALF / math.sqrt(2))
    m = 8
    while True:
        least = math.ceil(share * m)
        if sum(math.comb(m, i) * chance**i * (1 - chance) ** (m - i) for i in range(least)) <= miss:
            return m, least
        m += 4


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the components (as a plain loop does)."""
    total = np.zeros(len(vectors))
    with np.errstate(over="ignore"):  # squares beyond the doubles are infinite
        for i in range(vectors.shape[1]):
            step = vectors[:, i] - query[i]
            total += step * step
    return np.sqrt(total)


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, m: int, least: int, seed: int):
        self.vectors, self.ids, self.rows, self.least = vectors, ids, rows, least
        self.scale = np.abs(vectors).max(initial=0) or 1.0  # so that projections of huge or tiny components stay finite
        self.planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], m))
        values = (vectors / self.scale) @ self.planes
        order = np.argsort(values, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(values, order, axis=0).T)
        self.verified = 0

    def nearest(self, queries: np.ndarray, rows: np.ndarray, k: int, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, distances) of its k nearest but the row it is, or of those within its bound.

        All queries go on together, a round at a time: only the searches in the sorted arrays are shared.
        """
        m, n = self.values.shape
        centre = (queries / self.scale) @ self.planes
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centre.T, strict=True)], 1)
        # where the projections hold k vectors to a side, there is nothing to find below about this radius
        sides = np.stack([np.maximum(v[np.minimum(x + k, n - 1)] - c, c - v[np.maximum(x - k, 0)]) for v, x, c in zip(self.values, low.T, centre.T, strict=True)])
        radius = np.where(np.isfinite(bounds), bounds / self.scale, np.maximum(np.median(sides, axis=0) / HALF, 1e-12))
        high, count, taken = low.copy(), np.zeros((len(queries), n), np.int16), np.zeros((len(queries), n), bool)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        taken |= self.rows == rows[:, None]
        active = np.arange(len(queries))
        while len(active):
            reach = radius[active] * HALF
            new_low = np.stack([np.searchsorted(v, c - reach, "left") for v, c in zip(self.values, centre[active].T, strict=True)], 1)
            new_high = np.stack([np.searchsorted(v, c + reach, "right") for v, c in zip(self.values, centre[active].T, strict=True)], 1)
            new_low, new_high = np.minimum(new_low, low[active]), np.maximum(new_high, high[active])
            on = []
            for j, q in enumerate(active.tolist()):
                spans = [*zip(range(m), new_low[j].tolist(), low[q].tolist(), strict=True), *zip(range(m), high[q].tolist(), new_high[j].tolist(), strict=True)]
                count[q] += np.bincount(np.concatenate([self.order[i, a:b] for i, a, b in spans]), minlength=n).astype(np.int16)
                new = np.flatnonzero((count[q] >= self.least) & ~taken[q])
                taken[q, new] = True
                self.verified += len(new)
                if len(new):
                    places, found = np.concatenate([best[q][0], new]), np.concatenate([best[q][1], distances(self.vectors[new], queries[q])])
                    first = np.lexsort((self.rows[places], self.ids[places], found))[:k]
                    best[q] = places[first], found[first]
                found = best[q][1]
                if len(found) == k and found[-1] <= radius[q] * self.scale or np.isfinite(bounds[q]) or (new_low[j] == 0).all() and (new_high[j] == n).all():
                    continue
                # k verified vectors bound the radius that is left to look at
                radius[q] = max(radius[q], min(GROWTH * radius[q], found[-1] / self.scale * (1 + 1e-9) if len(found) == k else np.inf))
                on.append(q)
            low[active], high[active] = new_low, new_high
            active = np.array(on, np.int64)
        return best


def search_shard(k: int, m: int, least: int, seed: int):
    """For a cogroup of queries and vectors: (query, query_row, vec_id, row, score)."""

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            shard = shard.sort_values("row", kind="stable")
            index = Shard(np.vstack(shard["vec"].to_numpy()).astype(np.float64), shard["vec_id"].to_numpy(), shard["row"].to_numpy(), m, least, seed)
            for first in range(0, len(queries), TOGETHER):
                some = queries.iloc[first : first + TOGETHER]
                best = index.nearest(np.vstack(some["vec"].to_numpy()).astype(np.float64), some["row"].to_numpy(), k, some["bound"].to_numpy())
                for query, row, (places, found) in zip(some["vec_id"], some["row"], best, strict=True):
                    out.append(pd.DataFrame({"query_id": query, "query_row": row, "vec_id": index.ids[places], "row": index.rows[places], "score": found}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []})

    return run


def search(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-5, seed: int = 13
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row whose id is divisible by ``every``, but itself.

    Nearness is the Euclidean distance in double precision between vectors of one length, equal ones by ascending id. A row
    among the nearest is missed with probability ``miss`` at most. Null and empty vectors, zero ones, those with null or
    non-finite components and rows with a null id take no part. Rows that share an id are rows (and queries) of their own,
    equal vectors all count. Fewer rows give fewer results, an empty table none; other columns are ignored.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # distances are in double precision either way
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"))
    rows = rows.filter("vec_id is not null and vec is not null").filter(~F.coalesce(F.exists("vec", odd), F.lit(True)) & F.exists("vec", lambda x: x != 0))
    # numbered before the write, so that a task run again deals the same rows out
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")
    asked = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(asked)).first()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n_queries / QUERIES))
    place = lambda salt, count: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    stored = rows.withColumn("shard", place(1, shards))
    queries = rows.filter(asked).withColumn("block", place(2, blocks)).withColumn("home", place(3, shards))
    key = ["dim", "shard", "block"]
    m, least = plan(miss)
    schema = "query_id long, query_row long, vec_id long, row long, score double"

    def look(some: DataFrame) -> DataFrame:
        copies = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        names = [*key, "vec_id", "row", "vec", "bound"]
        left = some.select(*names).toDF(*names)  # columns of their own, as both sides come from one table
        return left.groupBy(*key).cogroup(copies.select(*key, "vec_id", "row", "vec").groupBy(*key)).applyInPandas(search_shard(k, m, least, seed), schema)

    near = materialize(look(queries.withColumn("shard", F.col("home")).withColumn("bound", F.lit(float("inf")))), "near")
    if shards > 1:
        bounds = near.groupBy("query_row").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
        other = queries.join(bounds, queries["row"] == bounds["query_row"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        near = near.unionByName(look(other.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")))
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class with a count. In each table a class falls into the bucket of its signs; pairs inside a bucket
are compared by one matrix product per block pair, and only sums per class and one spanning edge per class leave a task, so
no list of pairs is ever made. A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize
from tally.llm.components import connected_components

#: Classes in a block: what one task holds of one bucket.
BLOCK = 1024


def plan_tables(n: int, threshold: float, recall: float, bucket: int = 256) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` classes, tables enough for ``recall`` at the very threshold."""
    bits = min(48, max(6, math.ceil(math.log2(max(n, 2) / bucket))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def signatures(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``classes`` (rep, copies, dim, vec) with ``keys``: one sign pattern per table, as ints where the bits fit."""
    kind, schema = (np.int32, "array<int>") if bits < 32 else (np.int64, "array<long>")
    vec = dict(classes.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            flat, offsets = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(dims)])
            keys = np.zeros((batch.num_rows, tables), kind)
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                rows = np.flatnonzero(dims == dim)
                own = flat[offsets[rows][:, None] + np.arange(dim)]
                signs = (own @ planes[dim] > 0).reshape(len(rows), tables, bits)
                keys[rows] = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "dim", "vec")), lists], ["rep", "copies", "dim", "vec", "keys"])

    return classes.select("rep", "copies", "dim", "vec").mapInArrow(run, f"rep long, copies long, dim int, vec {vec}, keys {schema}")


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of nodes 0..n-1 joined by left-right, the least node that each reaches."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[left], low[right])
        new = low.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links_in_bucket(threshold: float):
    """For applyInPandas on one block pair of one bucket: (rep, links, root) of the classes that link there."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table, lower, upper = int(group["table"].iloc[0]), int(group["low"].iloc[0]), int(group["high"].iloc[0])
        group = group.sort_values("rep", kind="stable").reset_index(drop=True)
        vectors = np.vstack(group["vec"].to_numpy()).astype(np.float64)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # the squares of huge or tiny components stay finite
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        keys, own = np.vstack(group["keys"].to_numpy()), group["own"].to_numpy()
        one, two = np.flatnonzero(own == lower), np.flatnonzero(own == upper)
        i, j = np.nonzero(vectors[one] @ vectors[two].T >= threshold)
        i, j = one[i], two[j]
        if lower == upper:
            i, j = i[i < j], j[i < j]
        if table:
            first = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            root = spanning(len(group), i, j)
            i, j = i[first], j[first]
        else:
            root = spanning(len(group), i, j)
        copies = group["copies"].to_numpy()
        links = np.zeros(len(group), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        reps = group["rep"].to_numpy()
        out = pd.DataFrame({"rep": reps, "links": links, "root": reps[root]})
        return out[(out["links"] > 0) | (out["root"] != out["rep"])]

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.999, seed: int = 17
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Links join vectors of one length with a cosine of ``threshold`` or more, found with probability ``recall`` at the
    threshold and higher above it. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null id, link with nothing (null ids keep a null component and are kept). Rows that repeat an id count as vectors of
    their own with that id. An empty table gives no rows; other columns are ignored.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # cosines are in double precision either way
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(F.exists("vec", odd), F.lit(True)) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(usable, F.col("vec")))
    classes = materialize(rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")), "classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signed = materialize(signatures(classes, bits, tables, seed), "signed")
    place = ["dim", "table", "key"]
    sizes = signed.select("dim", F.posexplode("keys").alias("table", "key")).groupBy(*place).agg(F.count("*").alias("size")).filter("size > 1")
    members = signed.select("rep", "copies", "dim", "vec", "keys", F.posexplode("keys").alias("table", "key")).join(sizes, place)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    found = materialize(
        members.select(*place, "low", "high", "own", "rep", "copies", "vec", "keys").groupBy(*place, "low", "high").applyInPandas(links_in_bucket(threshold), "rep long, links long, root long"), "links"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    by_class = classes.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select(F.col("vec").alias("class_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(by_class, F.col("vec") == F.col("class_vec"), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))

"""Shared folder, intermediate tables and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside joins.
NULL_ID = -(2**63) + 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a new folder; on a cluster that is an error, as a local folder would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns can't clash with ours."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_held_out(doc_id) -> F.Column:
    """The fourth of all documents that is never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def string_chunks(values: pa.Array, most: int = 2_000_000) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (row, UTF-8 bytes) with about ``most`` bytes each; null is empty."""
    chunk, size = [], 0
    for row, value in enumerate(values):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        chunk.append((row, raw))
        size += len(raw)
        if size >= most:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit hashes (xor, shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

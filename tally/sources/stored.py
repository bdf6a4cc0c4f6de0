"""Ledger tables written once for a session and read from there by every rule, so that a join isn't repeated for each of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: (application, folder of the tables, table) -> path; entries of other applications are never read.
_WRITTEN: dict[tuple[str, str, str], str] = {}
#: Rows in a file: a table that few tasks wrote is still read by many.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a local session without one gets a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _key(table: Callable, spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, sf_dir, f"{table.__module__}.{table.__name__}"


def stored(table: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``table`` written as Parquet when a session first asks for it, and read back after that.

    The tables under a folder must not change while a session reads them.
    """

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = _key(table, spark, sf_dir)
        if key not in _WRITTEN:
            path = f"{shared_dir(spark)}/ledger-{table.__name__}-{uuid.uuid4().hex}"
            table(spark, sf_dir).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
            _WRITTEN[key] = path
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            del _WRITTEN[key]  # the shared folder was cleaned meanwhile
            return read(spark, sf_dir)

    read.__name__, read.__doc__, read.table = table.__name__, table.__doc__, table
    return read


def at_hand(table: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table`` as the session has written it, or worked out where it hasn't: nothing is written for a table that is only passed through."""
    made = getattr(table, "table", table)
    return stored(made)(spark, sf_dir) if _key(made, spark, sf_dir) in _WRITTEN else made(spark, sf_dir)

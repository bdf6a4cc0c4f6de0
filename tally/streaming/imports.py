"""Import status, versions and re-validation from streams of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.operators.dashboards import last_import

KEYS = ["condo_id", "month"]


def latest_status(imports: DataFrame, late: str = "31 days") -> DataFrame:
    """T2, T3 over a stream or a table of imports: an event counts once within ``late``, and the newest one of a building wins even
    when an older one arrives after it. As a stream, its state is one row for each building and the ids seen within ``late``."""
    rows = imports.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if imports.isStreaming else rows.dropDuplicates(["event_id"])
    return last_import(rows)


def status_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """The newest import per building over Parquet files (columns of ``imports``) that arrive in ``folder``; each batch's changes
    go to a folder ``batch=N`` of ``out``, written whole again if a batch is repeated."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    changes = latest_status(spark.readStream.schema(schema).parquet(folder))
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COMMITS = "_commits"


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """(condo_id, month, version, run) of every committed run, None before the first."""
    try:
        return spark.read.parquet(f"{folder}/{COMMITS}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


def write_versioned(rows: DataFrame, folder: str, covered: DataFrame | None = None, run: str | None = None) -> None:
    """``rows`` as a new version of each building and month of ``covered`` (default: those that have rows), one above the highest
    committed there; earlier versions stay.

    The rows go to a folder of their own and count once the run's commit is written, a single file with a row for each covered
    key, so that a key without rows has an empty newest version. A ``run`` that is committed already isn't written again; one
    that broke off before its commit is written anew. Of two runs that take the same number at once the one of the greater
    name counts, whole.
    """
    spark, run = rows.sparkSession, run or uuid.uuid4().hex
    before = commits(spark, folder)
    if before is not None and not before.filter(F.col("run") == run).isEmpty():
        return
    rows.write.mode("overwrite").parquet(f"{folder}/run={run}")
    keys = (rows if covered is None else covered).select(*KEYS).distinct()
    last = keys.withColumn("last", F.lit(0)) if before is None else keys.join(before.groupBy(*KEYS).agg(F.max("version").alias("last")), KEYS, "left")
    numbered = last.select(*KEYS, (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.lit(run).alias("run"))
    numbered.coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each building and month's newest version, with its number; a key whose newest version is empty has none."""
    newest = commits(spark, folder).groupBy(*KEYS).agg(F.max(F.struct("version", "run")).alias("newest")).select(*KEYS, "newest.*")
    return spark.read.parquet(folder).join(newest, [*KEYS, "run"]).drop("run")


def affected(changed: DataFrame, months: int = 6) -> DataFrame:
    """The (condo_id, month) that a changed statement touches: itself and the months that have it in their history."""
    return changed.select(*KEYS).distinct().withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(months)))).select("condo_id", F.expr("add_months(month, ahead)").alias("month")).distinct()


def revalidation_stream(spark: SparkSession, folder: str, schema, ledger: Callable[[SparkSession], DataFrame], rule: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """For statement rows that arrive in ``folder``, ``rule`` over the buildings they name, written as a new version for the months
    that they touch and that the ledger has, and for the changed months themselves; months without findings get an empty one.

    A run is a batch of this query: a repeated batch is written once, and a query with a new checkpoint adds versions.
    """

    def run(changed: DataFrame, batch: int) -> None:
        own = changed.sparkSession
        rows, name = ledger(own), own.sparkContext.getLocalProperty("sql.streaming.queryId")
        named = rows.select(*KEYS).unionByName(changed.select(*KEYS)).distinct()
        keys = affected(changed).join(named, KEYS, "left_semi")
        found = rule(rows.join(keys.select("condo_id").distinct(), "condo_id", "left_semi"))
        write_versioned(found.join(keys, KEYS, "left_semi"), out, keys, f"{name}-{batch}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_findings(findings: DataFrame, folder: str) -> None:
    """Findings as JSON by month, and their counts by type as CSV."""
    findings.withColumn("m", F.date_format("month", "yyyy-MM")).write.mode("overwrite").partitionBy("m").json(f"{folder}/findings")
    findings.groupBy("type").agg(F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


def write_reviews(reviews: DataFrame, folder: str) -> None:
    """Reviewed findings as JSON by month, with null fields left out."""
    reviews.withColumn("m", F.date_format("month", "yyyy-MM")).write.mode("overwrite").partitionBy("m").json(f"{folder}/reviews")


def write_audit(faults: DataFrame, folder: str) -> None:
    """An audit's faults (condo_id, month, severity, check, message) as text, a line for each, and as JSON lines."""
    line = F.format_string("%s %s [%s] %s: %s", F.col("condo_id").cast("string"), F.date_format("month", "yyyy-MM"), F.upper("severity"), F.col("check"), F.coalesce("message", F.lit("")))
    lines = faults.sort("condo_id", "month", "check")
    lines.select(F.regexp_replace(line, r"\s+", " ").alias("value")).write.mode("overwrite").text(f"{folder}/audit")
    lines.write.mode("overwrite").json(f"{folder}/audit_rows")

"""Streams of imports and statements, versions and sinks."""

from pyspark.sql import functions as F

from tally.operators import checks
from tally.streaming import imports

EVENTS = "event_id long, ts timestamp, condo_id int, status string"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, condo_id int, status string").withColumn("ts", F.to_timestamp("ts"))


def test_status_stream_with_late_and_repeated_events(spark, tmp_path):
    out, mark, folder = (str(tmp_path / x) for x in ("out", "mark", "in"))

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        imports.status_stream(spark, folder, EVENTS, out, mark).awaitTermination()

    run([(1, "2024-03-01", 1, "warning"), (2, "2024-03-05", 1, "success"), (3, "2024-03-05", 2, "error")])
    run([(2, "2024-03-05", 1, "success"), (4, "2024-03-02", 1, "error"), (5, "2024-03-09", 2, "success")])  # repeated, late, new
    got = spark.read.parquet(out)
    last = got.join(got.groupBy("condo_id").agg(F.max("batch").alias("batch")), ["condo_id", "batch"])
    assert sorted((r["condo_id"], r["event_id"], r["status"], r["imports"]) for r in last.collect()) == [(1, 2, "success", 3), (2, 5, "success", 2)]
    table = imports.latest_status(events(spark, [(1, "2024-03-01", 1, "warning"), (2, "2024-03-05", 1, "success"), (2, "2024-03-05", 1, "success"), (4, "2024-03-02", 1, "error")]))
    assert [tuple(r) for r in table.collect()] == [(1, 2, "success", 3)]


def entries(spark, rows):
    return spark.createDataFrame(rows, "condo_id int, month string, code string, amount double").withColumn("month", F.to_date("month"))


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "versions")
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "a", 1.0), (2, "2024-01-01", "b", 2.0)]), folder)
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "a", 9.0)]), folder)
    assert sorted((r["condo_id"], r["version"], r["amount"]) for r in imports.read_latest(spark, folder).collect()) == [(1, 2, 9.0), (2, 1, 2.0)]
    assert spark.read.parquet(folder).count() == 3


def test_revalidation(spark, tmp_path):
    out, mark, folder = (str(tmp_path / x) for x in ("out", "mark", "in"))
    ledger = entries(spark, [(1, "2024-01-01", "a", 1.0), (1, "2024-01-01", "a", 1.0), (1, "2024-05-01", "c", 2.0), (1, "2024-05-01", "c", 2.0), (1, "2024-09-01", "d", 2.0), (1, "2024-09-01", "d", 2.0), (2, "2024-01-01", "b", 1.0), (2, "2024-01-01", "b", 1.0)])
    spark.createDataFrame([(1, "2024-01-01")], "condo_id int, month string").withColumn("month", F.to_date("month")).write.parquet(folder)
    imports.revalidation_stream(spark, folder, "condo_id int, month date", lambda s: ledger, checks.duplicate_codes, out, mark).awaitTermination()
    assert sorted((r["condo_id"], r["code"], r["version"]) for r in imports.read_latest(spark, out).collect()) == [(1, "a", 1), (1, "c", 1)]


def test_sinks(spark, tmp_path):
    found = entries(spark, [(1, "2024-01-01", "a", 1.0), (1, "2024-02-01", "a", 1.0)]).withColumn("type", F.lit("duplicate"))
    imports.write_findings(found, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/findings").count() == 2
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/summary").collect()] == [("duplicate", "2")]


def test_corrected_months_versions_and_restarts(spark, tmp_path):
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    twice = entries(spark, [(1, "2024-01-01", "a", 1.0), (1, "2024-01-01", "a", 1.0), (1, "2024-02-01", "b", 1.0)])
    once = entries(spark, [(1, "2024-01-01", "a", 1.0), (1, "2024-02-01", "b", 1.0)])

    def arrive(ledger, mark, n):
        spark.createDataFrame([(1, "2024-01-01")], "condo_id int, month string").withColumn("month", F.to_date("month")).coalesce(1).write.mode("append").parquet(folder)
        imports.revalidation_stream(spark, folder, "condo_id int, month date", lambda s: ledger, checks.duplicate_codes, out, str(tmp_path / mark)).awaitTermination()
        versions = {str(r["month"]): r["v"] for r in imports.commits(spark, out).groupBy("month").agg(F.max("version").alias("v")).collect()}
        assert versions == {"2024-01-01": n, "2024-02-01": n}
        return [(r["code"], r["version"]) for r in imports.read_latest(spark, out).collect()]

    assert arrive(twice, "mark", 1) == [("a", 1)]
    assert arrive(once, "mark", 2) == []  # corrected: the newest version is empty
    assert arrive(twice, "other", 3) == [("a", 3)]  # a new checkpoint reads both files at once and goes on counting


def test_a_month_that_is_gone_and_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path / "versions")
    keys = entries(spark, [(1, "2024-01-01", "", 0.0), (1, "2024-02-01", "", 0.0)]).select("condo_id", "month")
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "a", 1.0), (1, "2024-02-01", "b", 2.0)]), folder, run="q-0")
    none = entries(spark, [(1, "2024-01-01", "a", 1.0)]).limit(0)
    imports.write_versioned(none, folder, keys, "q-1")
    assert imports.read_latest(spark, folder).count() == 0 and spark.read.parquet(folder).count() == 2
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "x", 9.0)]), folder, keys, "q-1")  # committed before: not written again
    assert imports.read_latest(spark, folder).count() == 0
    entries(spark, [(1, "2024-01-01", "half", 9.0)]).write.parquet(f"{folder}/run=q-2")  # broke off before its commit
    assert imports.read_latest(spark, folder).count() == 0
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "c", 3.0)]), folder, run="q-2")
    assert [(r["code"], r["version"]) for r in imports.read_latest(spark, folder).collect()] == [("c", 3)]


def test_two_writers_at_once(spark, tmp_path):
    folder = str(tmp_path / "versions")
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "a", 1.0)]), folder, run="first")
    seen = imports.commits(spark, folder)
    for run, code in (("w1", "x"), ("w2", "y")):  # both saw version 1
        entries(spark, [(1, "2024-01-01", code, 1.0), (1, "2024-01-01", code + code, 1.0)]).write.parquet(f"{folder}/run={run}")
        seen.limit(1).select("condo_id", "month", F.lit(2).alias("version"), F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/_commits")
    assert sorted((r["code"], r["version"]) for r in imports.read_latest(spark, folder).collect()) == [("y", 2), ("yy", 2)]
    imports.write_versioned(entries(spark, [(1, "2024-01-01", "z", 1.0)]), folder)
    assert [(r["code"], r["version"]) for r in imports.read_latest(spark, folder).collect()] == [("z", 3)]


def test_reviews_and_audit_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01", "high", "closing", "does not\nclose"), (2, "2024-02-01", "info", "sum", None)], "condo_id int, month string, severity string, check string, message string").withColumn("month", F.to_date("month"))
    imports.write_reviews(rows, str(tmp_path))
    imports.write_audit(rows, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/reviews").count() == 2 == spark.read.json(f"{tmp_path}/audit_rows").count()
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/audit").collect()) == ["1 2024-01 [HIGH] closing: does not close", "2 2024-02 [INFO] sum: "]

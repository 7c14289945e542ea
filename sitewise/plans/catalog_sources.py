"""Queries over files that Spark first writes from the tables: CSV, damaged CSV, runs, stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import clients
from sitewise.plans import fixtures as fx
from sitewise.plans.catalog_cohort import r6
from sitewise.plans.registry import query
from sitewise.session import scratch_path
from sitewise.sources import audit, sinks, tables
from sitewise.streaming import hourly

_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}


def _csv_copy(spark, sf, name, gz=False):
    path = scratch_path(spark, name)
    w = fx.table(spark, sf, name).write.option("header", True)
    (w.option("compression", "gzip") if gz else w).csv(path)
    return path


@query("scan_csv", "SELECT event_id, event_type, value FROM events")
def scan_csv(spark, sf):
    path = _csv_copy(spark, sf, "events", gz=True)
    return tables.read_csv(spark, path, {"event_id": "bigint", "value": "double"}).select("event_id", "event_type", "value")


@query("scan_typed", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def scan_typed(spark, sf):
    return tables.read_csv(spark, _csv_copy(spark, sf, "orders"), _ORDER_TYPES)


def _damaged(spark, sf):
    """orders as CSV text in which every row of status P lost its last two fields."""
    o = fx.table(spark, sf, "orders")
    whole = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in whole])
    cut = F.concat_ws(",", *[F.col(c).cast("string") for c in whole[:3]])
    # Spark's CSV reader takes the first line of every file as the header
    path = scratch_path(spark, "damaged")
    text = o.select(F.when(F.col("o_orderstatus") == "P", cut).otherwise(line).alias(",".join(whole)))
    text.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return path


@query("scan_quarantine", """
    SELECT 'good' AS kind, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'rejected', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'""")
def scan_quarantine(spark, sf):
    good, bad = tables.read_csv_tolerant(spark, _damaged(spark, sf), {"o_custkey": "bigint", "o_totalprice": "double"})
    both = good.select(F.lit("good").alias("kind"), "o_custkey").unionByName(
        bad.select(F.lit("rejected").alias("kind"), "o_custkey"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))


@query("dq_malformed_rows", """
    SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'P') AS n_malformed, 0 AS small FROM orders""")
def dq_malformed_rows(spark, sf):
    report = audit.file_report(spark, _damaged(spark, sf))      # one row for each file
    return report.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_malformed").alias("n_malformed"),
                      F.max("small").alias("small"))


@query("dq_gzip_audit", "SELECT true AS ok, count(*) AS n_rows FROM customer")
def dq_gzip_audit(spark, sf):
    path = _csv_copy(spark, sf, "customer", gz=True)
    _, files = tables._listing(path)
    gz = [f"{path}/{f}" for f in files if f.endswith(".gz")]
    report = audit.gzip_audit(spark, gz)
    return report.agg(F.min("ok").alias("ok"), F.sum(F.col("n_lines") - 1).alias("n_rows"))


@query("latest_run", """
    SELECT 'run_b' AS run, count(*) AS n_arms, round(sum(auprc), 4) AS total FROM (
        SELECT arm, round(avg(auprc), 6) AS auprc FROM fx_runs GROUP BY arm)""")
def latest_run(spark, sf):
    root = scratch_path(spark, "runs")
    runs = fx.runs(spark, sf).groupBy("arm").agg(F.round(F.avg("auprc"), 6).alias("auprc"))
    for run in ("run_a", "run_b"):
        sinks.write_result_csv(runs, f"{root}/{run}/results.csv")
    rows = tables.latest_run(spark, root, "results.csv").where("is_latest")
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n_arms"),
                                   F.round(F.sum(F.col("auprc").cast("double")), 4).alias("total"))


@query("assignment_roundtrip", "SELECT stay_id, client, split FROM fx_split")
def assignment_roundtrip(spark, sf):
    cohort = fx.stored_cohort(spark, sf)
    path = scratch_path(spark, "assignment")
    sinks.write_assignment(clients.grouped_split(clients.by_category(cohort, "unit", fx.MIN_CLIENT)), cohort, path)
    return sinks.read_assignment(spark, path, cohort)


@query("hourly_bins_stream", "SELECT stay_id, feature, hr, round(value, 6) AS value FROM fx_bins")
def hourly_bins_stream(spark, sf):
    # a file source reads folders, so the events go to a folder of their own first
    source, out, marks = (scratch_path(spark, n) for n in ("events", "bins", "marks"))
    fx.long_events(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    hourly.start_bins(stream, 24, out, marks, fx.WIDTH_H, once=True).awaitTermination()
    return hourly.read_bins(spark, out, fx.SUMS, fx.SWITCHES).withColumn("value", r6("value"))

"""The library's input shapes derived from the benchmark tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.scalars import hours_between, plus_hours
from sitewise.operators import clients, cohort, series
from sitewise.session import store

FEATURES = ("click", "view", "purchase", "error", "signup")
SUMS = ("purchase",)
SWITCHES = ("error", "signup")
STEPS, WIDTH_H = 4, 6
MIN_CLIENT = 150
# (condition, weight, code version, code prefix)
CODE_RULES = (("a", 1, 9, "ECONOMY"), ("b", 2, 10, "SMALL"), ("c", 3, 10, "PROMO1"),
              ("c", 3, 9, "PROMO2"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stays(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    died = F.col("o_orderstatus") == "F"
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_custkey").alias("subject_id"),
                (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("hadm_id"),
                F.col("o_orderkey").alias("stay_id"),
                F.when(F.col("o_orderpriority") == "1-URGENT", F.concat("r_name", F.lit("_URGENT")))
                .otherwise(F.col("n_name")).alias("unit"),
                F.col("o_orderdate").alias("intime"),
                (F.col("o_totalprice") / 120000.0).alias("los"),
                died.cast("int").alias("label"),
                F.when(died, plus_hours("o_orderdate", F.col("o_orderkey") % 240)).alias("deathtime"),
                F.col("o_orderpriority").alias("admission_type")))


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    return stays(spark, sf).groupBy("hadm_id").agg(
        F.min("subject_id").alias("subject_id"), F.min("intime").alias("admittime"),
        plus_hours(F.max("intime"), 48).alias("dischtime"), F.min("deathtime").alias("deathtime"),
        F.min("admission_type").alias("admission_type"), F.max("label").alias("label"))


def patients(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("subject_id"), F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
        (k % 80 + 10).alias("anchor_age"), F.lit(1995).alias("anchor_year"),
        F.concat(F.lit("G"), (k % 3).cast("string")).alias("year_group"))


def visit_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.build_cohort(stays(spark, sf).drop("label", "deathtime", "admission_type"),
                               admissions(spark, sf), patients(spark, sf))


def stored_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """The cohort as a stored table, for jobs that read it several times."""
    return store(visit_cohort(spark, sf), "cohort")


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("stay_id"), "user_id",
        F.col("ts").alias("charttime"), "event_type", "value")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One entity per user and day, starting at a user-specific hour."""
    day = F.date_trunc("day", "charttime").cast("timestamp_ntz")
    return raw_events(spark, sf).groupBy("stay_id").agg(
        F.min("user_id").alias("subject_id"),
        plus_hours(F.min(day), F.min("user_id") % 6).alias("intime"),
        (F.min("user_id") % 2).cast("int").alias("label"))


def long_events(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_trunc("day", "charttime").cast("timestamp_ntz")
    return raw_events(spark, sf).select(
        "stay_id", F.col("event_type").alias("feature"), "value",
        hours_between(day, F.col("charttime")).alias("hours_in"))


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return series.hourly_bins(long_events(spark, sf), 24, SUMS, SWITCHES, WIDTH_H)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    dense = series.binned_grid(long_events(spark, sf), sessions(spark, sf), FEATURES, STEPS * WIDTH_H, SUMS, SWITCHES, WIDTH_H, SWITCHES, packed=True)
    return series.fill_grid(dense, SWITCHES, steps=STEPS)


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .select((F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("hadm_id"),
                    F.concat(F.upper("p_type"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
                    .alias("icd_code"), (F.col("p_size") % 2 + 9).alias("icd_version")))


def site_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clients.by_category(stored_cohort(spark, sf), "unit", MIN_CLIENT)


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return clients.grouped_split(site_rows(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    y = (F.col("o_orderstatus") == "F").cast("int")
    k = F.col("o_orderkey")

    def bounded(x):
        return F.round(F.least(F.lit(0.999), F.greatest(F.lit(0.001), x)), 3)

    p1 = F.lit(0.2) + F.lit(0.3) * y * ((k * 7919) % 101) / 101.0 + F.lit(0.4) * ((k * 104729) % 997) / 997.0
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(k.alias("id"), F.col("n_name").alias("client"), y.alias("y"),
                    bounded(p1).alias("p1"), bounded(F.col("o_totalprice") / 600000.0).alias("p2")))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """An experiment table: arms are event types, seeds are user groups."""
    v, seed = F.avg("value"), F.col("user_id") % 25
    return (table(spark, sf, "events").groupBy(F.col("event_type").alias("arm"), seed.alias("seed")).agg(
        F.round(v / 100, 6).alias("auprc"), F.round(v / 200 + 0.5, 6).alias("auroc"),
        F.round(v / 100 - 0.24, 6).alias("fl_gain"), (F.count(F.lit(1)) % 7).alias("best_round"))
        .withColumn("n_param", F.length("arm") * 1000 + F.col("seed") % 5 * 100))


def parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter vectors: the mean embedding of every label, with its row count."""
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("client"), F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("client", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"),
                                          F.count(F.lit(1)).alias("weight"))


def shared_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return parameters(spark, sf).groupBy("pos").agg(F.avg("value").alias("value"))


def round_history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("round")).agg(
        F.round(F.avg("value"), 6).alias("metric"))

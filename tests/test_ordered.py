import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_hex
from sitewise.operators import joins
from sitewise.operators.joins import heavy_keys, history_totals, lookup_join, prefix_hits, salted_join, window_join
from sitewise.operators.ordered import exact_quantiles, hash_rank, midranks, running_totals, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows; another group has one row; nulls occur."""
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame({
        "id": range(n), "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
        "v": np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n).round(4)), "w": rng.integers(0, 4, n)})
    pdf.loc[0, "g"] = "single"
    pdf.loc[5:40, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df, pdf.dropna()


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_equal_a_plain_sort(skewed, descending):
    df, pdf = skewed
    got = running_totals(df, "v", {"w": F.col("w")}, ["g"], descending, index="i").toPandas()
    want = pdf.groupby(["g", "v"], as_index=False).w.sum().sort_values("v", ascending=not descending)
    by = want.groupby("g")
    want["before"], want["total"], want["i"] = by.w.cumsum() - want.w, by.w.transform("sum"), by.cumcount()
    m = got.merge(want, on=["g", "v"])
    assert len(m) == len(got) == len(want)
    assert (m.w_before == m.before).all() and (m.w_total == m.total).all() and (m.i_x == m.i_y).all()


def test_prefix_sums_without_groups(skewed):
    df, pdf = skewed
    got = running_totals(df, "v", {"n": F.lit(1)}).toPandas().sort_values("v")
    counts = pdf.v.value_counts().sort_index()
    assert got.n_before.tolist() == (counts.cumsum() - counts).tolist()


def test_quantiles_equal_numpy(skewed):
    df, pdf = skewed
    probs = [0, 0.025, 0.25, 0.5, 0.9, 1]
    got = exact_quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g].to_numpy() == pytest.approx(np.quantile(part.v, probs), abs=1e-12)


def test_midranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert {r["v"]: r["rank"] for r in midranks(df, "v").collect()} == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert running_totals(df, "v", {"n": F.lit(1)}, ["g"]).count() == 0
    assert exact_quantiles(df, "v", [0.5], ["g"]).count() == 0


def test_hash_rank_is_a_seeded_permutation(skewed):
    df, _ = skewed
    got = hash_rank(df.select("id", "g"), ["id"], 7, ["g"]).withColumn("h", hash_hex(7, "id")).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
        assert part.sort_values("rank").h.is_monotonic_increasing
        assert (part.n == len(part)).all()


@pytest.mark.parametrize("cuts,value,want", [([1, 2, 2, 5], 2, 3), ([1, 2], 0, 0), ([1, 2], 9, 2), ([], 1, 0)])
def test_positions(spark, cuts, value, want):
    arr = F.array(*[F.lit(c) for c in cuts]).cast("array<int>")
    assert with_position(spark.range(1), "p", arr, F.lit(value), 11).first()["p"] == want


def test_salted_join_keeps_every_row_once(skewed, spark):
    df, pdf = skewed
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, d int")
    inner = salted_join(df.where("v is not null"), dim, ["g"], ["id"])
    assert inner.count() == pdf.g.isin(["hot", "a"]).sum()
    left = salted_join(df, dim, ["g"], ["id"], "left")
    assert left.count() == df.count() == left.select("id").distinct().count()


def test_only_heavy_keys_are_copied(spark):
    """A key with a third of all rows spreads by its share of 64 tasks; every other key is sent once."""
    df = spark.range(90_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).cast("int").alias("g"))
    heavy = heavy_keys(df, ["g"], 64).collect()
    assert len(heavy) == 1 and 21 <= heavy[0]["_shares"] <= 23
    dim = spark.range(-1, 5000).select(F.col("id").alias("g"), (F.col("id") * 2).alias("d"))      # a key of another type
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("64", "-1", "false")):
            spark.conf.set(k, v)
        joined = salted_join(df, dim, ["g"], ["id"]).withColumn("part", F.spark_partition_id())
        assert joined.where(F.col("d") == F.col("g") * 2).count() == df.count() == joined.count()
        tasks = joined.where("g = -1").groupBy("part").count().toPandas()["count"]
        assert len(tasks) > 12 and tasks.max() < 30_000 / 4
        assert joined.where("g >= 0").groupBy("g").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_lookup_join_by_size(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("g"))
    dim = spark.range(6).select(F.col("id").alias("g"), (F.col("id") * 10).alias("d"))
    want = sorted((i, i % 7, i % 7 * 10 if i % 7 < 6 else None) for i in range(2000))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, broadcast in ((was, True), ("-1", False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            joined = lookup_join(df, dim, ["g"], ["id"], "left").select("id", "g", "d")
            assert sorted(tuple(r) for r in joined.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_window_join_meets_only_what_is_near(spark):
    """One key with 10,000 entities and 10,000 events: the join's rows stay a small multiple of both."""
    at = F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 3600).cast("timestamp_ntz")
    cohort = spark.range(10_000).select(F.col("id").alias("stay_id"), F.lit(1).alias("k"), at.alias("intime"))
    events = spark.range(10_000).select(F.lit(1).alias("k"), (at + F.expr("interval 30 minutes")).alias("charttime"), F.col("id").alias("value"))
    got = window_join(events, cohort, "k", "charttime", 2, keep=["value"])
    assert got.count() == 2 * 10_000 - 1
    assert got.where(~F.col("hours_in").isin(0.5, 1.5)).count() == 0
    plan = got._jdf.queryExecution().executedPlan()
    rows = []

    def walk(node):
        if "Join" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            rows.append(metric.get().value() if metric.isDefined() else 0)
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert rows and max(rows) <= 60_000


@pytest.mark.parametrize("hours", [1, 5])
def test_window_join_equals_pairs(spark, hours):
    rng = np.random.default_rng(hours)
    base = pd.Timestamp("1969-12-31 20:00:00")
    c = pd.DataFrame({"stay_id": range(60), "k": rng.integers(0, 4, 60), "intime": base + pd.to_timedelta(rng.integers(0, 40_000, 60), "s")})
    e = pd.DataFrame({"k": rng.integers(0, 5, 400), "charttime": base + pd.to_timedelta(rng.integers(0, 60_000_000, 400), "ms"), "value": range(400)})
    got = window_join(spark.createDataFrame(e), spark.createDataFrame(c), "k", "charttime", hours, keep=["value"]).toPandas()
    pairs = c.merge(e, on="k")
    pairs = pairs[(pairs.charttime >= pairs.intime) & (pairs.charttime < pairs.intime + pd.Timedelta(hours=hours))]
    assert sorted(zip(got.stay_id, got.value)) == sorted(zip(pairs.stay_id, pairs.value)) and len(pairs)


@pytest.mark.parametrize("ranges", [64, 2])
def test_history_totals_equal_the_pairs(spark, monkeypatch, ranges):
    """A patient with most of the history; equal times; own admission ended before the stay."""
    monkeypatch.setattr(joins, "HEAVY_RANGES", ranges)
    rng = np.random.default_rng(1)
    h = pd.DataFrame({"s": np.where(rng.random(400) < .6, 0, rng.integers(0, 6, 400)), "h": range(400),
                      "t": rng.integers(0, 50, 400), "k": rng.integers(0, 3, 400)})
    p = h.sample(150, random_state=1)[["s", "h"]].assign(id=range(150), at=rng.integers(0, 60, 150))
    got = history_totals(spark.createDataFrame(h), spark.createDataFrame(p), "s", "t", "at", {"k": F.col("k")},
                         "h", "id").toPandas().set_index("id").k
    pairs = p.merge(h, on="s", suffixes=("", "_r"))
    pairs = pairs[(pairs.t < pairs["at"]) & (pairs.h != pairs.h_r)]
    want = pairs.groupby("id").k.sum().reindex(p.id, fill_value=0)
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_prefix_hits_version_case_and_length(spark):
    rules = [("x", 1, 9, "41"), ("x", 1, 9, "4109"), ("y", 2, 10, "I2")]
    df = spark.createDataFrame([(1, " 4109 ", 9), (2, "i21", 10), (3, "I21", 9), (4, "4", 9)],
                               "stay_id long, icd_code string, icd_version int")
    got = {(r["stay_id"], r["condition"]) for r in prefix_hits(df, rules).collect()}
    assert got == {(1, "x"), (2, "y")}

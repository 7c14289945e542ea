"""Sizes and rows at which a limit, an overflow or a null once changed results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_long, poisson_cdf
from sitewise.operators import clients, cohort, experiments, metrics
from sitewise.operators.ordered import position_in


def test_position_has_no_depth_limit(spark):
    cuts = F.sequence(F.lit(1), F.lit(100_000))
    got = spark.range(3).select(position_in(cuts, F.element_at(F.array(F.lit(0), F.lit(70_001), F.lit(10 ** 6)),
                                                               (F.col("id") + 1).cast("int"))).alias("p"))
    assert [r["p"] for r in got.collect()] == [0, 70_001, 100_000]


def test_dirichlet_with_three_thousand_clients(spark):
    rows = spark.range(60_000).select(F.col("id").alias("stay_id"), (F.col("id") % 2).cast("int").alias("label"))
    shares = [(y, i, (i + 1) / 3000) for y in (0, 1) for i in range(3000)]
    sizes = clients.dirichlet(rows, shares).groupBy("client").count().toPandas()["count"]
    assert len(sizes) == 3000 and 18 <= sizes.min() and sizes.max() <= 22      # cuts are rounded down


def test_shuffled_with_seventy_thousand_clients(spark):
    rows = spark.range(70_000).select(F.col("id").alias("stay_id"), F.col("id").alias("subject_id"),
                                      F.concat(F.lit("u"), F.col("id")).alias("unit"))
    got = clients.shuffled(rows, "unit", 1)
    assert got.count() == got.select("client").distinct().count() == 70_000


def test_spearman_of_three_million_rows(spark):
    rows = spark.range(3_000_000).select(F.col("id").alias("x"), (F.col("id") % 1000).alias("y"))
    r = experiments.spearman(rows, "x", "y").first()
    assert r["n"] == 3_000_000 and r["rho"] == pytest.approx(1 / 3000, rel=1e-2)


def test_missing_time_is_never_first(spark):
    rows = spark.createDataFrame([(1, 10, None), (1, 11, "2020-01-02"), (2, 12, None)], "h int, s int, t string")
    got = {r["h"]: r["s"] for r in cohort.first_per_key(rows, "h", "t", "s").collect()}
    assert got == {1: 11, 2: 12}


def test_a_site_with_one_class_has_no_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.1), ("b", 0, 0.7)], "client string, y int, p double")
    report = metrics.metric_report(rows, 0.5).toPandas().set_index("scope")
    told = ["n", "n_pos", "prevalence", "threshold", "threshold_source", "few_events"]
    assert report.loc["b"].drop(told).isna().all() and report.loc["b", "n"] == 2
    assert report.loc["a", "accuracy"] == 1.0


def test_fit_that_does_not_converge_is_null(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(y), float(z)) for y, z in zip(rng.integers(0, 2, 50), rng.normal(size=50))], "y int, z double")
    assert metrics.fit_logistic(rows, rounds=1).first()["slope"] is None
    assert metrics.fit_logistic(rows).first()["slope"] is not None


def test_draws_use_sixty_bits(spark):
    top = spark.range(2000).select(hash_long(1, "id").alias("h")).agg(F.max("h")).first()[0]
    assert 2 ** 59 < top < 2 ** 60
    cdf = poisson_cdf()
    assert len(cdf) > 15 and cdf == sorted(cdf) and cdf[-1] == pytest.approx(1.0, abs=1e-15)


def test_pairs_of_many_clients_spread_over_tasks(spark):
    from sitewise.operators import federate
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(f"c{i:03}", j, float(v)) for i, row in enumerate(vectors) for j, v in enumerate(row)],
                                 "client string, pos int, value double")
    got = {(r["client_a"], r["client_b"]): r["cosine"] for r in federate.pairwise_cosine(rows).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = unit @ unit.T
    assert len(got) == 300 * 299 // 2
    assert all(v == pytest.approx(want[int(a[1:]), int(b[1:])]) for (a, b), v in got.items())

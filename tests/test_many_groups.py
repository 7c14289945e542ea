"""Very many groups: nothing is gathered in the driver or in one task, and results equal the plain formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import clients, experiments, federate, metrics


def test_logistic_fits_of_100_000_groups(spark):
    """Six rows a group; the same four patterns of outcomes over and over, one of them without a finite fit left out."""
    z = F.element_at(F.array(*[F.lit(v) for v in (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0)]), (F.col("j") + 1).cast("int"))
    outcomes = ((0, 1, 0, 1, 0, 1), (1, 0, 0, 1, 1, 1), (1, 1, 1, 0, 0, 1), (1, 1, 1, 1, 1, 1))
    y = F.get(F.get(F.array(*[F.array(*[F.lit(v) for v in o]) for o in outcomes]), (F.col("g") % 4).cast("int")), F.col("j").cast("int"))
    rows = spark.range(600_000).select((F.col("id") / 6).cast("long").alias("g"), (F.col("id") % 6).alias("j")).select("g", z.alias("z"), y.alias("y"))
    fitted = metrics.fit_logistic(rows, by=["g"])
    kinds = fitted.groupBy((F.col("g") % 4).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("slope").alias("lo"), F.max("slope").alias("hi"), F.max("intercept").alias("b")).orderBy("k").collect()
    assert [r["n"] for r in kinds] == [25_000] * 4 and kinds[3]["hi"] is None
    x = np.array([-2, -1, -0.5, 0.5, 1, 2])
    for r in kinds[:3]:
        assert r["hi"] - r["lo"] < 1e-9
        p = 1 / (1 + np.exp(-(r["hi"] * x + r["b"])))
        gradient = np.array(outcomes[r["k"]]) - p
        assert abs(gradient.sum()) < 1e-6 and abs((gradient * x).sum() - 1e-6 * r["hi"]) < 1e-6


def test_pairs_of_2_000_arms(spark):
    runs = spark.range(8000).select((F.col("id") % 2000).alias("arm"), (F.col("id") * 7919 % 101).cast("double").alias("m"))
    pairs = experiments.welch_pairs(runs, "arm", "m")
    assert pairs.count() == 2000 * 1999 // 2
    assert "collect_list" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def updates(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (2, 30, 70)) + 0.4
    vectors[0, 4] = 0
    pdf = pd.DataFrame([(r, f"c{i}", j, v) for r in range(2) for i in range(30) for j, v in enumerate(vectors[r, i])],
                       columns=["round", "client", "pos", "value"])
    return spark.createDataFrame(pdf).repartition(5), vectors


@pytest.mark.parametrize("block,per_chunk", [(1024, 512), (16, 7)])
def test_agreement_equals_all_pairs(updates, block, per_chunk):
    df, vectors = updates
    got = {r["round"]: r for r in federate.agreement(df, ["round"], block, per_chunk).collect()}
    linear = {r["round"]: r for r in federate.mean_cosine(df, ["round"]).collect()}
    for r in range(2):
        norm = np.linalg.norm(vectors[r], axis=1)
        cosine = (vectors[r] @ vectors[r].T / np.maximum(np.outer(norm, norm), 1e-12))[np.triu_indices(30, 1)]
        want = (cosine.mean(), cosine.min(), (cosine < 0).mean())
        assert np.allclose([got[r]["mean_pairwise_cosine"], got[r]["min_pairwise_cosine"], got[r]["frac_negative_cosine"]], want)
        assert np.isclose(linear[r]["mean_pairwise_cosine"], want[0]) and linear[r]["n_clients"] == 30
    pairs = federate.pairwise_cosine(df, ["round"]).groupBy("round").agg(F.avg("cosine").alias("m")).collect()
    assert all(np.isclose(got[r["round"]]["mean_pairwise_cosine"], r["m"]) for r in pairs)


def test_clients_with_different_parameters_are_refused(spark):
    df = spark.createDataFrame([(0, "a", 0, 1.0), (0, "a", 1, 1.0), (0, "b", 0, 1.0), (0, "b", 2, 1.0)], "round int, client string, pos int, value double")
    with pytest.raises(Exception, match="different parameters"):
        federate.agreement(df, ["round"]).collect()


def test_70_000_clients_keep_their_sizes(spark):
    """Sizes of 1 to 3 stays; patients of one stay, so every client's size is matched exactly."""
    cohort = spark.range(140_000).select(F.col("id").alias("stay_id"), F.col("id").alias("subject_id"),
                                         F.concat(F.lit("u"), (F.pmod(F.hash("id"), F.lit(70_000))).cast("string")).alias("unit"))
    was = cohort.groupBy("unit").count()
    got = clients.shuffled(cohort, "unit", min_size=1)
    now = got.groupBy(F.col("client").alias("unit")).agg(F.count(F.lit(1)).alias("now"))
    assert was.join(now, "unit", "full").where(~F.col("count").eqNullSafe(F.col("now"))).count() == 0
    assert got.count() == 140_000 and got.where("client = unit").count() < 100

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import clients, quality


def cohort(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, subject_id long, unit string, label int")


@pytest.mark.parametrize("n,test,val", [(10, 2, 2), (30, 4, 4), (1, 0, 0), (3, 0, 0), (0, 0, 0)])
def test_split_sizes_round_half_even(spark, n, test, val):
    rows = clients.by_category(cohort(spark, [(i, i, "u", 0) for i in range(n)]), "unit", 1)
    got = {r["split"]: r["count"] for r in clients.grouped_split(rows).groupBy("split").count().collect()}
    assert (got.get("test", 0), got.get("val", 0)) == (test, val) and sum(got.values()) == n


def test_split_keeps_patients_together_and_stratifies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 400)), "u" if rng.random() < .8 else "w", int(rng.random() < .2)) for i in range(3000)]
    split = clients.grouped_split(clients.by_category(cohort(spark, rows), "unit", 1)).persist()
    assert split.count() == 3000 and split.select("stay_id").distinct().count() == 3000
    leaks = quality.leakage_counts(split).first()
    assert leaks["within_client"] == 0 and leaks["across_clients"] > 0        # patients visit both units
    quality.assert_no_leakage(split)
    with pytest.raises(AssertionError):
        quality.assert_no_leakage(split, scope="global")
    again = clients.grouped_split(clients.by_category(cohort(spark, rows[::-1]), "unit", 1))
    assert again.select(*split.columns).exceptAll(split).count() == 0         # row order does not matter
    with pytest.raises(AssertionError):
        quality.assert_no_leakage(clients.row_split(clients.by_category(cohort(spark, rows), "unit", 1)))


def test_size_matched_control(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 300)), rng.choice(["a", "b", "c", "d"], p=[.5, .3, .19, .01]), 0) for i in range(1000)]
    c = cohort(spark, rows)
    sizes = {r["unit"]: r["n"] for r in clients.client_sizes(c, "unit", 50).collect()}
    got = clients.shuffled(c, "unit", 50)
    new = {r["client"]: r["count"] for r in got.groupBy("client").count().collect()}
    largest = c.groupBy("subject_id").count().agg(F.max("count")).first()[0]
    assert set(new) == set(sizes) == {"a", "b", "c"}
    assert all(abs(new[k] - sizes[k]) <= largest for k in sizes)
    assert got.groupBy("subject_id").agg(F.countDistinct("client").alias("k")).where("k > 1").count() == 0


def test_control_takes_text_subjects(spark):
    c = spark.createDataFrame([(i, f"person-{i % 7}", "ab"[i % 2], 0) for i in range(40)],
                              "stay_id long, subject_id string, unit string, label int")
    assert clients.shuffled(c, "unit", 1).count() == 40


def test_dirichlet_places_every_row(spark):
    c = cohort(spark, [(i, i, "u", int(i % 3 == 0)) for i in range(500)])
    shares = clients.dirichlet_shares([0, 1], 8, 0.3, seed=5)
    got = clients.dirichlet(c, shares)
    assert got.count() == 500 and got.where("client is null").count() == 0
    assert 2 <= got.select("client").distinct().count() <= 8


def test_guard_clients(spark):
    with pytest.raises(ValueError, match="gave 1 client"):
        clients.guard_clients(clients.by_category(cohort(spark, [(1, 1, "u", 0)]), "unit", 1), "unit")
    with pytest.raises(ValueError, match="gave 0 client"):
        clients.guard_clients(clients.by_category(cohort(spark, [(1, 1, "u", 0)]), "unit", 9), "unit")


@pytest.mark.parametrize("nulls", ["impute", "ignore", "poison"])
def test_normaliser_modes(spark, nulls):
    v = {("a", "f"): [1.0, 5.0, None, 3.0, 100.0], ("a", "none"): [None, None], ("b", "f"): [2.0, 4.0]}
    df = spark.createDataFrame([(*k, x) for k, xs in v.items() for x in xs], "client string, feature string, value double")
    got = {(r["client"], r["feature"]): r for r in clients.fit_normaliser(df, nulls=nulls).collect()}
    for key, xs in v.items():
        x = np.array([np.nan if t is None else t for t in xs])
        seen = x[~np.isnan(x)]
        med = np.median(seen) if len(seen) else 0.0
        use = np.where(np.isnan(x), med, x) if nulls == "impute" else seen
        r = got[key]
        assert r["median"] == pytest.approx(med)
        if nulls == "poison" and np.isnan(x).any():
            assert r["mean"] == 0 and r["sd"] is None
        else:
            mean, sd = (use.mean(), use.std()) if len(use) else (0.0, 0.0)
            assert (r["mean"], r["sd"]) == (pytest.approx(mean), pytest.approx(sd + 1e-6))
    z = clients.apply_normaliser(df, clients.fit_normaliser(df, nulls=nulls), impute=nulls != "poison")
    assert z.where("z is null").count() == 0 and z.count() == df.count()


def test_thin_clients(spark):
    df = spark.createDataFrame([("a", "train", 1)] * 60 + [("a", "test", 1)] * 30 + [("b", "train", 1)] * 60,
                               "client string, split string, label int")
    assert [tuple(r) for r in quality.thin_clients(df).collect()] == [("b", 60, 0, 0)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_order_violations_for_any_chunk(spark, chunk):
    rng = np.random.default_rng(2)
    k = rng.integers(0, 50, 300)
    seq = np.cumsum(rng.integers(1, 9, 300))                    # positions with gaps
    df = spark.createDataFrame(pd.DataFrame({"s": seq, "k": k}).sample(frac=1, random_state=0))
    assert quality.order_violations(df, "s", "k", chunk).first()[0] == int((np.diff(k) < 0).sum())


def test_prefix_cutoff(spark):
    r = quality.prefix_stats(spark.createDataFrame([(1,), (4,), (4,), (9,)], "k int"), "k").first()
    assert tuple(r) == (1, 9, 4, 3, 4)


def test_fingerprint(spark):
    a = spark.range(10000).withColumnRenamed("id", "stay_id")
    mark = quality.fingerprint(a).first()[0]
    assert len(mark) == 16 and quality.fingerprint(a.repartition(7)).first()[0] == mark
    assert quality.fingerprint(a.where("stay_id <> 77")).first()[0] != mark
    assert quality.fingerprint(a.union(a.limit(1))).first()[0] != mark
    quality.check_fingerprint(a, mark)
    with pytest.raises(ValueError, match="not the one"):
        quality.check_fingerprint(a.limit(3), mark)


def test_required_columns(spark):
    df = spark.createDataFrame([], "a int, b int")
    got = quality.required_columns({"t": df, "u": df}, {"t": ["a", "z"], "u": ["a"], "v": ["a"], "w": ["a"]}, ["w"])
    assert [(n, lv) for n, lv, _ in got] == [("t", "FAIL"), ("u", "ok"), ("v", "FAIL"), ("w", "skip")]


def test_proportions_against_the_table(spark):
    """2x2 counts 30/70 and 45/55: chi-square with continuity correction by hand."""
    df = spark.createDataFrame([(True, 1)] * 30 + [(True, 0)] * 70 + [(False, 1)] * 45 + [(False, 0)] * 55, "k boolean, x int")
    r = quality.proportion_effect(df, F.col("k"), {"x": F.col("x"), "all": F.lit(1)}).collect()
    got = {x["characteristic"]: x for x in r}
    want = 200 * (abs(30 * 55 - 70 * 45) - 100) ** 2 / (75 * 125 * 100 * 100)
    assert got["x"]["chi2"] == pytest.approx(want)
    assert got["x"]["cohens_h"] == pytest.approx(2 * np.arcsin(np.sqrt(.3)) - 2 * np.arcsin(np.sqrt(.45)))
    assert got["x"]["magnitude"] == "small" and got["all"]["magnitude"] == "not testable" and got["all"]["chi2"] is None


def test_table_one(spark):
    df = spark.createDataFrame([(1, "A", 0, 20.0), (2, "A", 1, 30.0), (3, "B", 0, 41.0)], "id int, client string, label int, age double")
    t = {r["grp"]: r for r in clients.table_one(df, {"age": 0}, {"died": F.col("label") == 1}).collect()}
    assert set(t) == {"Overall", "Outcome: yes", "Outcome: no", "Client: A", "Client: B"}
    assert t["Overall"]["age"] == "30 (25-36)" and t["Overall"]["died"] == "1 (33.3)" and t["Client: B"]["n"] == 1

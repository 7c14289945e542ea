import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import experiments as X
from sitewise.operators import federate as K


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame([(a, s, 0.4 + 0.01 * i + rng.normal(0, 0.01), 10 ** i) for i, a in enumerate("abcd") for s in range(8)],
                       columns=["arm", "seed", "m", "size"])
    return spark.createDataFrame(pdf).persist(), pdf


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def test_paired_test(runs):
    df, pdf = runs
    got = {r["arm"]: r for r in X.with_paired_p(X.paired_by_seed(df, "arm", "a", "m")).collect()}
    w = pdf.pivot(index="seed", columns="arm", values="m")
    for arm in "bcd":
        d = w[arm] - w["a"]
        assert got[arm]["t"] == pytest.approx(d.mean() / (d.std() / np.sqrt(len(d)))) and got[arm]["wins"] == (d > 0).sum()
        assert got[arm]["bonferroni_alpha"] == pytest.approx(0.05 / 3)
    same = X.with_paired_p(X.paired_by_seed(df.where("arm = 'a'").unionByName(
        df.where("arm = 'a'").withColumn("arm", F.lit("copy"))), "arm", "a", "m")).first()
    assert same["t"] is None and same["sd_diff"] is None and same["paired_p"] is None and same["sig_uncorrected"] is False


def test_spearman_with_ties(runs, spark):
    df, pdf = runs
    r = X.spearman_p(X.spearman(df, "size", "m")).first()
    want = np.corrcoef(ranks(pdf["size"]), ranks(pdf.m))[0, 1]
    assert r["rho"] == pytest.approx(want) and 0 < r["p_value"] < 1e-3
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert X.spearman(flat, "x", "y").first()["rho"] is None


def test_anova(runs, spark):
    df, pdf = runs
    extra = spark.createDataFrame([("lonely", 0, 0.9, 1)], df.schema)
    r = X.anova_p(X.anova(df.unionByName(extra), "arm", "m")).first()
    g = [x.m.to_numpy() for _, x in pdf.groupby("arm")]
    allv, grand = np.concatenate(g), np.append(pdf.m, 0.9).mean()
    ssb, ssw = sum(len(x) * (x.mean() - allv.mean()) ** 2 for x in g), sum(((x - x.mean()) ** 2).sum() for x in g)
    assert r["f_value"] == pytest.approx(ssb / 3 / (ssw / 28)) and (r["df1"], r["df2"]) == (3, 28)
    total = ((np.append(pdf.m, 0.9) - grand) ** 2).sum()
    assert r["eta_squared"] == pytest.approx(sum(len(x) * (x.mean() - grand) ** 2 for x in g) / total)
    assert r["best_level"] == "lonely"


def test_mann_whitney(runs):
    df, pdf = runs
    two = df.where("arm in ('a', 'b')").withColumn("m", F.round("m", 2))
    r = X.mann_whitney_p(X.mann_whitney(two, F.col("arm") == "a", "m")).first()
    a, b = (pdf[pdf.arm == k].m.round(2).to_numpy() for k in "ab")
    u = sum((x > b).sum() + (x == b).sum() / 2 for x in a)
    assert r["u"] == pytest.approx(u) and 0 < r["p_value"] <= 1


def test_pairs_and_stability(runs):
    df, pdf = runs
    got = {(r["arm_a"], r["arm_b"]): r for r in X.welch_pairs_p(X.welch_pairs(df, "arm", "m")).collect()}
    assert len(got) == 6
    a, b = (pdf[pdf.arm == k].m for k in "ad")
    assert got["a", "d"]["t"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(a.var() / 8 + b.var() / 8))
    assert got["a", "d"]["cohens_d"] == pytest.approx((a.mean() - b.mean()) / np.sqrt((a.var(ddof=0) + b.var(ddof=0)) / 2))
    order = [r["arm"] for r in X.stability_rank(df, "arm", "m").collect()]
    assert order == list(pdf.groupby("arm").m.std(ddof=0).sort_values().index)


def test_configs_respect_their_space(spark):
    space = {"lr": ("log", 1e-4, 1e-2), "algo": ("choice", ["x", "y"]), "mu": ("log", 1.0, 2.0)}
    c = X.sample_configs(spark.range(500), "id", space, 1, {"mu": ("algo", "x", 0.0)}).toPandas()
    assert c.lr.between(1e-4, 1e-2).all() and set(c.algo) == {"x", "y"}
    assert (c[c.algo == "y"].mu == 0).all() and c[c.algo == "x"].mu.between(1, 2).all()
    assert np.log10(c.lr).mean() == pytest.approx(-3, abs=0.1)


def test_case_lists(spark):
    pred = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") / 300).alias("p"))
    rows = X.case_lists(pred, 0.5, k=5).toPandas()
    assert rows.groupby("list").size().to_dict() == {n: 5 for n in X.CASE_LISTS}
    assert (rows[rows.list == "missed"].p < 0.5).all() and (rows[rows.list == "missed"].y == 1).all()
    assert rows[rows.list == "highest"].id.tolist() == [299, 298, 297, 296, 295]


def params(spark, vectors):
    return spark.createDataFrame([(c, i, float(x)) for c, v in vectors.items() for i, x in enumerate(v)],
                                 "client string, pos int, value double")


def test_averaging(spark):
    p = params(spark, {"a": [1, 2], "b": [3, 6]})
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "client string, weight double")
    assert [r["value"] for r in K.fedavg(p, w).orderBy("pos").collect()] == [2.5, 5.0]
    same = params(spark, {"a": [1, 2], "b": [1, 2]})
    assert [r["value"] for r in K.fedavg(same, w).orderBy("pos").collect()] == [1.0, 2.0]
    named = p.withColumn("pos", F.when(F.col("pos") == 0, "head.w").otherwise("header.w"))
    got = {(r["client"], r["pos"]): (r["value"], r["shared"]) for r in K.fedavg_partial(named, w, ["head"]).collect()}
    assert got == {("a", "head.w"): (1.0, 0), ("b", "head.w"): (3.0, 0), ("a", "header.w"): (5.0, 1), ("b", "header.w"): (5.0, 1)}


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_drift_against_numpy(spark, block):
    v = {"a": [1, 0, 2], "b": [-1, 1, 0], "c": [0, 0, 3]}
    got = {(r["client_a"], r["client_b"]): r["cosine"] for r in K.pairwise_cosine(params(spark, v), block=block).collect()}
    cos = {(i, j): np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))}
    assert got == pytest.approx(cos)
    d = K.drift(params(spark, v).withColumn("round", F.lit(1))).first()
    n = [np.linalg.norm(x) for x in v.values()]
    assert d["mean_update_norm"] == pytest.approx(np.mean(n)) and d["norm_ratio_max_min"] == pytest.approx(max(n) / min(n))
    assert d["min_pairwise_cosine"] == pytest.approx(min(cos.values())) and d["frac_negative_cosine"] == pytest.approx(1 / 3)


def test_unequal_parameter_sets_are_refused(spark):
    p = params(spark, {"a": [1, 2], "b": [1, 2]}).where("not (client = 'b' and pos = 0)")
    with pytest.raises(Exception, match="different parameters"):
        K.pairwise_cosine(p).collect()


@pytest.mark.parametrize("scores,patience,best,stopped", [
    ([.1, .3, .2, .2, .2, .9], 3, 2, 5), ([.1, .2, .3], 3, 3, 3), ([.5, .5, .5], 2, 1, 3), ([.5], 1, 1, 1)])
def test_early_stop(spark, scores, patience, best, stopped):
    h = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, round int, auprc double")
    r = K.early_stop(h, patience, "auprc").first()
    assert (r["best_round"], r["stopped_at"]) == (best, stopped)


def test_weights_and_resampling(spark):
    rows = spark.createDataFrame([(i, "a", int(i < 10)) for i in range(100)] + [(100, "b", 0)],
                                 "stay_id long, client string, label int")
    w = {r["client"]: r for r in K.client_weights(rows).collect()}
    assert (w["a"]["w_effective"], w["a"]["pos_weight"]) == (18.0, 9.0) and (w["b"]["w_events"], w["b"]["w_effective"]) == (1.0, 0.0)
    bal = K.balanced_weights(rows).groupBy("client", "label").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in bal)
    drawn = {(r["client"], r["label"]): r["t"] for r in K.balanced_resample(rows).groupBy("client", "label").agg(
        F.sum("times").alias("t")).collect()}
    assert drawn["a", 0] + drawn["a", 1] == 100 and abs(drawn["a", 1] - 50) < 20 and drawn["b", 0] == 1

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import inference, metrics


def brute(y, p):
    """AUROC over all pairs, AP and best F1 over all cuts."""
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])
    ap, before, best = 0.0, 0, (-1.0, 0.0)
    for t in sorted(set(p), reverse=True):
        tp, n = (y[p >= t]).sum(), (p >= t).sum()
        ap += (tp - before) / len(pos) * tp / n
        best = max(best, (2 * tp / (n + len(pos)), t))
        before = tp
    return auc, ap, best


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 1500
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip((0.25 * y + rng.normal(0.35, 0.2, n)).round(2), 0.01, 0.99)
    q = np.clip((0.15 * y + rng.normal(0.35, 0.2, n)).round(2), 0.01, 0.99)
    pdf = pd.DataFrame({"id": range(n), "client": np.where(np.arange(n) % 10 < 7, "big", "small"), "y": y, "p": p, "q": q})
    return spark.createDataFrame(pdf).persist(), pdf


def test_ranking_metrics_against_pairs(scored):
    df, pdf = scored
    for by, groups in ((["client"], pdf.groupby("client")), ([], [("", pdf)])):
        got = {r["client"] if by else "": r for r in metrics.ranking_metrics(df, by=by).collect()}
        for name, g in groups:
            auc, ap, (f1, t) = brute(g.y.to_numpy(), g.p.to_numpy())
            r = got[name]
            assert (r["auroc"], r["auprc"], r["best_f1"], r["best_threshold"]) == pytest.approx((auc, ap, f1, t))
            assert r["lift"] == pytest.approx(ap / g.y.mean())


@pytest.mark.parametrize("rows,auroc,auprc,f1,threshold", [
    ([(1, 0.5), (0, 0.5), (0, 0.5)], 0.5, 1 / 3, 0.5, 0.5),           # all scores tie
    ([(0, 0.2), (0, 0.9)], None, None, 0.0, 0.5),                     # no positive
    ([(1, 0.2), (1, 0.9)], None, None, 1.0, 0.2),                     # no negative
    ([(1, 0.7)], None, None, 1.0, 0.7)])
def test_edge_cases(spark, rows, auroc, auprc, f1, threshold):
    r = metrics.ranking_metrics(spark.createDataFrame(rows, "y int, p double")).first()
    assert r["auroc"] == (None if auroc is None else pytest.approx(auroc))
    assert r["auprc"] == (None if auprc is None else pytest.approx(auprc))
    assert (r["best_f1"], r["best_threshold"]) == pytest.approx((f1, threshold))


def test_threshold_metrics_when_rates_are_undefined(spark):
    r = metrics.threshold_metrics(spark.createDataFrame([(0, 0.2), (0, 0.3)], "y int, p double"), 0.5).first()
    assert r["sensitivity"] is None and r["ppv"] is None and r["f1"] == 0 and r["specificity"] == 1
    assert r["balanced_accuracy"] == 1


def test_curves_reach_their_ends(scored):
    df, pdf = scored
    roc = metrics.roc_points(df).orderBy("idx").toPandas()
    assert tuple(roc.iloc[0][["fpr", "tpr"]]) == (0, 0) and math.isinf(roc.threshold[0])
    assert tuple(roc.iloc[-1][["fpr", "tpr"]]) == (1, 1) and len(roc) == pdf.p.nunique() + 1
    pr = metrics.pr_points(df).orderBy("idx").toPandas()
    assert pr.recall[0] == 1 and tuple(pr.iloc[-1][["precision", "recall"]]) == (1, 0)
    thin = metrics.roc_points(df, max_points=10).toPandas()
    assert len(thin) <= 12 and set(thin.idx) <= set(roc.idx)


def test_f1_and_decision_grids(scored):
    df, pdf = scored
    grid = {round(r["threshold"], 2): r["f1"] for r in metrics.f1_grid(df).collect()}
    assert len(grid) == 19
    for t in (0.05, 0.5, 0.95):
        hit = pdf.p >= t
        assert grid[t] == pytest.approx(2 * (hit & (pdf.y == 1)).sum() / (hit.sum() + pdf.y.sum()))
    dc = {round(r["threshold"], 2): r for r in metrics.decision_curve(df).collect()}
    assert len(dc) == 50
    hit = pdf.p >= 0.3
    nb = ((hit & (pdf.y == 1)).sum() - (hit & (pdf.y == 0)).sum() * 0.3 / 0.7) / len(pdf)
    assert dc[0.3]["net_benefit_model"] == pytest.approx(nb)


def test_calibration_error_bins_are_right_closed(spark):
    rows = [(0, 0.1), (1, 0.1), (1, 0.11), (0, 1.0)]
    got = metrics.ece(spark.createDataFrame(rows, "y int, p double")).first()["ece"]
    assert got == pytest.approx((2 * 0.4 + 0.89 + 1.0) / 4)


def test_logistic_fit_solves_its_equations(scored, spark):
    df, pdf = scored
    fit = {r["client"]: r for r in metrics.fit_logistic(
        df.withColumn("z", F.log(F.col("p") / (1 - F.col("p")))), by=["client"]).collect()}
    for c, g in pdf.groupby("client"):
        z = np.log(g.p / (1 - g.p))
        err = g.y - 1 / (1 + np.exp(-(fit[c]["slope"] * z + fit[c]["intercept"])))
        assert abs(err.sum()) < 1e-4 and abs((err * z).sum()) < 1e-3
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, z double")
    assert metrics.fit_logistic(one).first()["slope"] is None
    assert metrics.platt_apply(one, metrics.fit_logistic(one)).where("p_cal is null").count() == 0


def test_calibration_curve_of_constant_scores_is_empty(spark):
    assert metrics.calibration_curve(spark.createDataFrame([(1, .5), (0, .5)], "y int, p double")).count() == 0


def test_pick_threshold(scored):
    df, pdf = scored
    few = df.where("y = 0 or id < 20")
    part = pdf[(pdf.y == 0) | (pdf.id < 20)]
    r = metrics.pick_threshold(few, min_events=50).first()
    assert r["source"] == "prevalence" and r["threshold"] == pytest.approx(np.quantile(part.p, 1 - part.y.mean()))
    assert metrics.pick_threshold(few, fallback=0.4, min_events=50).first()["threshold"] == 0.4
    assert metrics.pick_threshold(df).first()["threshold"] == pytest.approx(brute(pdf.y.to_numpy(), pdf.p.to_numpy())[2][1])


def test_report_and_negative_control(scored):
    df, _ = scored
    rep = metrics.metric_report(df).toPandas().set_index("scope")
    assert set(rep.index) == {"global", "big", "small"} and (rep.threshold_source == "same rows (biased)").all()
    shuffled = metrics.permuted(df)
    assert shuffled.count() == df.count()
    assert shuffled.groupBy("p").count().exceptAll(df.groupBy("p").count()).count() == 0
    assert abs(metrics.ranking_metrics(shuffled).first()["auroc"] - 0.5) < 0.06


def test_delong_against_all_pairs(scored):
    df, pdf = scored
    pos, neg = pdf[pdf.y == 1], pdf[pdf.y == 0]
    v, auc = {}, {}
    for c in "pq":
        k = (pos[c].to_numpy()[:, None] > neg[c].to_numpy()) + 0.5 * (pos[c].to_numpy()[:, None] == neg[c].to_numpy())
        v[c], auc[c] = (k.mean(1), k.mean(0)), k.mean()
    cov = sum(np.cov(v["p"][i], v["q"][i]) / len(v["p"][i]) for i in (0, 1))
    z = (auc["p"] - auc["q"]) / np.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    r = inference.delong_test(df, "p", "q").first()
    assert (r["auc1"], r["auc2"], r["z"]) == pytest.approx((auc["p"], auc["q"], z))
    assert r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert inference.delong(df.withColumn("q", F.col("p")), "p", "q").first()["z"] is None


def test_exact_draws_keep_class_sizes(scored):
    df, pdf = scored
    d = inference.draw_exact(df.select("id", "y", "p"), 4, seed=1).groupBy("b", "y").agg(F.sum("w").alias("n")).collect()
    assert len(d) == 8 and {(r["y"], r["n"]) for r in d} == {(0, (pdf.y == 0).sum()), (1, (pdf.y == 1).sum())}


@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_intervals_cover_the_estimate(scored, method):
    df, _ = scored
    point = metrics.ranking_metrics(df).first()
    ci = {r["metric"]: r for r in inference.bootstrap_ci(df, 0.45, 60, method=method).collect()}
    assert set(ci) == set(inference.BOOT_METRICS)
    for m in ("auroc", "auprc"):
        assert ci[m]["lo"] < point[m] < ci[m]["hi"] and ci[m]["n_replicates"] == 60
        assert ci[m]["hi"] - ci[m]["lo"] < 0.15


def test_paired_bootstrap(scored):
    df, pdf = scored
    r = inference.bootstrap_auprc_diff(df, 40, p1="p", p2="q").first()
    y = pdf.y.to_numpy()
    assert r["diff"] == pytest.approx(brute(y, pdf.p.to_numpy())[1] - brute(y, pdf.q.to_numpy())[1])
    assert r["lo"] < r["diff"] and r["p_value"] < 0.1
    same = inference.bootstrap_auprc_diff(df.withColumn("q", F.col("p")), 10, p1="p", p2="q").first()
    assert same["diff"] == 0 and same["p_value"] == 2.0


def test_exact_draws_are_shuffled_once(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 100 / 100.0).alias("p"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        drawn = inference.draw_exact(df, 4)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        # ranks spread over the tasks, their draws, and the rows at the drawn positions
        assert plan.count("Exchange hashpartitioning") == 3
        assert drawn.agg(F.sum("w")).first()[0] == 4 * 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

"""Replicate matrices against the same draws applied row by row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_long
from sitewise.operators import inference, replicates

B = 23


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.integers(0, 2, n), "site": rng.choice(["a", "b", "c", None], n, p=[0.7, 0.2, 0.05, 0.05])})
    pdf["p"] = np.clip(0.5 + 0.15 * (pdf.y - 0.5) + rng.normal(0, 0.2, n), 0, 1).round(3)
    pdf.loc[pdf.index % 3 == 0, "p"] = 0.41                  # one score has a third of all rows
    pdf = pd.concat([pdf, pd.DataFrame({"id": range(n, n + 6), "y": [1, 1, 1, 0, 1, 1], "site": ["one"] * 3 + ["two", "two", "a"],
                                        "p": [0.2, 0.9, 0.9, 0.5, 0.5, np.nan]})])
    df = spark.createDataFrame(pdf.astype({"p": object}).where(pdf.notna(), None), "id long, y int, site string, p double").repartition(6)
    hashed = df.select("id", hash_long(0, "id").alias("h")).toPandas()
    return df, pdf.merge(hashed, on="id")


def one(y, p, w, t):
    """AUROC, AUPRC, sensitivity, ppv, brier of weighted rows."""
    scores = sorted(set(p[w > 0]), reverse=True)
    tp = fp = auc = ap = 0.0
    for s in scores:
        a, b = w[(p == s) & (y == 1)].sum(), w[(p == s) & (y == 0)].sum()
        auc += b * (tp + a / 2)
        tp, fp = tp + a, fp + b
        ap += a * tp / (tp + fp)
    hit = (w * (p >= t))
    nan = float("nan")
    return (auc / (tp * fp) if tp * fp else nan, ap / tp if tp * fp else nan, (hit * y).sum() / tp if tp else nan,
            (hit * y).sum() / hit.sum() if hit.sum() else nan, (w * (p - y) ** 2).sum() / w.sum() if w.sum() else nan)


def brute(pdf, t=0.45):
    pdf = pdf.dropna(subset=["p"])
    w = replicates.poisson_weights(pdf.h.to_numpy(), np.arange(B)).astype(float)
    return [one(pdf.y.to_numpy(), pdf.p.to_numpy(), w[:, b], t) for b in range(B)]


@pytest.mark.parametrize("rows,hot,draws", [(50_000, 1 << 18, 1 << 22), (100, 200, 23 * 7), (1, 50, 23)])
def test_equals_row_by_row(scored, monkeypatch, rows, hot, draws):
    for name, value in (("BUCKET_ROWS", rows), ("HOT_ROWS", hot), ("DRAWS", draws)):
        monkeypatch.setattr(replicates, name, value)
    df, pdf = scored
    columns = ["auroc", "auprc", "sensitivity", "ppv", "brier"]
    whole = replicates.replicate_matrix(df, 0.45, B).orderBy("b").toPandas()
    assert np.allclose(whole[columns], brute(pdf), equal_nan=True) and len(whole) == B
    sites = replicates.replicate_matrix(df, 0.45, B, by=["site"]).toPandas()
    assert set(sites.site) == {"a", "b", "c", "one", "two"}
    for site, got in sites.groupby("site"):
        assert np.allclose(got.sort_values("b")[columns].astype(float), brute(pdf[pdf.site == site]), equal_nan=True)


def test_weights_of_a_score_are_made_once(scored, monkeypatch):
    monkeypatch.setattr(replicates, "SUMMED_ROWS", 20)
    df, pdf = scored
    rows = replicates._bucketed(df.withColumn("_all", F.lit(0)), ["_all"], "p", "y", "id", 0)
    kinds = {r["_kind"]: r["n"] for r in replicates._items(rows, ["_all"], B).groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    often = pdf.dropna(subset=["p"]).p.value_counts()
    often = often[often > B]
    assert kinds[2] == len(often) > 1 and kinds[1] == pdf.p.notna().sum() - often.sum()
    got = replicates.replicate_matrix(df, 0.45, B).orderBy("b").toPandas()
    assert np.allclose(got[["auroc", "auprc", "sensitivity", "ppv", "brier"]], brute(pdf), equal_nan=True)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, y int, p double")
    assert replicates.replicate_matrix(empty, 0.5, 5).count() == 0


def test_draws_are_poisson():
    rng = np.random.default_rng(1)
    w = replicates.poisson_weights(rng.integers(0, 1 << 60, 2000), np.arange(500)).astype(float)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    assert np.abs(np.corrcoef(w[:200])[~np.eye(200, dtype=bool)]).max() < 0.3
    assert np.abs(np.corrcoef(w.T[:200])[~np.eye(200, dtype=bool)]).max() < 0.15


def test_interval_is_that_of_a_plain_bootstrap(scored):
    """2,000 replicates: the ends agree with resampling rows inside both classes."""
    df, pdf = scored
    pdf = pdf.dropna(subset=["p"])
    got = {r["metric"]: r for r in inference.bootstrap_ci(df, 0.45, 2000).collect()}
    rng, y, p = np.random.default_rng(0), pdf.y.to_numpy(), pdf.p.to_numpy()
    classes = [np.flatnonzero(y == k) for k in (0, 1)]
    reps = [one(y, p, np.bincount(np.concatenate([rng.choice(c, len(c)) for c in classes]), minlength=len(y)), 0.45) for _ in range(200)]
    for i, name in enumerate(("auroc", "auprc", "sensitivity", "ppv", "brier")):
        lo, hi = np.percentile([r[i] for r in reps], [2.5, 97.5])
        assert abs(got[name]["lo"] - lo) < 0.4 * (hi - lo) and abs(got[name]["hi"] - hi) < 0.4 * (hi - lo)
        assert got[name]["n_replicates"] == 2000

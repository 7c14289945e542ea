"""Resampling intervals and tests for scored rows: bootstrap, paired bootstrap, DeLong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.pvalues import p_normal
from sitewise.functions.scalars import hash_long, hash_uniform, poisson_weight, ratio
from sitewise.operators.joins import salted_join
from sitewise.operators.metrics import (auprc_of, auroc_of, calibration_slope, metric_report, score_curve,
                                        sensitivities, site_scopes, threshold_metrics)
from sitewise.operators.ordered import bucket_count, hash_rank, running_totals
from sitewise.operators.replicates import METRICS as BOOT_METRICS
from sitewise.operators.replicates import replicate_matrix
from sitewise.session import store


def _replicates(n_boot: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))


def draw_exact(pred: DataFrame, n_boot: int, seed: int = 0, key: str = "id",
               strata: Sequence[str] = ("y",)) -> DataFrame:
    """Resampling with replacement, every stratum kept at its size: rows x replicate ``b``
    with a count ``w`` (rows not drawn are absent).

    Draw k of a replicate points at position hash(seed, b, stratum, k) mod n of the
    stratum's shuffled rows; the draws are counted and joined back on the position.
    """
    strata = list(strata)
    ranked = store(hash_rank(pred, [key], f"{seed}pos", strata, "_at", "_n"), "replicate-ranks")
    head = hash_long(seed, "b", *strata, "_at")
    # the draws are made by all tasks, however small the stored ranks are
    spread = ranked.select(*strata, "_n", "_at").repartition(bucket_count(ranked), *strata, "_at")
    draws = spread.select("*", _replicates(n_boot).alias("b")).select(
        *strata, "b", F.pmod(head, F.col("_n")).alias("_at"))
    # laid out by position once: counting and the join with the rows there need no other shuffle
    counted = draws.repartition(*strata, "_at").groupBy(*strata, "_at", "b").agg(F.count(F.lit(1)).alias("w"))
    return counted.join(ranked.drop("_n"), [*strata, "_at"]).drop("_at")


def draw_poisson(pred: DataFrame, n_boot: int, seed: int = 0, key: str = "id") -> DataFrame:
    """Poisson(1) resampling weights ``w`` (possibly 0) for rows x replicate ``b``, as a table.

    Needs no shuffle and no sizes; the replicate sizes vary around n. ``replicate_matrix``
    draws thousands of replicates without such a table.
    """
    rows = pred.select("*", _replicates(n_boot).alias("b"))
    # no filter on w here: pushed down, it would compute the hash many times over
    return (rows.withColumn("_u", hash_uniform(seed, "b", key))
            .withColumn("w", poisson_weight(F.col("_u"))).drop("_u"))


def _merge(drawn: DataFrame, *keys: str) -> DataFrame:
    """Counts per replicate, score(s) and outcome, stored once: the draws are the costly
    part and everything after them reads this much smaller table several times."""
    merged = drawn.groupBy(*keys).agg(F.sum("w").cast("long").alias("w")).where(F.col("w") > 0)
    return store(merged, "replicate-counts")


def replicate_metrics(drawn: DataFrame, threshold: float, p: str = "p", y: str = "y",
                      by: Sequence[str] = ()) -> DataFrame:
    """All bootstrap metrics, one row per group and replicate; calibration is left out on purpose."""
    keys = [*by, "b"]
    merged = _merge(drawn, *keys, p, y)
    curve = score_curve(merged, p, y, keys, F.col("w"))
    rank = curve.groupBy(*keys).agg(auroc_of().alias("auroc"), auprc_of().alias("auprc"))
    at = threshold_metrics(merged, threshold, p, y, keys, F.col("w"))
    return rank.join(at, keys).select(*keys, *BOOT_METRICS)


def percentile_interval(reps: DataFrame, metrics: Sequence[str], alpha: float = 0.05,
                        by: Sequence[str] = ()) -> DataFrame:
    """(group, metric, lo, hi) from replicate rows; the number of replicates bounds the work."""
    long = reps.unpivot([*by, "b"], list(metrics), "metric", "v").where(F.col("v").isNotNull())
    return long.groupBy(*by, "metric").agg(
        F.percentile("v", F.lit(alpha / 2)).alias("lo"), F.percentile("v", F.lit(1 - alpha / 2)).alias("hi"),
        F.count(F.lit(1)).alias("n_replicates"))


def bootstrap_ci(pred: DataFrame, threshold: float, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05,
                 method: str = "poisson", key: str = "id", p: str = "p", y: str = "y") -> DataFrame:
    """Percentile intervals of all point metrics.

    ``method`` 'poisson' stores buckets x replicates (``replicate_matrix``); 'exact' keeps
    the size of both classes and stores rows x replicates.
    """
    if method not in ("exact", "poisson"):
        raise ValueError(f"method must be exact or poisson, not {method!r}")
    rows = pred.select(key, p, y)
    reps = (replicate_metrics(draw_exact(rows, n_boot, seed, key, [y]), threshold, p, y) if method == "exact"
            else replicate_matrix(rows, threshold, n_boot, seed, key, p, y))
    return percentile_interval(reps, BOOT_METRICS, alpha)


def full_report(pred: DataFrame, threshold: float, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05,
                key: str = "id", p: str = "p", y: str = "y", client: str = "client") -> DataFrame:
    """Everything per scope (each site and global): the point metrics of ``metric_report``, calibration slope, F1 at
    0.5, sensitivity at fixed specificities, and ``<metric>_lo`` / ``<metric>_hi`` for every bootstrapped metric.

    Scopes with one class have counts and prevalence only.
    """
    rows = site_scopes(pred.select(key, client, p, y), client).select("scope", key, p, y)
    reps = replicate_matrix(rows, threshold, n_boot, seed, key, p, y, ["scope"])
    ends = percentile_interval(reps, BOOT_METRICS, alpha, ["scope"])
    ends = ends.groupBy("scope").agg(*[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}")
                                       for m in BOOT_METRICS for e in ("lo", "hi")])
    half = threshold_metrics(rows, 0.5, p, y, ["scope"]).select("scope", F.col("f1").alias("f1_at_half"))
    more = (half.join(sensitivities(rows, p, y, ["scope"]), "scope").join(ends, "scope", "left")
            .join(calibration_slope(rows, p, y, ["scope"]), "scope", "left"))
    report = metric_report(pred, threshold, p, y, client)
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return report.join(more, "scope").select(
        *report.columns, *[F.when(both, F.col(c)).alias(c) for c in more.columns if c != "scope"])


def _average_precision(frame: DataFrame, p: str, y: str, by: Sequence[str], name: str, w: Column) -> DataFrame:
    merged = frame.groupBy(*by, p, y).agg(F.sum(w).alias("_w"))
    return score_curve(merged, p, y, by, F.col("_w")).groupBy(*by).agg(auprc_of().alias(name))


def bootstrap_auprc_diff(pred: DataFrame, n_boot: int = 1000, seed: int = 0, key: str = "id",
                         p1: str = "p1", p2: str = "p2", y: str = "y", method: str = "poisson") -> DataFrame:
    """Paired bootstrap of AUPRC(p1) - AUPRC(p2): observed, lower 2.5 %, two-sided p.

    Both models see the same draws; replicates with one class are skipped.
    """
    rows = pred.select(key, y, p1, p2)
    d = F.col("d")
    if method == "exact":
        drawn = draw_exact(rows.withColumn("_all", F.lit(0)), n_boot, seed, key, ["_all"]).drop("_all")
        drawn = _merge(drawn, "b", p1, p2, y)
        a, b = (_average_precision(drawn, p, y, ["b"], f"ap_{p}", F.col("w")) for p in (p1, p2))
        reps = a.join(b, "b").select((F.col(f"ap_{p1}") - F.col(f"ap_{p2}")).alias("d"))
    else:
        models = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(c).alias("p")) for i, c in enumerate((p1, p2))]))
        long = rows.select(key, y, models.alias("_m")).select(key, y, "_m.model", "_m.p")
        each = replicate_matrix(long, 0.5, n_boot, seed, key, "p", y, ["model"])
        sign = F.when(F.col("model") == 0, F.col("auprc")).otherwise(-F.col("auprc"))
        reps = each.groupBy("b").agg(F.when(F.count("auprc") == 2, F.sum(sign)).alias("d"))
    reps = reps.where(d.isNotNull())
    tails = reps.agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.avg((d <= 0).cast("double")).alias("le"),
                     F.avg((d >= 0).cast("double")).alias("ge"), F.count(F.lit(1)).alias("n_replicates"))
    one = F.lit(1)
    observed = [_average_precision(rows, p, y, [], "v", one).select("v").scalar() for p in (p1, p2)]
    return tails.select((observed[0] - observed[1]).alias("diff"), "lo",
                        (2 * F.least("le", "ge")).alias("p_value"), "n_replicates")


def delong(pred: DataFrame, p1: str = "p1", p2: str = "p2", y: str = "y") -> DataFrame:
    """DeLong's test of two AUROCs on the same rows: auc1, auc2, z (null if no variance).

    A positive's placement is the share of negatives scored below it, a negative's
    the share of positives above it; both depend on the score only, so they are
    looked up from the prefix counts of each model. Rows are merged to distinct
    (outcome, score pair) first.
    """
    # ascending: *_before counts lower scores
    def placements(p: str, name: str) -> DataFrame:
        c = running_totals(pred, p, {"pos": F.col(y), "neg": 1 - F.col(y)})
        return c.select(
            F.col(p), ((F.col("neg_before") + F.col("neg") / 2.0) / F.col("neg_total")).alias(f"_pos_{name}"),
            (1.0 - (F.col("pos_before") + F.col("pos") / 2.0) / F.col("pos_total")).alias(f"_neg_{name}"))

    pairs = pred.groupBy(y, p1, p2).agg(F.count(F.lit(1)).alias("c"))
    both = salted_join(pairs, placements(p1, "a"), [p1], [p2, y], measure=pred)
    both = salted_join(both, placements(p2, "b"), [p2], [p1, y], measure=pred)
    v = {k: F.when(F.col(y) == 1, F.col(f"_pos_{k}")).otherwise(F.col(f"_neg_{k}")) for k in "ab"}
    c, a, b = F.col("c"), v["a"], v["b"]
    m = both.groupBy(y).agg(F.sum(c).alias("n"), *[F.sum(c * x).alias(k) for k, x in (
        ("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))])
    n = F.col("n")
    var = m.select(y, "n", (F.col("a") / n).alias("mean_a"), (F.col("b") / n).alias("mean_b"),
                   *[((F.col(k[0] + k[1]) - F.col(k[0]) * F.col(k[1]) / n) / (n - 1) / n).alias(f"c_{k}")
                     for k in ("aa", "bb", "ab")])
    one = F.col(y) == 1
    out = var.agg(F.max(F.when(one, F.col("mean_a"))).alias("auc1"), F.max(F.when(one, F.col("mean_b"))).alias("auc2"),
                  F.sum(F.col("c_aa") + F.col("c_bb") - 2 * F.col("c_ab")).alias("var"))
    return out.select("auc1", "auc2", (F.col("auc1") - F.col("auc2")).alias("diff"),
                      F.when(F.col("var") > 0, (F.col("auc1") - F.col("auc2")) / F.sqrt("var")).alias("z"))


def delong_test(pred: DataFrame, p1: str = "p1", p2: str = "p2", y: str = "y") -> DataFrame:
    return delong(pred, p1, p2, y).withColumn("p_value", p_normal("z"))


def paired_predictions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Scores of two models on the rows both have: (key, y, client, p1, p2)."""
    left = a.select(key, "y", "client", F.col("p").alias("p1"))
    return left.join(b.select(key, F.col("p").alias("p2")), key)


def lift(auprc: Column, prevalence: Column) -> Column:
    return ratio(auprc, prevalence)

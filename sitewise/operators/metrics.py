"""Discrimination, calibration and decision metrics of scored rows (y in {0, 1}, score p).

Everything that depends on the order of the scores starts from ``score_curve``:
one row per distinct score with the counts above it. Ties are therefore exact and
no task ever sorts a whole group. ``by`` groups (sites, replicates) run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import logit, ratio
from sitewise.operators.joins import join_by_size, lookup_join
from sitewise.operators.ordered import exact_quantiles, hash_rank, running_totals, with_position
from sitewise.session import store

FEW_EVENTS = 15


# --- curves -----------------------------------------------------------------------

def score_curve(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                weight: Column | None = None) -> DataFrame:
    """Distinct scores from high to low: n, pos, tp, fp, and group totals n_total, pos_total."""
    w = F.lit(1) if weight is None else weight
    curve = running_totals(pred, p, {"n": w, "pos": w * F.col(y)}, by, descending=True, index="idx")
    tp = F.col("pos_before") + F.col("pos")
    return (curve.withColumn("tp", tp)
            .withColumn("fp", F.col("n_before") + F.col("n") - tp)
            .withColumn("neg_total", F.col("n_total") - F.col("pos_total")))


def auroc_of() -> Column:
    """Aggregate over a curve: P(score of a positive > score of a negative), ties 1/2."""
    neg = F.col("n") - F.col("pos")
    pairs = F.sum(neg * (F.col("pos_before") + F.col("pos") / 2.0))
    return F.try_divide(pairs, F.max("pos_total").cast("double") * F.max("neg_total"))


def auprc_of() -> Column:
    """Aggregate over a curve: average precision (step sum over distinct scores)."""
    hits = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return F.when(F.max("neg_total") > 0, F.try_divide(hits, F.max("pos_total").cast("double")))


def f1_at(tp: Column, fp: Column, pos_total: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, tp + fp + pos_total), F.lit(0.0))


def best_f1_of() -> Column:
    """Aggregate over a curve: struct(f1, threshold); the highest threshold wins ties."""
    score = F.struct(f1_at(F.col("tp"), F.col("fp"), F.col("pos_total")).alias("f1"),
                     F.col("_p").alias("threshold"))
    none = F.struct(F.lit(0.0).alias("f1"), F.lit(0.5).alias("threshold"))
    return F.when(F.max("pos_total") > 0, F.max(score)).otherwise(none)


def ranking_metrics(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                    weight: Column | None = None) -> DataFrame:
    """AUROC, AUPRC, lift over prevalence, best F1 and its threshold, per group."""
    by = list(by)
    curve = score_curve(pred, p, y, by, weight).withColumn("_p", F.col(p))
    out = curve.groupBy(*by).agg(
        F.max("n_total").alias("n"), F.max("pos_total").alias("n_pos"),
        auroc_of().alias("auroc"), auprc_of().alias("auprc"), best_f1_of().alias("_best"))
    prevalence = ratio(F.col("n_pos"), F.col("n"))
    return out.select(*by, "n", "n_pos", prevalence.alias("prevalence"), "auroc", "auprc",
                      F.try_divide(F.col("auprc"), prevalence).alias("lift"),
                      F.col("_best.f1").alias("best_f1"), F.col("_best.threshold").alias("best_threshold"))


def roc_points(pred: DataFrame, p: str = "p", y: str = "y", max_points: int | None = 500) -> DataFrame:
    """ROC curve from (0, 0) at an infinite threshold, thinned to every k-th point
    (``max_points=None`` keeps all)."""
    curve = score_curve(pred, p, y)
    step = (F.lit(1).cast("long") if max_points is None
            else F.greatest(F.lit(1), F.floor((F.col("idx_total") + 1) / max_points)))
    point = curve.select(
        (F.col("idx") + 1).alias("idx"), (F.col("fp") / F.col("neg_total")).alias("fpr"),
        (F.col("tp") / F.col("pos_total")).alias("tpr"), F.col(p).alias("threshold"), step.alias("_step"))
    start = pred.sparkSession.createDataFrame(
        [(0, 0.0, 0.0, float("inf"), 1)], "idx long, fpr double, tpr double, threshold double, _step long")
    return (start.unionByName(point).where(F.pmod(F.col("idx"), F.col("_step")) == 0).drop("_step"))


def pr_points(pred: DataFrame, p: str = "p", y: str = "y", max_points: int = 500) -> DataFrame:
    """Precision-recall curve from the lowest threshold up to (1, 0), thinned likewise."""
    curve = score_curve(pred, p, y)
    total = F.col("idx_total")
    step = F.greatest(F.lit(1), F.floor((total + 1) / max_points))
    point = curve.select(
        (total - 1 - F.col("idx")).alias("idx"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("pos_total")).alias("recall"), step.alias("_step"))
    last = curve.agg(F.max("idx_total").alias("idx"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"), F.max(step).alias("_step"))
    return point.unionByName(last).where(F.pmod(F.col("idx"), F.col("_step")) == 0).drop("_step")


def sensitivity_at_specificity(pred: DataFrame, p: str = "p", y: str = "y",
                               targets: Sequence[float] = (0.80, 0.90, 0.95)) -> DataFrame:
    """Per target: the curve point of nearest specificity (the first one wins)."""
    pts = roc_points(pred, p, y, max_points=None)
    spec = 1.0 - F.col("fpr")
    best = [F.min(F.struct(F.abs(spec - t), "idx", "tpr", "threshold")).alias(f"_t{i}")
            for i, t in enumerate(targets)]
    row = pts.agg(*best)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}.tpr").alias("sensitivity"),
                 F.col(f"_t{i}.threshold").alias("threshold")) for i, t in enumerate(targets)])))


def sensitivities(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                  targets: Sequence[float] = (0.80, 0.90, 0.95)) -> DataFrame:
    """Per group one column for each target specificity: sensitivity at the nearest curve point, the first one wins."""
    by = list(by)
    spec = 1.0 - F.try_divide("fp", "neg_total")
    tpr = F.try_divide("tp", "pos_total")

    def at(target: float) -> Column:
        start = F.struct(F.lit(abs(1.0 - target)).alias("d"), F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("s"))
        point = F.min(F.struct(F.abs(spec - target).alias("d"), F.col("idx").cast("long").alias("i"), tpr.alias("s")))
        return F.least(start, point)["s"].alias(f"sens_at_{round(100 * target)}")

    return score_curve(pred, p, y, by).groupBy(*by).agg(*[at(t) for t in targets])


# --- thresholds ---------------------------------------------------------------------

def threshold_metrics(pred: DataFrame, threshold: Column | float, p: str = "p", y: str = "y",
                      by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Confusion counts and rates at p >= threshold; undefined rates are null, F1 is 0."""
    by = list(by)
    w = F.lit(1) if weight is None else weight
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    hit, pos = F.col(p) >= t, F.col(y) == 1
    base = pred.groupBy(*by).agg(
        F.sum(F.when(hit & pos, w).otherwise(0)).alias("tp"), F.sum(F.when(hit & ~pos, w).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & pos, w).otherwise(0)).alias("fn"), F.sum(F.when(~hit & ~pos, w).otherwise(0)).alias("tn"),
        ratio(F.sum(w * (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), F.sum(w)).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    both = F.coalesce((sens + spec) / 2.0, sens, spec)
    return base.select(
        *by, "tp", "fp", "fn", "tn", sens.alias("sensitivity"), spec.alias("specificity"),
        ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), both.alias("balanced_accuracy"),
        f1_at(tp, fp, tp + fn).alias("f1"), "brier")


def counts_at(pred: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "y",
              by: Sequence[str] = ()) -> DataFrame:
    """tp and fp at each threshold, all thresholds in one pass.

    A row is counted once, in the slot between two thresholds; the few slots per
    group are then summed from the top.
    """
    by = list(by)
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    slots = with_position(pred, "_k", cuts, F.col(p), len(thresholds).bit_length()).groupBy(*by, "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"))
    packed = slots.groupBy(*by).agg(
        F.collect_list(F.struct("_k", "_n", "_pos")).alias("_s"),
        F.sum("_n").alias("n"), F.sum("_pos").alias("n_pos"))

    def above(i: Column, field: str) -> Column:
        return F.aggregate(F.filter("_s", lambda s: s["_k"] > i), F.lit(0).cast("long"),
                           lambda a, s: a + s[field].cast("long"))

    rows = F.transform(cuts, lambda t, i: F.struct(
        t.alias("threshold"), above(i, "_pos").alias("tp"),
        (above(i, "_n") - above(i, "_pos")).alias("fp")))
    return packed.select(*by, "n", "n_pos", F.inline(rows))


# fixed values: the thresholds of the F1 grid and of the decision curve
F1_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
DECISION_GRID = tuple(round(0.01 * i, 2) for i in range(1, 51))


def f1_grid(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """F1 at the 19 grid thresholds."""
    c = counts_at(pred, F1_GRID, p, y, by)
    return c.select(*by, "threshold", "tp", "fp", f1_at(F.col("tp"), F.col("fp"), F.col("n_pos")).alias("f1"))


def f1_grid_best(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    g = f1_grid(pred, p, y, by)
    return g.groupBy(*by).agg(F.max("f1").alias("f1_max"),
                              F.max(F.when(F.col("threshold") == 0.5, F.col("f1"))).alias("f1_at_half"))


def decision_curve(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Net benefit of acting at each threshold against acting on all or none."""
    c = counts_at(pred, DECISION_GRID, p, y, by)
    odds = F.col("threshold") / (1.0 - F.col("threshold"))
    prev = F.col("n_pos") / F.col("n")
    return c.select(*by, "threshold",
                    (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit_model"),
                    (prev - (1.0 - prev) * odds).alias("net_benefit_treat_all"),
                    F.lit(0.0).alias("net_benefit_treat_none"))


def pick_threshold(val: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                   fallback: float | None = None, min_events: int = FEW_EVENTS) -> DataFrame:
    """Operating point per group from validation rows.

    With enough events: the F1-optimal cut. Otherwise the fallback, or else the
    score quantile at 1 - prevalence.
    """
    by = list(by)
    best = ranking_metrics(val, p, y, by).select(*by, "n_pos", "best_threshold")
    if fallback is not None:
        few = F.lit(float(fallback))
        joined = best
    else:
        joined = _prevalence_quantile(val, p, y, by)
        joined = best.join(joined, by, "left") if by else best.withColumn("_q", joined.select("_q").scalar())
        few = F.col("_q")
    enough = F.col("n_pos") >= min_events
    return joined.select(*by, "n_pos", F.when(enough, F.col("best_threshold")).otherwise(few).alias("threshold"),
                         F.when(enough, "f1").otherwise("fallback" if fallback is not None else "prevalence")
                         .alias("source"))


def _prevalence_quantile(val: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Linear quantile of p at 1 - max(prevalence, 1e-6), per group."""
    c = running_totals(val, p, {"n": F.lit(1), "pos": F.col(y)}, by)
    share = F.greatest(F.col("pos_total") / F.col("n_total"), F.lit(1e-6))
    at = (F.col("n_total") - 1) * (1.0 - share)
    lo, hi, frac = F.floor(at), F.ceil(at), at - F.floor(at)

    def value(rank: Column) -> Column:
        inside = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(p)))

    g = c.groupBy(*by).agg(value(lo).alias("_lo"), value(hi).alias("_hi"), F.max(frac).alias("_f"))
    return g.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("_q"))


# --- calibration ----------------------------------------------------------------------

def brier(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    d = F.col(p) - F.col(y)
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"),
                                 F.avg(y).alias("prevalence"), F.avg(d * d).alias("brier"))


def _weighted_mean(x: Column, weight: Column | None) -> Column:
    """Mean of the rows that have a value, each counted ``weight`` times."""
    if weight is None:
        return F.avg(x)
    return F.try_divide(F.sum(weight * x), F.sum(F.when(x.isNotNull(), weight)))


def ece(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (), n_bins: int = 10,
        weight: Column | None = None) -> DataFrame:
    """Expected calibration error over equal-width, right-closed bins."""
    by = list(by)
    edges = [i / n_bins for i in range(1, n_bins)]
    slot = sum((F.when(F.col(p) > e, 1).otherwise(0) for e in edges), F.lit(0))
    bins = pred.groupBy(*by, slot.alias("_b")).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("n"),
        F.abs(_weighted_mean(F.col(y), weight) - _weighted_mean(F.col(p), weight)).alias("gap"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def calibration_intercept(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                          weight: Column | None = None) -> DataFrame:
    """logit(prevalence) minus the mean logit of the scores."""
    g = pred.groupBy(*by).agg(_weighted_mean(F.col(y), weight).alias("_r"), _weighted_mean(logit(p), weight).alias("_z"))
    return g.select(*by, F.when((F.col("_r") > 0) & (F.col("_r") < 1), logit("_r") - F.col("_z"))
                    .alias("calib_intercept"))


def quantile_edges(pred: DataFrame, p: str, n_bins: int) -> Column:
    """Unique quantile cut points as one ascending array (scalar subquery)."""
    probs = {f"_e{i}": i / n_bins for i in range(n_bins + 1)}
    q = exact_quantiles(pred, p, probs)
    return q.select(F.array_sort(F.array_distinct(F.array(*probs))).alias("e")).scalar()


def calibration_curve(pred: DataFrame, p: str = "p", y: str = "y", n_bins: int = 10) -> DataFrame:
    """Reliability by quantile bins [lo, hi), the last one closed."""
    binned = pred.withColumn("_e", quantile_edges(pred, p, n_bins)).where(F.size("_e") > 1)
    slot = F.least(F.col("_k") - 1, F.size("_e") - 2)
    g = with_position(binned, "_k", F.col("_e"), F.col(p), (n_bins + 1).bit_length())
    g = g.groupBy(slot.alias("bin")).agg(
        F.min(F.get("_e", slot)).alias("bin_lo"), F.min(F.get("_e", slot + 1)).alias("bin_hi"),
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("observed_rate"))
    return g


def risk_deciles(pred: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Calibration deciles with the top bin's rate over the bottom bin's."""
    c = calibration_curve(pred, p, y, 10)
    ends = c.agg(F.max_by("observed_rate", "bin").alias("t"), F.min_by("observed_rate", "bin").alias("b"))
    return c.withColumn("top_to_bottom", ends.select(F.try_divide("t", "b")).scalar())


def fit_logistic(points: DataFrame, z: str = "z", y: str = "y", by: Sequence[str] = (), ridge: float = 1e-6,
                 rounds: int = 40, tol: float = 1e-10) -> DataFrame:
    """sigmoid(a * z + b) fitted per group by Newton steps: (by, slope, intercept).

    Rows are first merged to distinct (group, z) counts. The groups' states are a table: each step joins it to the
    counts, sums once for all groups together and writes the next states; converged groups leave. The driver sees
    one number per step, how many groups still move. Groups with one class or one score, and those that still
    move after ``rounds``, get nulls.
    """
    whole = not by
    by = ["_all"] if whole else list(by)
    if whole:
        points = points.withColumn("_all", F.lit(0))
    merged = store(points.where(F.col(z).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(z).alias("_z"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y")), "logistic-counts")
    sizes = merged.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_y").alias("k"), F.max("_z").alias("hi"), F.min("_z").alias("lo"))
    usable = (F.col("k") > 0) & (F.col("k") < F.col("n")) & (F.col("hi") > F.col("lo"))
    moving = store(sizes.where(usable).select(*by, F.lit(1.0).alias("_a"), F.lit(0.0).alias("_b")), "logistic-states")
    settled = moving.limit(0)
    a, b, zc = F.col("_a"), F.col("_b"), F.col("_z")
    prob = 1.0 / (1.0 + F.exp(-(a * zc + b)))
    err, curv = F.col("_y") - F.col("_n") * prob, F.col("_n") * prob * (1.0 - prob)
    for _ in range(rounds):
        if moving.isEmpty():
            break
        sums = join_by_size(merged, moving, by, ["_z"]).groupBy(*by, "_a", "_b").agg(
            (F.sum(err * zc) - ridge * a).alias("ga"), F.sum(err).alias("gb"), (F.sum(curv * zc * zc) + ridge).alias("haa"),
            F.sum(curv * zc).alias("hab"), F.sum(curv).alias("hbb"))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        solved = sums.withColumn("_det", det).where(F.col("_det") > 0).select(
            *by, "_a", "_b", ((F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / F.col("_det")).alias("_da"),
            ((F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / F.col("_det")).alias("_db"))
        size = F.greatest(F.abs("_da"), F.abs("_db"))
        scale = F.when(size > 5.0, 5.0 / size).otherwise(1.0)           # long steps are shortened
        after = store(solved.select(*by, (a + scale * F.col("_da")).alias("_a"), (b + scale * F.col("_db")).alias("_b"),
                                    (size >= tol).alias("_moves")), "logistic-states")
        settled = settled.unionByName(after.where(~F.col("_moves")).drop("_moves"))
        moving = after.where("_moves").drop("_moves")
    fitted = settled.select(*by, a.alias("slope"), b.alias("intercept"))
    out = sizes.select(*by).join(fitted, by, "left")
    return out.drop("_all") if whole else out


def calibration_slope(pred: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Slope of the outcome on the logit of the score (1 is ideal, below 1 over-fitted)."""
    fitted = fit_logistic(pred.withColumn("_logit", logit(p)), "_logit", y, by)
    return fitted.select(*by, F.col("slope").alias("calib_slope"))


def platt_apply(rows: DataFrame, fitted: DataFrame, z: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Calibrated probabilities; groups without a fit keep the plain sigmoid."""
    by = list(by)
    a, c = F.coalesce("slope", F.lit(1.0)), F.coalesce("intercept", F.lit(0.0))
    if by:
        joined = rows.join(fitted, by, "left")
    else:
        joined = (rows.withColumn("slope", fitted.select("slope").scalar())
                  .withColumn("intercept", fitted.select("intercept").scalar()))
    return joined.withColumn("p_cal", 1.0 / (1.0 + F.exp(-(a * F.col(z) + c)))).drop("slope", "intercept")


# --- reports -------------------------------------------------------------------------

def site_scopes(pred: DataFrame, client: str = "client") -> DataFrame:
    """Every row twice: once for its site, once for the global scope."""
    return pred.withColumn("scope", F.explode(F.array(F.lit("global"), F.col(client))))


def metric_report(pred: DataFrame, thresholds: DataFrame | float | None = None, p: str = "p", y: str = "y",
                  client: str = "client") -> DataFrame:
    """All point metrics for the global scope and every site.

    ``thresholds``: one number, or a frame (scope, threshold) chosen on validation
    rows; None takes the F1-optimal cut of the scored rows themselves and says so.
    A scope with one class has counts and prevalence only: no metric is defined there. Rows are merged to distinct
    (site, score, outcome) with their number once; the global scope copies that table, and every part reads it.
    """
    merged = store(pred.groupBy(client, p, y).agg(F.count(F.lit(1)).alias("_w")), "scored-counts")
    rows, w = site_scopes(merged, client), F.col("_w")
    rank = ranking_metrics(rows, p, y, ["scope"], w)
    if thresholds is None:
        cut = rank.select("scope", F.col("best_threshold").alias("threshold"))
    elif isinstance(thresholds, DataFrame):
        cut = thresholds.select("scope", "threshold")
    else:
        cut = rank.select("scope", F.lit(float(thresholds)).alias("threshold"))
    at = threshold_metrics(lookup_join(rows, cut, ["scope"], [p]), F.col("threshold"), p, y, ["scope", "threshold"], w)
    report = (rank.select("scope", "n", "n_pos", "prevalence", "auroc", "auprc", "lift")
              .join(at, "scope").join(ece(rows, p, y, ["scope"], weight=w), "scope")
              .join(calibration_intercept(rows, p, y, ["scope"], w), "scope"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    told = ("scope", "n", "n_pos", "prevalence", "threshold")
    report = report.select(*[F.col(c) if c in told else F.when(both, F.col(c)).alias(c) for c in report.columns])
    return (report.withColumn("threshold_source", F.lit("validation" if thresholds is not None else "same rows (biased)"))
            .withColumn("few_events", (F.col("n_pos") < FEW_EVENTS).cast("int")))


def permuted(pred: DataFrame, key: str = "id", p: str = "p", seed: int = 0) -> DataFrame:
    """Negative control: the scores dealt out to the rows in another seeded order."""
    a = hash_rank(pred.drop(p), [key], f"{seed}a", name="_r", total="_n").drop("_n")
    b = hash_rank(pred.select(key, p), [key], f"{seed}b", name="_r", total="_n").select("_r", p)
    return a.join(b, "_r").drop("_r")

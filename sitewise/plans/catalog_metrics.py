"""Queries: metrics of scored rows, calibration, curves, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.scalars import logit, poisson_cdf
from sitewise.operators import experiments, inference, metrics
from sitewise.operators.ordered import midranks
from sitewise.operators.replicates import METRICS, draw_sql
from sitewise.plans import fixtures as fx
from sitewise.plans.catalog_cohort import r6
from sitewise.plans.registry import query, sql_p_normal


def _pred(spark, sf, p="p1"):
    return fx.predictions(spark, sf).withColumnRenamed(p, "p").select("id", "client", "y", "p")


def _rounded(df, *skip):
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" and c not in skip else c for c in df.columns])


# distinct scores from high to low with running counts; {by} is '' or a column with a comma
def _curve(by="", src="fx_pred", p="p1", w="1"):
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""
    s AS (SELECT {by}{p} AS p, sum({w})::DOUBLE AS n, sum({w} * y)::DOUBLE AS pos FROM {src} GROUP BY {by}{p}),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER t AS np, sum(n - pos) OVER t AS nn,
                 row_number() OVER w - 1 AS idx, count(*) OVER t AS k
          FROM s WINDOW w AS ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING), t AS ({part}))"""


_AUROC = "sum((n - pos) * (tp - pos / 2)) / (max(np) * max(nn))"
_AUPRC = "sum(pos * tp / (tp + fp)) / max(np)"
_F1 = "2 * tp / (tp + fp + np)"


@query("auroc", f"""WITH {_curve()} SELECT round({_AUROC}, 6) AS auroc,
    CAST(sum(n) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS n_pos FROM c""")
def auroc(spark, sf):
    return metrics.ranking_metrics(_pred(spark, sf)).select(r6("auroc").alias("auroc"), "n", "n_pos")


@query("auprc", f"""WITH {_curve()} SELECT round({_AUPRC}, 6) AS auprc, round(max(np) / sum(n), 6) AS prevalence,
    round({_AUPRC} / (max(np) / sum(n)), 6) AS lift FROM c""")
def auprc(spark, sf):
    return _rounded(metrics.ranking_metrics(_pred(spark, sf)).select("auprc", "prevalence", "lift"))


@query("client_auprc", f"""WITH {_curve("client, ")}
    SELECT client, round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc, CAST(max(np) AS BIGINT) AS n_pos,
           CAST(max(np) < 15 AS INTEGER) AS few_events FROM c GROUP BY client""")
def client_auprc(spark, sf):
    m = metrics.ranking_metrics(_pred(spark, sf), by=["client"])
    return _rounded(m.select("client", "auroc", "auprc", "n_pos",
                             (F.col("n_pos") < metrics.FEW_EVENTS).cast("int").alias("few_events")))


@query("best_f1_threshold", f"""WITH {_curve()}
    SELECT round({_F1}, 6) AS best_f1, p AS best_threshold FROM c ORDER BY {_F1} DESC, p DESC LIMIT 1""")
def best_f1_threshold(spark, sf):
    return metrics.ranking_metrics(_pred(spark, sf)).select(r6("best_f1").alias("best_f1"), "best_threshold")


_CONF = """
    count(*) FILTER ({p} >= {t} AND y = 1) AS tp, count(*) FILTER ({p} >= {t} AND y = 0) AS fp,
    count(*) FILTER ({p} < {t} AND y = 1) AS fn, count(*) FILTER ({p} < {t} AND y = 0) AS tn,
    avg(({p} - y) * ({p} - y)) AS brier"""
_RATES = """round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity,
    round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
    round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    round(coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0),
          tn / nullif(tn + fp, 0)), 6) AS balanced_accuracy,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(brier, 6) AS brier"""


@query("threshold_metrics", f"""WITH m AS (SELECT client, {_CONF.format(p='p1', t='0.45')} FROM fx_pred GROUP BY client)
    SELECT client, tp, fp, fn, tn, {_RATES} FROM m""")
def threshold_metrics(spark, sf):
    return _rounded(metrics.threshold_metrics(_pred(spark, sf), 0.45, by=["client"]))


@query("f1_grid", """
    WITH t AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 20) r(i)),
    g AS (SELECT client, threshold, count(*) FILTER (p1 >= threshold AND y = 1) AS tp,
                 count(*) FILTER (p1 >= threshold AND y = 0) AS fp, sum(y) AS np FROM fx_pred, t GROUP BY ALL)
    SELECT client, threshold, tp, fp, round(coalesce(2 * tp / nullif(tp + fp + np, 0), 0), 6) AS f1 FROM g""")
def f1_grid(spark, sf):
    return _rounded(metrics.f1_grid(_pred(spark, sf), by=["client"]), "threshold")


@query("f1_grid_best", """
    WITH t AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 20) r(i)),
    g AS (SELECT client, threshold, count(*) FILTER (p1 >= threshold AND y = 1) AS tp,
                 count(*) FILTER (p1 >= threshold AND y = 0) AS fp, sum(y) AS np FROM fx_pred, t GROUP BY ALL)
    SELECT client, round(max(coalesce(2 * tp / nullif(tp + fp + np, 0), 0)), 6) AS f1_max,
           round(max(coalesce(2 * tp / nullif(tp + fp + np, 0), 0)) FILTER (threshold = 0.5), 6) AS f1_at_half
    FROM g GROUP BY client""")
def f1_grid_best(spark, sf):
    return _rounded(metrics.f1_grid_best(_pred(spark, sf), by=["client"]))


@query("decision_curve", """
    WITH t AS (SELECT round(0.01 * i, 2)::DOUBLE AS threshold FROM range(1, 51) r(i)),
    g AS (SELECT threshold, count(*) FILTER (p1 >= threshold AND y = 1) AS tp,
                 count(*) FILTER (p1 >= threshold AND y = 0) AS fp, count(*) AS n, avg(y) AS prev
          FROM fx_pred, t GROUP BY threshold)
    SELECT threshold, round(tp / n - fp / n * (threshold / (1 - threshold)), 6) AS net_benefit_model,
           round(prev - (1 - prev) * (threshold / (1 - threshold)), 6) AS net_benefit_treat_all,
           0.0::DOUBLE AS net_benefit_treat_none FROM g""")
def decision_curve(spark, sf):
    return _rounded(metrics.decision_curve(_pred(spark, sf)), "threshold")


@query("brier", """
    SELECT client, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) AS prevalence,
           round(avg((p1 - y) * (p1 - y)), 6) AS brier FROM fx_pred GROUP BY client""")
def brier(spark, sf):
    return _rounded(metrics.brier(_pred(spark, sf), by=["client"]))


@query("ece", """
    WITH b AS (SELECT client, (SELECT count(*) FROM range(1, 10) r(i) WHERE p1 > i / 10.0::DOUBLE) AS b, count(*) AS n,
                      abs(avg(y) - avg(p1)) AS gap FROM fx_pred GROUP BY ALL)
    SELECT client, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY client""")
def ece(spark, sf):
    return _rounded(metrics.ece(_pred(spark, sf), by=["client"]))


@query("calib_intercept", """
    SELECT client, round(ln(avg(y) / (1 - avg(y))) - avg(ln(p1 / (1 - p1))), 6) AS calib_intercept
    FROM fx_pred GROUP BY client""")
def calib_intercept(spark, sf):
    return _rounded(metrics.calibration_intercept(_pred(spark, sf), by=["client"]))


def _newton_sql(steps=9, src="fx_pred"):
    """Newton steps for sigmoid(a z + c), the same number for every client, spelled out."""
    out = [f"z AS (SELECT client, y, ln(p1 / (1 - p1)) AS z FROM {src})",
           "n0 AS (SELECT client, 1.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM z GROUP BY client)"]
    for i in range(steps):
        out.append(f"""g{i} AS (SELECT client, any_value(a) AS a, any_value(c) AS c, sum((y - q) * z) - 1e-6 * any_value(a) AS ga,
            sum(y - q) AS gb, sum(q * (1 - q) * z * z) + 1e-6 AS haa, sum(q * (1 - q) * z) AS hab, sum(q * (1 - q)) AS hbb
            FROM (SELECT z.client, y, z, a, c, 1 / (1 + exp(-(a * z + c))) AS q FROM z JOIN n{i} ON z.client = n{i}.client)
            GROUP BY client)""")
        out.append(f"""n{i + 1} AS (SELECT client, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
            c + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS c FROM g{i})""")
    return "WITH " + ", ".join(out), f"n{steps}"


_NEWTON, _NEWTON_LAST = _newton_sql()


@query("calib_slope", f"{_NEWTON} SELECT client, round(a, 5) AS calib_slope FROM {_NEWTON_LAST}")
def calib_slope(spark, sf):
    return metrics.calibration_slope(_pred(spark, sf), by=["client"]).withColumn(
        "calib_slope", F.round("calib_slope", 5))


@query("platt_apply", f"""{_NEWTON}
    SELECT f.client, count(*) AS n, round(avg(pc), 5) AS mean_calibrated, round(avg(pow(pc - y, 2)), 5) AS brier_calibrated
    FROM (SELECT z.client, z.y, 1 / (1 + exp(-(a * z.z + c))) AS pc FROM z JOIN {_NEWTON_LAST} m ON z.client = m.client) f
    GROUP BY f.client""")
def platt_apply(spark, sf):
    rows = _pred(spark, sf).withColumn("z", logit("p"))
    cal = metrics.platt_apply(rows, metrics.fit_logistic(rows, "z", by=["client"]), "z", ["client"])
    d = F.col("p_cal") - F.col("y")
    return cal.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_cal"), 5).alias("mean_calibrated"),
                                     F.round(F.avg(d * d), 5).alias("brier_calibrated"))


@query("roc_points", f"""WITH {_curve()},
    pts AS (SELECT 0 AS idx, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'Infinity'::DOUBLE AS threshold
            UNION ALL SELECT idx + 1, fp / nn, tp / np, p FROM c)
    SELECT idx, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, threshold FROM pts
    WHERE idx % greatest(1, (SELECT count(*) FROM pts) // 100) = 0""")
def roc_points(spark, sf):
    return _rounded(metrics.roc_points(_pred(spark, sf), max_points=100), "threshold")


@query("pr_points", f"""WITH {_curve()},
    pts AS (SELECT k - 1 - idx AS idx, tp / (tp + fp) AS precision, tp / np AS recall FROM c
            UNION ALL SELECT max(k), 1.0, 0.0 FROM c)
    SELECT idx, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pts
    WHERE idx % greatest(1, (SELECT count(*) FROM pts) // 100) = 0""")
def pr_points(spark, sf):
    return _rounded(metrics.pr_points(_pred(spark, sf), max_points=100))


_CALIB = """
    q AS (SELECT quantile_cont(p1, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs FROM fx_pred),
    e AS (SELECT list_sort(list_distinct(qs)) AS e FROM q),
    b AS (SELECT y, p1, e, least(len(list_filter(e, lambda x : x <= p1)) - 1, len(e) - 2) AS bin FROM fx_pred, e),
    cal AS (SELECT CAST(bin AS INTEGER) AS bin, any_value(e[bin + 1]) AS bin_lo, any_value(e[bin + 2]) AS bin_hi,
                   count(*) AS n, avg(p1) AS mean_pred, avg(y) AS observed_rate FROM b GROUP BY bin)"""


@query("calibration_curve", f"""WITH {_CALIB}
    SELECT bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, n, round(mean_pred, 6) AS mean_pred,
           round(observed_rate, 6) AS observed_rate FROM cal""")
def calibration_curve(spark, sf):
    return _rounded(metrics.calibration_curve(_pred(spark, sf)))


@query("risk_deciles", f"""WITH {_CALIB}
    SELECT bin, n, round(observed_rate, 6) AS observed_rate,
           round((SELECT observed_rate FROM cal ORDER BY bin DESC LIMIT 1)
                 / (SELECT observed_rate FROM cal ORDER BY bin LIMIT 1), 6) AS top_to_bottom FROM cal""")
def risk_deciles(spark, sf):
    return _rounded(metrics.risk_deciles(_pred(spark, sf)).select("bin", "n", "observed_rate", "top_to_bottom"))


@query("sens_at_spec", f"""WITH {_curve()},
    pts AS (SELECT 0 AS idx, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'Infinity'::DOUBLE AS threshold
            UNION ALL SELECT idx + 1, fp / nn, tp / np, p FROM c),
    r AS (SELECT t.target, tpr, threshold, row_number() OVER (PARTITION BY t.target
                 ORDER BY abs(1 - fpr - t.target), idx) AS rn
          FROM pts, (SELECT unnest([0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS target) t)
    SELECT target, round(tpr, 6) AS sensitivity, threshold FROM r WHERE rn = 1""")
def sens_at_spec(spark, sf):
    return _rounded(metrics.sensitivity_at_specificity(_pred(spark, sf)), "target", "threshold")


@query("pick_threshold", f"""WITH {_curve("client, ")},
    b AS (SELECT client, max(np) AS np, arg_max(p, {_F1} * 1e6 + p / 1e6) AS bt FROM c GROUP BY client),
    q AS (SELECT client, quantile_cont(p1, 0.0) AS dummy, avg(y) AS prev, list_sort(list(p1)) AS ps FROM fx_pred GROUP BY client),
    h AS (SELECT client, ps, (len(ps) - 1) * (1 - greatest(prev, 1e-6)) AS ai FROM q)
    SELECT b.client, CAST(np AS BIGINT) AS n_pos,
           round(CASE WHEN np >= 190 THEN bt ELSE ps[CAST(floor(ai) AS BIGINT) + 1]
                 + (ps[CAST(ceil(ai) AS BIGINT) + 1] - ps[CAST(floor(ai) AS BIGINT) + 1]) * (ai - floor(ai)) END, 6) AS threshold,
           CASE WHEN np >= 190 THEN 'f1' ELSE 'prevalence' END AS source
    FROM b JOIN h ON b.client = h.client""")
def pick_threshold(spark, sf):
    return _rounded(metrics.pick_threshold(_pred(spark, sf), by=["client"], min_events=190))


@query("metric_report", f"""
    WITH sc AS (SELECT 'global' AS scope, y, p1 FROM fx_pred UNION ALL SELECT client, y, p1 FROM fx_pred),
    {_curve("scope, ", "sc")},
    r AS (SELECT scope, sum(n) AS n, max(np) AS np, {_AUROC} AS auroc, {_AUPRC} AS auprc FROM c GROUP BY scope),
    m AS (SELECT scope, {_CONF.format(p='p1', t='0.45')},
                 ln(avg(y) / (1 - avg(y))) - avg(ln(p1 / (1 - p1))) AS ci FROM sc GROUP BY scope),
    eb AS (SELECT scope, (SELECT count(*) FROM range(1, 10) r(i) WHERE p1 > i / 10.0::DOUBLE) AS b, count(*) AS n,
                  abs(avg(y) - avg(p1)) AS gap FROM sc GROUP BY ALL),
    e AS (SELECT scope, sum(n * gap) / sum(n) AS ece FROM eb GROUP BY scope),
    f AS (SELECT r.scope, CAST(n AS BIGINT) AS n, CAST(np AS BIGINT) AS n_pos, round(np / n, 6) AS prevalence, round(auroc, 6) AS auroc,
           round(auprc, 6) AS auprc, round(auprc / (np / n), 6) AS lift, 0.45::DOUBLE AS threshold, tp, fp, fn, tn, {_RATES},
           round(ece, 6) AS ece, round(ci, 6) AS calib_intercept, 'validation' AS threshold_source,
           CAST(np < 15 AS INTEGER) AS few_events
    FROM r JOIN m ON r.scope = m.scope JOIN e ON e.scope = r.scope)
    SELECT scope, n, n_pos, prevalence, threshold, threshold_source, few_events,
           CASE WHEN n_pos > 0 AND n_pos < n THEN COLUMNS(* EXCLUDE (scope, n, n_pos, prevalence, threshold, threshold_source, few_events)) END
    FROM f""")
def metric_report(spark, sf):
    return _rounded(metrics.metric_report(_pred(spark, sf), 0.45))


def _replicate_sql(by=""):
    """Every bootstrapped metric (``rp``) of weighted rows ``bs`` ({by}b, y, p1, w)."""
    group = f"{by}b"
    return f"""
    s2 AS (SELECT {group}, p1 AS p, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS pos FROM bs WHERE w > 0 GROUP BY {group}, p1),
    c2 AS (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER t AS np, sum(n - pos) OVER t AS nn
           FROM s2 WINDOW w AS (PARTITION BY {group} ORDER BY p DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {group})),
    rk AS (SELECT {group}, CASE WHEN max(np) * max(nn) > 0 THEN {_AUROC} END AS auroc,
                  CASE WHEN max(np) > 0 AND max(nn) > 0 THEN {_AUPRC} END AS auprc FROM c2 GROUP BY {group}),
    ct AS (SELECT {group}, sum(w * (p1 >= 0.45 AND y = 1)::INT)::DOUBLE AS tp, sum(w * (p1 >= 0.45 AND y = 0)::INT)::DOUBLE AS fp,
                  sum(w * (p1 < 0.45 AND y = 1)::INT)::DOUBLE AS fn, sum(w * (p1 < 0.45 AND y = 0)::INT)::DOUBLE AS tn,
                  sum(w * (p1 - y) * (p1 - y)) / sum(w) AS brier FROM bs GROUP BY {group} HAVING sum(w) > 0),
    rp AS (SELECT {by}b, auroc, auprc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp / nullif(tp + fn, 0) AS sensitivity,
                  tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv, brier,
                  (tp + tn) / (tp + fp + fn + tn) AS accuracy,
                  coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) AS balanced_accuracy
           FROM rk JOIN ct USING ({group}))"""


_FULL_B = 200
_FULL_NEWTON, _FULL_LAST = _newton_sql(src="sc")


@query("full_report", f"""{_FULL_NEWTON.replace("WITH ", "WITH sc AS MATERIALIZED (SELECT id, 'global' AS client, y, p1 FROM fx_pred UNION ALL SELECT id, client, y, p1 FROM fx_pred), ", 1)},
    ho AS (SELECT client, 2.0 * count(*) FILTER (p1 >= 0.5 AND y = 1)
                  / (2 * count(*) FILTER (p1 >= 0.5 AND y = 1) + count(*) FILTER (p1 >= 0.5 AND y = 0)
                     + count(*) FILTER (p1 < 0.5 AND y = 1)) AS half FROM sc GROUP BY client),
    {_curve("client, ", "sc")},
    pts AS (SELECT DISTINCT client, -1 AS idx, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM sc
            UNION ALL SELECT client, idx, fp / nn, tp / np FROM c),
    se AS (SELECT client, arg_min(tpr, (abs(1 - fpr - 0.8::DOUBLE), idx)) AS s80, arg_min(tpr, (abs(1 - fpr - 0.9::DOUBLE), idx)) AS s90,
                  arg_min(tpr, (abs(1 - fpr - 0.95::DOUBLE), idx)) AS s95 FROM pts GROUP BY client),
    {draw_sql("sc", _FULL_B, columns=("client", "y", "p1"))},
    {_replicate_sql("client, ")},
    iv AS (SELECT client, {", ".join(f"quantile_cont({m}, 0.025) AS {m}_lo, quantile_cont({m}, 0.975) AS {m}_hi" for m in METRICS)}
           FROM rp GROUP BY client),
    fl AS (SELECT k.client, count(*) AS n, sum(y) AS np FROM sc k GROUP BY k.client)
    SELECT fl.client AS scope, n, CAST(np AS BIGINT) AS n_pos, round(half, 6) AS f1_at_half, round(s80, 6) AS sens_at_80,
           round(s90, 6) AS sens_at_90, round(s95, 6) AS sens_at_95, round(a, 5) AS calib_slope,
           {", ".join(f"round({m}_{e}, 6) AS {m}_{e}" for m in METRICS for e in ("lo", "hi"))}
    FROM fl JOIN ho ON ho.client = fl.client JOIN se ON se.client = fl.client JOIN iv ON iv.client = fl.client
    JOIN {_FULL_LAST} l ON l.client = fl.client""")
def full_report(spark, sf):
    r = inference.full_report(_pred(spark, sf), 0.45, n_boot=_FULL_B)
    cols = ("f1_at_half", "sens_at_80", "sens_at_90", "sens_at_95", *(f"{m}_{e}" for m in METRICS for e in ("lo", "hi")))
    return r.select("scope", "n", "n_pos", *[r6(c).alias(c) for c in cols], F.round("calib_slope", 5).alias("calib_slope"))


@query("permuted_auroc", f"""
    WITH a AS (SELECT y, row_number() OVER (ORDER BY md5('0a-' || id), id) AS r FROM fx_pred),
    b AS (SELECT p1, row_number() OVER (ORDER BY md5('0b-' || id), id) AS r FROM fx_pred),
    sh AS (SELECT y, p1 FROM a JOIN b ON a.r = b.r), {_curve("", "sh")}
    SELECT round({_AUROC}, 6) AS auroc FROM c""")
def permuted_auroc(spark, sf):
    shuffled = metrics.permuted(_pred(spark, sf))
    return _rounded(metrics.ranking_metrics(shuffled).select("auroc"))


@query("midranks", """
    SELECT p1 AS p, n, CAST(r AS DOUBLE) AS rank FROM (
        SELECT p1, count(*) AS n, sum(count(*)) OVER (ORDER BY p1) - count(*) + (count(*) + 1) / 2.0 AS r
        FROM fx_pred GROUP BY p1)""")
def midrank_table(spark, sf):
    return midranks(_pred(spark, sf), "p").select("p", "n", "rank")


def _placed(p):
    """Share of negatives below each positive score, and of positives above each negative."""
    return f"""
    d{p} AS (SELECT p{p} AS p, sum(y) AS a, sum(1 - y) AS b FROM fx_pred GROUP BY 1),
    k{p} AS (SELECT p, (sum(b) OVER w - b / 2.0) / (SELECT sum(1 - y) FROM fx_pred) AS v01,
                    1 - (sum(a) OVER w - a / 2.0) / (SELECT sum(y) FROM fx_pred) AS v10
             FROM d{p} WINDOW w AS (ORDER BY p))"""


@query("delong_auc", f"""
    WITH {_placed(1)}, {_placed(2)},
    v AS (SELECT y, CASE WHEN y = 1 THEN k1.v01 ELSE k1.v10 END AS a, CASE WHEN y = 1 THEN k2.v01 ELSE k2.v10 END AS b
          FROM fx_pred JOIN k1 ON k1.p = p1 JOIN k2 ON k2.p = p2),
    s AS (SELECT sum(CASE WHEN y = 1 THEN a END) / sum(y) AS auc1, sum(CASE WHEN y = 1 THEN b END) / sum(y) AS auc2 FROM v),
    w AS (SELECT y, (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) AS c FROM v GROUP BY y)
    SELECT round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round(auc1 - auc2, 6) AS diff,
           round((auc1 - auc2) / sqrt((SELECT sum(c) FROM w)), 4) AS z FROM s""")
def delong_auc(spark, sf):
    d = inference.delong(fx.predictions(spark, sf))
    return d.select(r6("auc1").alias("auc1"), r6("auc2").alias("auc2"), r6("diff").alias("diff"),
                    F.round("z", 4).alias("z"))


@query("delong_p", f"""
    WITH {_placed(1)}, {_placed(2)},
    v AS (SELECT y, CASE WHEN y = 1 THEN k1.v01 ELSE k1.v10 END AS a, CASE WHEN y = 1 THEN k2.v01 ELSE k2.v10 END AS b
          FROM fx_pred JOIN k1 ON k1.p = p1 JOIN k2 ON k2.p = p2),
    s AS (SELECT sum(CASE WHEN y = 1 THEN a - b END) / sum(y) AS diff FROM v),
    w AS (SELECT y, (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) AS c FROM v GROUP BY y),
    d AS (SELECT diff, diff / sqrt((SELECT sum(c) FROM w)) AS z FROM s)
    SELECT round(diff, 6) AS diff, round(z, 4) AS z, round({sql_p_normal('z')}, 6) AS p_value FROM d""")
def delong_p(spark, sf):
    d = inference.delong_test(fx.predictions(spark, sf))
    return d.select(r6("diff").alias("diff"), F.round("z", 4).alias("z"), r6("p_value").alias("p_value"))


_DRAW = """
    rk AS (SELECT id, y, p1, p2, row_number() OVER (PARTITION BY {s} ORDER BY md5('0pos-' || id), id) - 1 AS ai,
                  count(*) OVER (PARTITION BY {s}) AS n, {s} AS st FROM fx_pred),
    dr AS (SELECT st, b, ('0x' || substring(md5('0-' || b || '-' || st || '-' || ai), 1, 15))::BIGINT % n AS ai
           FROM rk, range({B}) r(b)),
    wt AS (SELECT st, b, ai, count(*) AS w FROM dr GROUP BY ALL),
    bs AS (SELECT b, y, p1, p2, w FROM wt JOIN rk ON wt.st = rk.st AND wt.ai = rk.ai)"""


@query("bootstrap_auroc", f"""WITH {_DRAW.format(s='y', B=5)}, {_curve("b, ", "bs", "p1", "w")}
    SELECT b, round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc FROM c GROUP BY b""")
def bootstrap_auroc(spark, sf):
    drawn = inference.draw_exact(_pred(spark, sf), 5)
    reps = inference.replicate_metrics(drawn, 0.45)
    return reps.select(F.col("b").cast("long").alias("b"), r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query("bootstrap_ci", f"""WITH {_DRAW.format(s='y', B=20)}, {_curve("b, ", "bs", "p1", "w")},
    a AS (SELECT b, {_AUROC} AS auroc, {_AUPRC} AS auprc FROM c GROUP BY b),
    m AS (SELECT b, sum(w) FILTER (p1 >= 0.45 AND y = 1)::DOUBLE AS tp, sum(w) FILTER (p1 >= 0.45 AND y = 0)::DOUBLE AS fp,
                 sum(w) FILTER (p1 < 0.45 AND y = 1)::DOUBLE AS fn, sum(w) FILTER (p1 < 0.45 AND y = 0)::DOUBLE AS tn,
                 sum(w * (p1 - y) * (p1 - y)) / sum(w) AS brier FROM bs GROUP BY b),
    k AS (SELECT unnest(['auroc', 'auprc', 'sensitivity', 'specificity', 'f1', 'brier']) AS metric,
                 unnest([auroc, auprc, tp / (tp + fn), tn / (tn + fp), 2 * tp / (2 * tp + fp + fn), brier]) AS v
          FROM a JOIN m ON a.b = m.b)
    SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi,
           count(*) AS n_replicates FROM k GROUP BY metric""")
def bootstrap_ci(spark, sf):
    ci = inference.bootstrap_ci(_pred(spark, sf), 0.45, n_boot=20, method="exact")
    return _rounded(ci.where(F.col("metric").isin("auroc", "auprc", "sensitivity", "specificity", "f1", "brier")))


@query("bootstrap_poisson", f"""
    WITH u AS (SELECT id, y, p1, b, ('0x' || substring(md5('0-' || b || '-' || id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
               FROM fx_pred, range(10) r(b)),
    bs AS (SELECT b, y, p1, len(list_filter([{", ".join(f"{c!r}::DOUBLE" for c in poisson_cdf())}], lambda q : u >= q)) AS w FROM u),
    {_curve("b, ", "bs", "p1", "w")}
    SELECT b, round({_AUROC}, 6) AS auroc FROM c GROUP BY b""")
def bootstrap_poisson(spark, sf):
    reps = inference.replicate_metrics(inference.draw_poisson(_pred(spark, sf), 10), 0.45)
    return reps.select(F.col("b").cast("long").alias("b"), r6("auroc").alias("auroc"))


@query("bootstrap_intervals", f"""WITH {draw_sql("fx_pred", 2000)}, {_replicate_sql()},
    k AS (UNPIVOT rp ON {", ".join(METRICS)} INTO NAME metric VALUE v)
    SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) AS n_replicates
    FROM k GROUP BY metric""")
def bootstrap_intervals(spark, sf):
    return _rounded(inference.bootstrap_ci(_pred(spark, sf), 0.45, n_boot=2000))


@query("bootstrap_paired", f"""WITH {draw_sql("fx_pred", 500, columns=("y", "p1", "p2"))},
    {", ".join(f"""s{i} AS (SELECT b, p{i} AS p, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS pos FROM bs WHERE w > 0 GROUP BY ALL),
    a{i} AS (SELECT b, sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT b, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM s{i} WINDOW w AS (PARTITION BY b ORDER BY p DESC)) GROUP BY b),
    o{i} AS (SELECT sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM (SELECT p{i} AS p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM fx_pred GROUP BY 1) WINDOW w AS (ORDER BY p DESC)))"""
               for i in (1, 2))},
    d AS (SELECT a1.ap - a2.ap AS d FROM a1 JOIN a2 ON a1.b = a2.b)
    SELECT round((SELECT ap FROM o1) - (SELECT ap FROM o2), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS lo,
           round(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 6) AS p_value, count(*) AS n_replicates FROM d""")
def bootstrap_paired(spark, sf):
    return _rounded(inference.bootstrap_auprc_diff(fx.predictions(spark, sf), n_boot=500))


@query("bootstrap_auprc_diff", f"""WITH {_DRAW.format(s='0', B=10)},
    s1 AS (SELECT b, p1 AS p, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS pos FROM bs GROUP BY ALL),
    s2 AS (SELECT b, p2 AS p, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS pos FROM bs GROUP BY ALL),
    a1 AS (SELECT b, sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT b, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM s1 WINDOW w AS (PARTITION BY b ORDER BY p DESC)) GROUP BY b),
    a2 AS (SELECT b, sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT b, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM s2 WINDOW w AS (PARTITION BY b ORDER BY p DESC)) GROUP BY b),
    o1 AS (SELECT sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM (SELECT p1 AS p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM fx_pred GROUP BY 1) WINDOW w AS (ORDER BY p DESC))),
    o2 AS (SELECT sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS cn
           FROM (SELECT p2 AS p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM fx_pred GROUP BY 1) WINDOW w AS (ORDER BY p DESC))),
    d AS (SELECT a1.ap - a2.ap AS d FROM a1 JOIN a2 ON a1.b = a2.b)
    SELECT round((SELECT ap FROM o1) - (SELECT ap FROM o2), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS lo,
           round(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 6) AS p_value, count(*) AS n_replicates FROM d""")
def bootstrap_auprc_diff(spark, sf):
    return _rounded(inference.bootstrap_auprc_diff(fx.predictions(spark, sf), n_boot=10, method="exact"))


@query("paired_predictions", """
    SELECT id, y, client, p1, p2 FROM fx_pred WHERE p2 < 0.9 AND p1 > 0.25""")
def paired_predictions(spark, sf):
    p = fx.predictions(spark, sf)
    a = p.where(F.col("p1") > 0.25).select("id", "y", "client", F.col("p1").alias("p"))
    b = p.where(F.col("p2") < 0.9).select("id", F.col("p2").alias("p"))
    return inference.paired_predictions(a, b)


@query("case_selection", """
    WITH c AS (SELECT id, y, p1 AS p, md5('0-' || id) AS h FROM fx_pred)
    SELECT list, id, y, p FROM (
        SELECT 'highest' AS list, *, row_number() OVER (ORDER BY p DESC, id) AS r FROM c
        UNION ALL SELECT 'lowest', *, row_number() OVER (ORDER BY p, id) FROM c
        UNION ALL SELECT 'died', *, row_number() OVER (ORDER BY p DESC, id) FROM c WHERE y = 1
        UNION ALL SELECT 'survived', *, row_number() OVER (ORDER BY p DESC, id) FROM c WHERE y = 0
        UNION ALL SELECT 'correct', *, row_number() OVER (ORDER BY p DESC, id) FROM c WHERE (p >= 0.45) = (y = 1)
        UNION ALL SELECT 'missed', *, row_number() OVER (ORDER BY p DESC, id) FROM c WHERE p < 0.45 AND y = 1
        UNION ALL SELECT 'false_alarm', *, row_number() OVER (ORDER BY p DESC, id) FROM c WHERE p >= 0.45 AND y = 0
        UNION ALL SELECT 'random', *, row_number() OVER (ORDER BY h, id) FROM c) WHERE r <= 40""")
def case_selection(spark, sf):
    return experiments.case_lists(_pred(spark, sf), 0.45)

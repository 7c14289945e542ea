"""Queries: experiment statistics, parameter averaging, drift, the federated model."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import experiments as X
from sitewise.operators import federate as K
from sitewise.plans import fixtures as fx
from sitewise.plans.catalog_cohort import r6
from sitewise.plans.catalog_metrics import _rounded
from sitewise.plans.registry import query, sql_p_f, sql_p_normal, sql_p_t

# --- experiment tables ------------------------------------------------------------------

@query("summarise_runs", """
    SELECT arm, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_sd,
           round(avg(auprc), 6) AS auprc_mean, round(stddev_samp(auprc), 6) AS auprc_sd, count(*) AS n_runs
    FROM fx_runs GROUP BY arm""")
def summarise_runs(spark, sf):
    return _rounded(X.summarise(fx.runs(spark, sf), ["arm"], ["auroc", "auprc"]))


@query("scope_summary", """
    SELECT 's' || seed % 3 AS scope, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_sd,
           count(*) AS n_runs FROM fx_runs GROUP BY seed % 3""")
def scope_summary(spark, sf):
    r = fx.runs(spark, sf).withColumn("scope", F.concat(F.lit("s"), (F.col("seed") % 3).cast("string")))
    return _rounded(X.summarise(r, ["scope"], ["auroc"]))


_PAIRED = """
    d AS (SELECT a.arm, a.auprc - b.auprc AS d FROM fx_runs a JOIN fx_runs b ON a.seed = b.seed
          WHERE b.arm = 'click' AND a.arm <> 'click'),
    pd AS (SELECT arm, avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n, count(*) FILTER (d > 0) AS wins FROM d GROUP BY arm)"""


@query("paired_by_seed", f"""WITH {_PAIRED}
    SELECT arm, 'click' AS vs, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(m / (sd / sqrt(n)), 6) AS t,
           wins, n, round(0.05 / (SELECT count(*) FROM pd), 6) AS bonferroni_alpha FROM pd""")
def paired_by_seed(spark, sf):
    return _rounded(X.paired_by_seed(fx.runs(spark, sf), "arm", "click", "auprc"))


@query("paired_by_seed_p", f"""WITH {_PAIRED},
    pt AS (SELECT arm, m, n, m / (sd / sqrt(n)) AS t, 0.05 / (SELECT count(*) FROM pd) AS level FROM pd),
    pp AS (SELECT *, {sql_p_t('t', '(n - 1)')} AS p FROM pt)
    SELECT arm, round(m, 6) AS mean_diff, round(t, 6) AS t, n, round(p, 6) AS paired_p,
           coalesce(p < 0.05, false) AS sig_uncorrected, coalesce(p < level, false) AS sig_bonferroni FROM pp""")
def paired_by_seed_p(spark, sf):
    tested = X.with_paired_p(X.paired_by_seed(fx.runs(spark, sf), "arm", "click", "auprc"))
    return _rounded(tested.select("arm", "mean_diff", "t", "n", "paired_p", "sig_uncorrected", "sig_bonferroni"))


@query("results_with_tests", f"""WITH {_PAIRED}
    SELECT r.arm, round(avg(auprc), 6) AS auprc_mean, count(*) AS n_runs, round(any_value(m), 6) AS mean_diff,
           any_value(wins) AS wins FROM fx_runs r LEFT JOIN pd ON pd.arm = r.arm GROUP BY r.arm""")
def results_with_tests(spark, sf):
    r = fx.runs(spark, sf)
    tests = X.paired_by_seed(r, "arm", "click", "auprc").select("arm", "mean_diff", "wins")
    return _rounded(X.with_tests(X.summarise(r, ["arm"], ["auprc"]).select("arm", "auprc_mean", "n_runs"), tests))


def _rank(col, by=""):
    part = f"PARTITION BY {by} " if by else ""
    peers = f"{by}, {col}" if by else col
    return f"rank() OVER ({part}ORDER BY {col}) + (count(*) OVER (PARTITION BY {peers}) - 1) / 2.0"


@query("spearman_corr", f"""
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho,
           round(corr(a, b) * sqrt(count(*) - 2) / sqrt(1 - pow(corr(a, b), 2)), 5) AS t
    FROM (SELECT {_rank('l_quantity')} AS a, {_rank('l_extendedprice')} AS b FROM lineitem)""")
def spearman_corr(spark, sf):
    c = X.spearman(fx.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return c.select("n", r6("rho").alias("rho"), F.round("t", 5).alias("t"))


def _anova_sql(cat, metric, src):
    return f"""
    g AS (SELECT {cat} AS lv, count({metric}) AS n, avg({metric}) AS m, var_pop({metric}) AS v FROM {src} GROUP BY 1),
    t AS (SELECT avg({metric}) AS gm, sum(pow({metric} - (SELECT avg({metric}) FROM {src}), 2)) AS sst FROM {src}),
    b AS (SELECT sum(n) AS nb, count(*) AS k, sum(n * v) AS ssw, sum(n * m) / sum(n) AS bm FROM g WHERE n >= 2),
    an AS (SELECT (SELECT sum(n * pow(m - bm, 2)) FROM g WHERE n >= 2) / (k - 1) / (ssw / (nb - k)) AS f, k - 1 AS df1,
                  CAST(nb - k AS BIGINT) AS df2, (SELECT sum(n * pow(m - gm, 2)) FROM g WHERE n >= 2) / sst AS eta,
                  (SELECT arg_max(CAST(lv AS VARCHAR), m) FROM g) AS best, (SELECT max(m) - min(m) FROM g) AS spread FROM b, t)"""


@query("anova_eta2", f"""WITH {_anova_sql('p_type', 'p_retailprice', 'part')}
    SELECT 'p_type' AS parameter, round(f, 6) AS f_value, df1, df2, round(eta, 6) AS eta_squared,
           best AS best_level, round(spread, 6) AS spread_of_means FROM an""")
def anova_eta2(spark, sf):
    return _rounded(X.anova(fx.table(spark, sf, "part"), "p_type", "p_retailprice"))


@query("param_effects", f"""WITH {_anova_sql('arm', 'auprc', 'fx_runs')},
    sp AS (SELECT corr(a, b) AS r FROM (SELECT {_rank('ln(n_param)')} AS a, {_rank('auprc')} AS b FROM fx_runs))
    SELECT 'arm' AS parameter, round(eta, 6) AS eta_squared, best AS best_level, round(spread, 6) AS spread_of_means FROM an
    UNION ALL SELECT 'n_param (log)', round(r * r, 6), NULL, NULL FROM sp""")
def param_effects(spark, sf):
    return _rounded(X.parameter_effects(fx.runs(spark, sf), ["arm"], ["n_param"], "auprc"))


@query("welch_pairs", """
    WITH g AS (SELECT arm, count(*) AS n, avg(auprc) AS m, var_samp(auprc) AS v, var_pop(auprc) AS vp FROM fx_runs GROUP BY 1),
    p AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.m - b.m AS diff, a.v / a.n AS sa, b.v / b.n AS sb, a.n AS na, b.n AS nb,
                 sqrt((a.vp + b.vp) / 2) AS pooled FROM g a JOIN g b ON a.arm < b.arm)
    SELECT arm_a, arm_b, round(diff, 6) AS diff, round(diff / sqrt(sa + sb), 6) AS t,
           round(pow(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 5) AS df, round(diff / pooled, 6) AS cohens_d,
           round(0.05 / (SELECT count(*) FROM p), 6) AS bonferroni_alpha FROM p""")
def welch_pairs(spark, sf):
    w = X.welch_pairs(fx.runs(spark, sf), "arm", "auprc")
    return _rounded(w.withColumn("df", F.round("df", 5)))


@query("welch_pairs_p", f"""
    WITH g AS (SELECT arm, count(*) AS n, avg(auprc) AS m, var_samp(auprc) AS v FROM fx_runs GROUP BY 1),
    p AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.m - b.m AS diff, a.v / a.n AS sa, b.v / b.n AS sb, a.n AS na, b.n AS nb
          FROM g a JOIN g b ON a.arm < b.arm),
    w AS (SELECT *, diff / sqrt(sa + sb) AS t, pow(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS df,
                 0.05 / (SELECT count(*) FROM p) AS level FROM p),
    q AS (SELECT *, {sql_p_t('t', 'df')} AS p FROM w)
    SELECT arm_a, arm_b, round(t, 6) AS t, round(p, 6) AS p_value, p < level AS sig_bonferroni FROM q""")
def welch_pairs_p(spark, sf):
    tested = X.welch_pairs_p(X.welch_pairs(fx.runs(spark, sf), "arm", "auprc"))
    return _rounded(tested.select("arm_a", "arm_b", "t", "p_value", "sig_bonferroni"))


@query("mann_whitney", f"""
    WITH r AS (SELECT l_returnflag = 'A' AS a, {_rank('l_quantity')} AS rk FROM lineitem),
    t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)),
    u AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb,
                 sum(rk) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0 AS u FROM r)
    SELECT na, nb, CAST(u AS DOUBLE) AS u, round((greatest(u, na * nb - u) - na * nb / 2.0 - 0.5)
           / sqrt(na * nb / 12.0 * ((na + nb + 1) - ties / ((na + nb)::DOUBLE * (na + nb - 1)))), 5) AS z FROM u, t""")
def mann_whitney(spark, sf):
    m = X.mann_whitney(fx.table(spark, sf, "lineitem"), F.col("l_returnflag") == "A", "l_quantity")
    return m.select("na", "nb", F.col("u").cast("double").alias("u"), F.round("z", 5).alias("z"))


@query("mann_whitney_p", f"""
    WITH r AS (SELECT l_returnflag = 'A' AS a, {_rank('l_quantity')} AS rk FROM lineitem),
    t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)),
    u AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb,
                 sum(rk) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0 AS u FROM r),
    s AS (SELECT na, nb, (greatest(u, na * nb - u) - na * nb / 2.0 - 0.5)
                 / sqrt(na * nb / 12.0 * ((na + nb + 1) - ties / ((na + nb)::DOUBLE * (na + nb - 1)))) AS z FROM u, t)
    SELECT na, nb, round(z, 5) AS z, CASE WHEN z < 0 THEN 1.0::DOUBLE ELSE round({sql_p_normal('z')}, 5) END AS p_value FROM s""")
def mann_whitney_p(spark, sf):
    m = X.mann_whitney_p(X.mann_whitney(fx.table(spark, sf, "lineitem"), F.col("l_returnflag") == "A", "l_quantity"))
    return m.select("na", "nb", F.round("z", 5).alias("z"), F.round("p_value", 5).alias("p_value"))


@query("capacity_trend", """
    SELECT arm, min(n_param) AS n_param, round(avg(fl_gain), 6) AS fl_gain, round(stddev_samp(fl_gain), 6) AS fl_gain_sd,
           round(1.96 * stddev_samp(fl_gain) / sqrt(count(*)), 6) AS fl_gain_ci FROM fx_runs GROUP BY arm""")
def capacity_trend(spark, sf):
    return _rounded(X.capacity_trend(fx.runs(spark, sf), "arm", "n_param", ["fl_gain"]))


@query("control_comparison", f"""
    WITH r AS (SELECT CASE WHEN seed % 2 = 0 THEN 'sites' ELSE 'shuffled' END AS scheme, n_param, fl_gain FROM fx_runs),
    k AS (SELECT scheme, {_rank('n_param', 'scheme')} AS a, {_rank('fl_gain', 'scheme')} AS b FROM r),
    rho AS (SELECT scheme, corr(a, b) AS rho FROM k GROUP BY 1),
    e AS (SELECT scheme, n_param, avg(fl_gain) AS g FROM r GROUP BY ALL),
    x AS (SELECT scheme, arg_min(g, n_param) AS lo, arg_max(g, n_param) AS hi FROM e GROUP BY 1)
    SELECT r.scheme, count(*) AS n_runs, round(avg(fl_gain), 6) AS mean_gain, count(*) FILTER (fl_gain > 0) AS wins,
           round(any_value(lo), 6) AS gain_lowest, round(any_value(hi), 6) AS gain_highest, round(any_value(rho), 6) AS rho_gain
    FROM r JOIN rho ON rho.scheme = r.scheme JOIN x ON x.scheme = r.scheme GROUP BY r.scheme""")
def control_comparison(spark, sf):
    r = fx.runs(spark, sf).withColumn("scheme", F.when(F.col("seed") % 2 == 0, "sites").otherwise("shuffled"))
    return _rounded(X.control_comparison(r, "scheme", "n_param", "fl_gain"))


@query("control_verdict", f"""
    WITH r AS (SELECT CASE WHEN seed % 2 = 0 THEN 'sites' ELSE 'shuffled' END AS scheme, n_param, fl_gain FROM fx_runs),
    k AS (SELECT scheme, {_rank('n_param', 'scheme')} AS a, {_rank('fl_gain', 'scheme')} AS b FROM r),
    c AS (SELECT scheme, corr(a, b) AS rho, count(*) AS n FROM k GROUP BY 1),
    t AS (SELECT *, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t FROM c),
    p AS (SELECT *, {sql_p_t('t', '(n - 2)')} AS p FROM t),
    v AS (SELECT max(rho) FILTER (scheme = 'sites') AS rt, max(p) FILTER (scheme = 'sites') AS pt,
                 max(rho) FILTER (scheme = 'shuffled') AS rc, max(p) FILTER (scheme = 'shuffled') AS pc FROM p)
    SELECT round(rt, 6) AS rho_test, round(pt, 5) AS p_test, round(rc, 6) AS rho_control, round(pc, 5) AS p_control,
           abs(rc) < abs(rt) * 0.6 OR pc > 0.05 AS weakened FROM v""")
def control_verdict(spark, sf):
    r = fx.runs(spark, sf).withColumn("scheme", F.when(F.col("seed") % 2 == 0, "sites").otherwise("shuffled"))
    v = X.control_verdict(r, "scheme", "sites", "shuffled", "n_param", "fl_gain")
    return v.select(r6("rho_test").alias("rho_test"), F.round("p_test", 5).alias("p_test"), r6("rho_control").alias("rho_control"),
                    F.round("p_control", 5).alias("p_control"), "weakened")


@query("spearman_p", f"""
    WITH c AS (SELECT corr(a, b) AS rho, count(*) AS n FROM (
        SELECT {_rank('c_acctbal')} AS a, {_rank('c_nationkey')} AS b FROM customer)),
    t AS (SELECT *, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t FROM c)
    SELECT n, round(rho, 6) AS rho, round({sql_p_t('t', '(n - 2)')}, 5) AS p_value FROM t""")
def spearman_p(spark, sf):
    c = X.spearman_p(X.spearman(fx.table(spark, sf, "customer"), "c_acctbal", "c_nationkey"))
    return c.select("n", r6("rho").alias("rho"), F.round("p_value", 5).alias("p_value"))


@query("anova_p", f"""WITH {_anova_sql('p_type', 'p_retailprice', 'part')}
    SELECT 'p_type' AS parameter, round(f, 6) AS f_value, df1, df2, round({sql_p_f('f', 'df1', 'df2')}, 5) AS p_value FROM an""")
def anova_p(spark, sf):
    tested = X.anova_p(X.anova(fx.table(spark, sf, "part"), "p_type", "p_retailprice"))
    return tested.select("parameter", r6("f_value").alias("f_value"), "df1", "df2", F.round("p_value", 5).alias("p_value"))


@query("generalisation_gap", """
    WITH m AS (SELECT avg(auroc) FILTER (arm = 'purchase') AS i, avg(auroc) FILTER (arm = 'click') AS o,
                      avg(auroc) FILTER (arm = 'view') AS r FROM fx_runs)
    SELECT round(i - o, 6) AS gap_raw, round(i - r, 6) AS gap_rescaled, round((i - o) - (i - r), 6) AS recovered,
           round(((i - o) - (i - r)) / greatest(i - o, 1e-9), 4) AS recovered_share FROM m""")
def generalisation_gap(spark, sf):
    g = X.generalisation_gap(fx.runs(spark, sf), "purchase", "click", "view", scope="arm")
    return g.select(*[r6(c).alias(c) for c in g.columns[:3]], F.round("recovered_share", 4).alias("recovered_share"))


@query("fed_gain", """
    WITH c AS (SELECT user_id % 5 AS seed, 'u' || user_id % 7 AS client, event_type, round(avg(value), 6) AS v
               FROM events GROUP BY user_id % 5, user_id % 7, event_type),
    g AS (SELECT f.seed, avg(f.v - l.v) AS fl_gain, count(*) AS n_clients, count(*) FILTER (f.v > l.v) AS wins
          FROM c f JOIN c l ON f.seed = l.seed AND f.client = l.client
          WHERE f.event_type = 'purchase' AND l.event_type = 'view' GROUP BY f.seed),
    p AS (SELECT user_id % 5 AS seed, event_type, avg(value) AS v FROM events GROUP BY user_id % 5, event_type)
    SELECT g.seed, round(fl_gain, 6) AS fl_gain, n_clients, wins, round(b.v - a.v, 6) AS gap_to_pooled FROM g
    JOIN p a ON a.seed = g.seed AND a.event_type = 'purchase' JOIN p b ON b.seed = g.seed AND b.event_type = 'click'""")
def fed_gain(spark, sf):
    e = fx.table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("seed"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("client"),
        F.when(F.col("event_type") == "purchase", "federated").when(F.col("event_type") == "view", "local")
        .when(F.col("event_type") == "click", "pooled").alias("mode"), "value")
    clients = e.groupBy("seed", "client", "mode").agg(F.round(F.avg("value"), 6).alias("auprc"))
    pooled = e.groupBy("seed", "mode").agg(F.avg("value").alias("auprc"))
    return _rounded(X.federation_gain(clients, pooled))


@query("fed_vs_local", """
    WITH r AS (SELECT 'u' || user_id % 11 AS scope, event_type, avg(value) AS v FROM events GROUP BY user_id % 11, event_type)
    SELECT f.scope, round(f.v, 6) AS federated, round(l.v, 6) AS local_only, round(f.v - l.v, 6) AS diff
    FROM r f JOIN r l ON f.scope = l.scope WHERE f.event_type = 'purchase' AND l.event_type = 'view'""")
def fed_vs_local(spark, sf):
    r = fx.table(spark, sf, "events").groupBy(
        F.concat(F.lit("u"), (F.col("user_id") % 11).cast("string")).alias("scope"),
        F.when(F.col("event_type") == "purchase", "federated").when(F.col("event_type") == "view", "local")
        .otherwise("other").alias("method")).agg(F.avg("value").alias("auprc"))
    return _rounded(X.federated_vs_local(r))


@query("score_overview", """
    SELECT count(*) AS n, max(auprc) AS best, round(quantile_cont(auprc, 0.5), 6) AS median, min(auprc) AS worst,
           round(quantile_cont(auprc, 0.25), 6) AS q25, round(quantile_cont(auprc, 0.75), 6) AS q75,
           round(max(auprc) - quantile_cont(auprc, 0.5), 6) AS best_minus_median, max(best_round) AS cap,
           count(*) FILTER (best_round = (SELECT max(best_round) FROM fx_runs)) AS n_at_cap,
           CAST(count(*) FILTER (best_round = (SELECT max(best_round) FROM fx_runs)) > count(*) * 0.2 AS INTEGER) AS cap_binding
    FROM fx_runs""")
def score_overview(spark, sf):
    return _rounded(X.score_overview(fx.runs(spark, sf), "auprc", "best_round"))


@query("top_configs", """
    SELECT stay_id, score FROM (SELECT l_orderkey AS stay_id, round(sum(l_extendedprice), 2) AS score FROM lineitem GROUP BY 1)
    ORDER BY score DESC, stay_id LIMIT 10""")
def top_configs(spark, sf):
    c = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stay_id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return X.top_configs(c, "score", "stay_id")


@query("robust_rank", """
    SELECT arm, round(avg(auprc), 6) AS mean, round(stddev_pop(auprc), 6) AS sd, count(*) AS n,
           round(avg(auprc) - stddev_pop(auprc), 6) AS score FROM fx_runs GROUP BY arm""")
def robust_rank(spark, sf):
    return _rounded(X.robust_rank(fx.runs(spark, sf), "arm", "auprc"))


@query("stability_rank", """
    SELECT arm, round(stddev_pop(auprc), 6) AS sd, round(avg(auprc), 6) AS mean FROM fx_runs GROUP BY arm""")
def stability_rank(spark, sf):
    return _rounded(X.stability_rank(fx.runs(spark, sf), "arm", "auprc"))


# fixed values: the search space of the tuning job
SPACE = {
    "LR": ("log", 1e-4, 5e-3), "PROX_MU": ("log", 1e-4, 3e-1), "SERVER_LR": ("log", 1e-3, 1e-1),
    "HIDDEN": ("choice", [64, 128, 192, 256]), "DROPOUT": ("choice", [0.1, 0.2, 0.3, 0.4]),
    "BATCH_SIZE": ("choice", [128, 256, 512]), "LOCAL_EPOCHS": ("choice", [1, 2, 3]),
    "FL_ALGO": ("choice", ["fedavg", "fedprox", "fedadam"]),
    "IMBALANCE": ("choice", ["pos_weight", "sampler", "none"]), "PERSONALIZE": ("choice", [True, False]),
}
PINNED = {"PROX_MU": ("FL_ALGO", "fedprox", 0.0), "SERVER_LR": ("FL_ALGO", "fedadam", 0.01)}


def _u(name):
    return f"('0x' || substring(md5('42-{name}-' || c_custkey), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


@query("sample_configs", f"""
    WITH d AS (SELECT c_custkey, ['fedavg', 'fedprox', 'fedadam'][1 + CAST(floor({_u('FL_ALGO')} * 3) AS BIGINT)] AS FL_ALGO,
        exp(ln(1e-4::DOUBLE) + {_u('LR')} * (ln(5e-3::DOUBLE) - ln(1e-4::DOUBLE))) AS LR,
        exp(ln(1e-4::DOUBLE) + {_u('PROX_MU')} * (ln(3e-1::DOUBLE) - ln(1e-4::DOUBLE))) AS MU,
        [64, 128, 192, 256][1 + CAST(floor({_u('HIDDEN')} * 4) AS BIGINT)] AS HIDDEN,
        [true, false][1 + CAST(floor({_u('PERSONALIZE')} * 2) AS BIGINT)] AS PERSONALIZE FROM customer)
    SELECT c_custkey, FL_ALGO, round(LR, 8) AS LR, round(CASE WHEN FL_ALGO = 'fedprox' THEN MU ELSE 0 END, 8) AS PROX_MU,
           HIDDEN, PERSONALIZE FROM d""")
def sample_configs(spark, sf):
    c = X.sample_configs(fx.table(spark, sf, "customer"), "c_custkey", SPACE, 42, PINNED)
    return c.select("c_custkey", "FL_ALGO", F.round("LR", 8).alias("LR"), F.round("PROX_MU", 8).alias("PROX_MU"),
                    "HIDDEN", "PERSONALIZE")


@query("arm_seed_grid", """
    SELECT arm, CAST(seed AS INTEGER) AS seed FROM (SELECT DISTINCT event_type AS arm FROM events),
           (SELECT unnest([42, 101, 2026]) AS seed)""")
def arm_seed_grid(spark, sf):
    return X.arm_seed_grid(fx.table(spark, sf, "events").select(F.col("event_type").alias("arm")), [42, 101, 2026])


# --- federation ---------------------------------------------------------------------------

@query("client_weights", """
    WITH c AS (SELECT client, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM fx_split
               WHERE split = 'train' GROUP BY client)
    SELECT client, p AS n_pos, q AS n_neg, CAST(p + q AS DOUBLE) AS w_samples, CAST(greatest(p, 1) AS DOUBLE) AS w_events,
           round(2.0 * p * q / (p + q), 6) AS w_effective, round(q / greatest(p, 1), 6) AS pos_weight FROM c""")
def client_weights(spark, sf):
    return _rounded(K.client_weights(fx.splits(spark, sf).where(F.col("split") == "train")))


@query("balanced_weights", """
    SELECT stay_id, client, label, round(1.0 / count(*) OVER (PARTITION BY client, label), 8) AS weight FROM fx_clients""")
def balanced_weights(spark, sf):
    return K.balanced_weights(fx.site_rows(spark, sf)).select("stay_id", "client", "label", F.round("weight", 8).alias("weight"))


@query("balanced_resample", """
    WITH rk AS (SELECT stay_id, client, label, row_number() OVER (PARTITION BY client, label ORDER BY md5('42pos-' || stay_id)) - 1 AS ai,
                       count(*) OVER (PARTITION BY client, label) AS n FROM fx_clients),
    cl AS (SELECT client, list_sort(list(DISTINCT {'label': label, 'n': n})) AS c FROM rk GROUP BY client),
    dr AS (SELECT f.client, c[1 + ('0x' || substring(md5('42class-' || stay_id), 1, 15))::BIGINT % len(c)] AS k,
                  ('0x' || substring(md5('42row-' || stay_id), 1, 15))::BIGINT AS h
           FROM fx_clients f JOIN cl ON cl.client = f.client)
    SELECT rk.client, rk.label, rk.stay_id, count(*) AS times FROM dr JOIN rk ON rk.client = dr.client
     AND rk.label = dr.k.label AND rk.ai = dr.h % dr.k.n GROUP BY ALL""")
def balanced_resample(spark, sf):
    return K.balanced_resample(fx.site_rows(spark, sf)).select("client", "label", "stay_id", "times")


@query("fedavg", """
    SELECT pos, round(sum(weight * value) / sum(weight), 6) AS value FROM fx_vec GROUP BY pos""")
def fedavg(spark, sf):
    p = fx.parameters(spark, sf)
    w = p.groupBy("client").agg(F.max("weight").alias("weight"))
    return _rounded(K.fedavg(p.drop("weight"), w).withColumn("pos", F.col("pos").cast("long")))


@query("fedavg_partial", """
    WITH g AS (SELECT pos, sum(weight * value) / sum(weight) AS g FROM fx_vec WHERE pos < 48 GROUP BY pos)
    SELECT client, CASE WHEN v.pos < 48 THEN 'body.' ELSE 'head.' END || v.pos AS pos, round(coalesce(g, value), 6) AS value,
           CAST(g IS NOT NULL AS INTEGER) AS shared FROM fx_vec v LEFT JOIN g ON g.pos = v.pos""")
def fedavg_partial(spark, sf):
    p = fx.parameters(spark, sf)
    w = p.groupBy("client").agg(F.max("weight").alias("weight"))
    named = p.select("client", F.concat(F.when(F.col("pos") < 48, "body.").otherwise("head."),
                                        F.col("pos").cast("string")).alias("pos"), "value")
    return _rounded(K.fedavg_partial(named, w, ["head"]))


@query("fedadam_step", """
    WITH a AS (SELECT pos, sum(weight * value) / sum(weight) AS avg FROM fx_vec GROUP BY pos),
    s AS (SELECT g.pos, g.value, 0.9 * 0.01 + 0.1 * (avg - g.value) AS m, 0.99 * 0.0001 + 0.01 * pow(avg - g.value, 2) AS v
          FROM fx_global g JOIN a ON a.pos = g.pos)
    SELECT pos, round(value + 0.03 * m / (sqrt(v) + 1e-3), 6) AS value, round(m, 6) AS m, round(v, 9) AS v FROM s""")
def fedadam_step(spark, sf):
    p = fx.parameters(spark, sf)
    w = p.groupBy("client").agg(F.max("weight").alias("weight"))
    state = fx.shared_parameters(spark, sf).withColumn("m", F.lit(0.01)).withColumn("v", F.lit(0.0001))
    s = K.fedadam_step(state, K.fedavg(p.drop("weight"), w), 0.03)
    return s.select(F.col("pos").cast("long").alias("pos"), r6("value").alias("value"), r6("m").alias("m"),
                    F.round("v", 9).alias("v"))


@query("fedprox_step", """
    SELECT client, v.pos, round(0.01 * (v.value - g.value), 8) AS value FROM fx_vec v JOIN fx_global g ON g.pos = v.pos""")
def fedprox_step(spark, sf):
    g = K.prox_gradient(fx.parameters(spark, sf), fx.shared_parameters(spark, sf), 0.01)
    return g.select("client", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def _updates(spark, sf):
    """Two rounds of client updates: from the mean vector, and half of it again."""
    u = K.client_updates(fx.parameters(spark, sf), fx.shared_parameters(spark, sf))
    first = u.withColumn("round", F.lit(1))
    second = u.withColumn("value", F.col("value") * 0.5 + 0.01).withColumn("round", F.lit(2))
    return first.unionByName(second)


_UPDATES = """
    u0 AS (SELECT client, v.pos, v.value - g.value AS d FROM fx_vec v JOIN fx_global g ON g.pos = v.pos),
    up AS (SELECT 1 AS round, client, pos, d FROM u0 UNION ALL SELECT 2, client, pos, d * 0.5 + 0.01 FROM u0),
    nm AS (SELECT round, client, sqrt(sum(d * d)) AS norm FROM up GROUP BY ALL),
    cs AS (SELECT a.round, a.client AS client_a, b.client AS client_b, sum(a.d * b.d) / greatest(any_value(x.norm * y.norm), 1e-12) AS c
           FROM up a JOIN up b ON a.round = b.round AND a.pos = b.pos AND a.client < b.client
           JOIN nm x ON x.round = a.round AND x.client = a.client JOIN nm y ON y.round = b.round AND y.client = b.client
           GROUP BY a.round, a.client, b.client),
    dr AS (SELECT n.*, c.mean_c, c.min_c, c.neg FROM (SELECT round, avg(norm) AS mean_n, max(norm) AS max_n,
                  max(norm) / greatest(min(norm), 1e-12) AS ratio FROM nm GROUP BY round) n
           JOIN (SELECT round, avg(c) AS mean_c, min(c) AS min_c, avg((c < 0)::INT) AS neg FROM cs GROUP BY round) c ON c.round = n.round)"""


@query("pairwise_cosine", f"WITH {_UPDATES} SELECT round, client_a, client_b, round(c, 6) AS cosine FROM cs")
def pairwise_cosine(spark, sf):
    return _rounded(K.pairwise_cosine(_updates(spark, sf), ["round"]))


@query("client_drift", f"""WITH {_UPDATES} SELECT round, round(mean_n, 6) AS mean_update_norm, round(max_n, 6) AS max_update_norm,
    round(ratio, 6) AS norm_ratio_max_min, round(mean_c, 6) AS mean_pairwise_cosine, round(min_c, 6) AS min_pairwise_cosine,
    round(neg, 6) AS frac_negative_cosine FROM dr""")
def client_drift(spark, sf):
    return _rounded(K.drift(_updates(spark, sf)))


@query("drift_diagnosis", f"""WITH {_UPDATES} SELECT 'r' AS run, round(mean_c, 6) AS cosine, round(ratio, 6) AS norm_ratio,
    round(neg, 6) AS frac_negative, CASE WHEN mean_c > 0.5 THEN 'agree: more rounds, fewer local steps'
        WHEN mean_c > 0.15 THEN 'partial: rounds first, then personal parameters' ELSE 'disagree: personal parameters' END AS verdict,
    CAST(ratio > 5 AS INTEGER) AS dominated FROM dr WHERE round = 2""")
def drift_diagnosis(spark, sf):
    return _rounded(K.drift_diagnosis(K.drift(_updates(spark, sf)).withColumn("run", F.lit("r"))))


@query("early_stop_round", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS i,
                      max(metric) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fx_rounds),
    g AS (SELECT *, max(CASE WHEN prev IS NULL OR metric > prev THEN i END) OVER (PARTITION BY run ORDER BY i) AS up FROM h),
    s AS (SELECT *, coalesce(min(CASE WHEN i - up >= 3 THEN i END) OVER (PARTITION BY run), max(i) OVER (PARTITION BY run)) AS stop FROM g)
    SELECT run, CAST(arg_max(round, metric) AS INTEGER) AS best_round, max(metric) AS best, CAST(max(round) AS INTEGER) AS stopped_at
    FROM s WHERE i <= stop GROUP BY run""")
def early_stop_round(spark, sf):
    return K.early_stop(fx.round_history(spark, sf), 3, "metric")


_FEATS = ("x_age", "x_los")


def _model_rows(spark, sf):
    return fx.splits(spark, sf).select(
        "stay_id", "client", "label", "split", ((F.col("age") - 50) / 20.0).alias("x_age"),
        ((F.col("los_hours") - 50) / 30.0).alias("x_los"))


_MODEL = """mr AS (SELECT stay_id, client, label, split, (age - 50) / 20.0 AS x_age, (los_hours - 50) / 30.0 AS x_los FROM fx_split)"""


@query("fed_logreg_step", f"""WITH {_MODEL},
    pw AS (SELECT client, count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1)::DOUBLE AS w FROM mr
           WHERE split = 'train' GROUP BY client),
    e AS (SELECT mr.client, x_age, x_los, (1 / (1 + exp(-(0.1 + 0.2 * x_age - 0.3 * x_los))) - label)
                 * CASE WHEN label = 1 THEN w ELSE 1 END AS e FROM mr JOIN pw ON pw.client = mr.client WHERE split = 'train'),
    g AS (SELECT client, count(*) AS n, avg(e) AS g0, avg(e * x_age) AS g1, avg(e * x_los) AS g2 FROM e GROUP BY client)
    SELECT round(sum(n * (0.1 - 0.5 * g0)) / sum(n), 6) AS w0, round(sum(n * (0.2 - 0.5 * g1)) / sum(n), 6) AS w1,
           round(sum(n * (-0.3 - 0.5 * g2)) / sum(n), 6) AS w2, CAST(sum(n) AS BIGINT) AS n FROM g""")
def fed_logreg_step(spark, sf):
    train = _model_rows(spark, sf).where(F.col("split") == "train")
    start = [0.1, 0.2, -0.3]
    w = K.client_weights(train).select("client", F.array(*[F.lit(x) for x in start]).alias("_w"),
                                       F.col("pos_weight").alias("_pw"))
    g = K.client_gradients(train, w, _FEATS)
    n = F.col("n")
    return _rounded(g.agg(*[(F.sum(n * (s - 0.5 * F.get("grad", F.lit(i)))) / F.sum(n)).alias(f"w{i}")
                            for i, s in enumerate(start)], F.sum("n").alias("n")))


@query("score_pooled", f"""WITH {_MODEL},
    st AS (SELECT client, avg(x_age) AS a, avg(x_los) AS l FROM mr WHERE split = 'train' GROUP BY client)
    SELECT stay_id, mr.client, label, round(a + 0.5 * x_age + l * x_los, 6) AS z,
           round(1 / (1 + exp(-(a + 0.5 * x_age + l * x_los))), 6) AS p
    FROM mr JOIN st ON st.client = mr.client WHERE split = 'test'""")
def score_pooled(spark, sf):
    rows = _model_rows(spark, sf)
    w = rows.where(F.col("split") == "train").groupBy("client").agg(
        F.array(F.avg("x_age"), F.lit(0.5), F.avg("x_los")).alias("_w"))
    return _rounded(K.score(rows.where(F.col("split") == "test"), w, _FEATS))

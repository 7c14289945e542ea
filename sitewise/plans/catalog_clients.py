"""Queries: sites, splits, normalising, integrity checks, representativeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.pvalues import p_chi2, p_t
from sitewise.operators import clients, quality
from sitewise.operators.ordered import exact_quantiles
from sitewise.plans import fixtures as fx
from sitewise.plans.catalog_cohort import r6
from sitewise.plans.registry import query, sql_p_chi2, sql_p_normal, sql_p_t


# --- assignment -------------------------------------------------------------------------

@query("client_careunit", "SELECT stay_id, subject_id, client FROM fx_clients")
def client_careunit(spark, sf):
    return clients.guard_clients(fx.site_rows(spark, sf), "unit").select("stay_id", "subject_id", "client")


@query("client_year_group", """
    SELECT stay_id, year_group AS client FROM fx_cohort WHERE year_group IN (
        SELECT year_group FROM fx_cohort GROUP BY 1 HAVING count(*) >= 500)""")
def client_year_group(spark, sf):
    return clients.by_category(fx.stored_cohort(spark, sf), "year_group", 500).select("stay_id", "client")


@query("client_source_only", """
    SELECT doc_id, source AS client FROM documents WHERE lang = 'en' AND source IN (
        SELECT source FROM documents WHERE lang = 'en' GROUP BY 1 HAVING count(*) >= 20)""")
def client_source_only(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("dataset"))
    return clients.by_source(docs, "en", "source", 20).select("doc_id", "client")


@query("client_shuffled", """
    WITH sz AS (SELECT unit AS client, count(*) AS n FROM fx_cohort GROUP BY 1 HAVING count(*) >= 150),
    tg AS (SELECT client, sum(n) OVER (ORDER BY n DESC, client) AS stop, n FROM sz),
    pt AS (SELECT subject_id, count(*) AS k FROM fx_cohort GROUP BY 1),
    cm AS (SELECT subject_id, sum(k) OVER (ORDER BY md5('42-' || subject_id)) - k AS at FROM pt)
    SELECT c.stay_id, t.client FROM fx_cohort c JOIN cm ON cm.subject_id = c.subject_id
    JOIN tg t ON cm.at >= t.stop - t.n AND cm.at < t.stop""")
def client_shuffled(spark, sf):
    return clients.shuffled(fx.stored_cohort(spark, sf), "unit", fx.MIN_CLIENT).select("stay_id", "client")


# (label, client, cumulative share): one draw with alpha 0.3, kept so that SQL can repeat it
_SHARES = tuple((y, i, c) for y, cuts in (
    (0, (0.0625, 0.1875, 0.25, 0.625, 0.6875, 0.75, 0.9375, 1.0)),
    (1, (0.375, 0.40625, 0.5, 0.515625, 0.75, 0.8125, 0.875, 1.0))) for i, c in enumerate(cuts))


@query("client_dirichlet", f"""
    WITH sh AS (SELECT * FROM (VALUES {", ".join(f"({y}, {i}, {c}::DOUBLE)" for y, i, c in _SHARES)}) t(y, i, c)),
    rk AS (SELECT stay_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || stay_id)) - 1 AS r,
                  count(*) OVER (PARTITION BY label) AS n FROM fx_cohort)
    SELECT stay_id, label, 'client_' || (SELECT count(*) FROM sh
           WHERE sh.y = rk.label AND sh.i < 7 AND floor(sh.c * rk.n) <= rk.r) AS client FROM rk""")
def client_dirichlet(spark, sf):
    return clients.dirichlet(fx.stored_cohort(spark, sf), _SHARES).select("stay_id", "label", "client")


# --- splits -----------------------------------------------------------------------------

@query("grouped_split", "SELECT stay_id, client, split FROM fx_split")
def grouped_split(spark, sf):
    return fx.splits(spark, sf).select("stay_id", "client", "split")


@query("pooled_train", "SELECT stay_id, label FROM fx_split WHERE split = 'train'")
def pooled_train(spark, sf):
    return clients.pooled(fx.splits(spark, sf), "train").select("stay_id", "label")


@query("row_split", """
    WITH r AS (SELECT stay_id, client, row_number() OVER (PARTITION BY client ORDER BY md5('42-' || stay_id)) - 1 AS rk,
                      count(*) OVER (PARTITION BY client) AS n FROM fx_clients)
    SELECT stay_id, client, CASE WHEN rk < floor(n * 0.15::DOUBLE) THEN 'test'
                                 WHEN rk < 2 * floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def row_split(spark, sf):
    return clients.row_split(fx.site_rows(spark, sf)).select("stay_id", "client", "split")


# --- description ------------------------------------------------------------------------

_HET = """
    het AS (
        SELECT client, count(*) AS n, avg(label) AS rate, avg(age) AS mean_age,
               quantile_cont(los_hours, 0.5) AS med, (SELECT avg(label) FROM fx_cohort) AS g
        FROM fx_clients GROUP BY client),
    rep AS (
        SELECT client, n, rate * 100 AS outcome_pct, mean_age, med AS median_los_h,
               0.5 * (1 - rate) * ln((1 - rate) / ((2 - rate - g) / 2))
               + 0.5 * (1 - g) * ln((1 - g) / ((2 - rate - g) / 2))
               + CASE WHEN rate > 0 THEN 0.5 * rate * ln(rate / ((rate + g) / 2)) ELSE 0 END
               + 0.5 * g * ln(g / ((rate + g) / 2)) AS js
        FROM het)"""


@query("heterogeneity_report", f"""
    WITH {_HET} SELECT client, n, round(outcome_pct, 4) AS outcome_pct, round(mean_age, 4) AS mean_age,
                       round(median_los_h, 4) AS median_los_h, round(js, 5) AS js_divergence FROM rep""")
def heterogeneity_report(spark, sf):
    c = fx.stored_cohort(spark, sf)
    r = clients.heterogeneity(clients.by_category(c, "unit", fx.MIN_CLIENT), c)
    return r.select("client", "n", *[F.round(k, d).alias(k) for k, d in (
        ("outcome_pct", 4), ("mean_age", 4), ("median_los_h", 4), ("js_divergence", 5))])


@query("client_rate_spread", f"""
    WITH {_HET} SELECT round(min(outcome_pct), 4) AS min_pct, round(max(outcome_pct), 4) AS max_pct,
                       round(max(outcome_pct) - min(outcome_pct), 4) AS range_pp,
                       round(avg(js), 5) AS mean_js, CAST(sum(n) AS BIGINT) AS n_rows FROM rep""")
def client_rate_spread(spark, sf):
    c = fx.stored_cohort(spark, sf)
    r = clients.rate_spread(clients.heterogeneity(clients.by_category(c, "unit", fx.MIN_CLIENT), c))
    return r.select(*[F.round(k, 4).alias(k) for k in ("min_pct", "max_pct", "range_pp")],
                    F.round("mean_js", 5).alias("mean_js"), "n_rows")


@query("client_table_rollup", """
    SELECT client, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS events, round(avg(label), 6) AS rate
    FROM fx_split GROUP BY ROLLUP (client, split)""")
def client_table_rollup(spark, sf):
    return clients.client_totals(fx.splits(spark, sf)).withColumn("rate", r6("rate"))


@query("table1_cohort", """
    WITH g AS (SELECT 'Overall' AS grp, * FROM fx_clients
               UNION ALL SELECT CASE label WHEN 1 THEN 'Outcome: yes' ELSE 'Outcome: no' END, * FROM fx_clients
               UNION ALL SELECT 'Client: ' || client, * FROM fx_clients),
    q AS (SELECT grp, count(*) AS n, quantile_cont(age, [0.25, 0.5, 0.75]) AS a,
                 quantile_cont(los_hours, [0.25, 0.5, 0.75]) AS l,
                 count(*) FILTER (gender = 'M') AS m, sum(label) AS d FROM g GROUP BY grp)
    SELECT grp, n, printf('%.0f (%.0f-%.0f)', round_even(a[2], 0), round_even(a[1], 0), round_even(a[3], 0)) AS age,
           printf('%.1f (%.1f-%.1f)', round_even(l[2], 1), round_even(l[1], 1), round_even(l[3], 1)) AS los_hours,
           printf('%d (%.1f)', CAST(m AS BIGINT), m * 100.0::DOUBLE / n) AS male,
           printf('%d (%.1f)', CAST(d AS BIGINT), d * 100.0::DOUBLE / n) AS died FROM q""")
def table1_cohort(spark, sf):
    return clients.table_one(fx.site_rows(spark, sf), {"age": 0, "los_hours": 1},
                             {"male": F.col("gender") == "M", "died": F.col("label") == 1})


@query("cohort_quartiles", """
    SELECT client, round(quantile_cont(los_hours, 0.25), 6) AS q1, round(quantile_cont(los_hours, 0.5), 6) AS q2,
           round(quantile_cont(los_hours, 0.75), 6) AS q3 FROM fx_clients GROUP BY client""")
def cohort_quartiles(spark, sf):
    q = exact_quantiles(fx.site_rows(spark, sf), "los_hours", {"q1": .25, "q2": .5, "q3": .75}, ["client"])
    return q.select("client", *[r6(k).alias(k) for k in ("q1", "q2", "q3")])


# --- normalising ------------------------------------------------------------------------

def _site_grid(spark, sf):
    """Filled grid with a site per entity: the user's number modulo 3.

    The dense rows are stored nowhere: what reads them again starts from the same shuffle of packed bins.
    """
    return (fx.grid(spark, sf)
            .withColumn("client", F.concat(F.lit("s"), (F.floor(F.col("stay_id") / 100) % 3).cast("string")))
            .withColumn("train", (F.col("stay_id") % 7) < 5))


_NORM = """
    sg AS (SELECT *, 's' || CAST(floor(stay_id / 100) AS BIGINT) % 3 AS client, stay_id % 7 < 5 AS train FROM fx_filled),
    md AS (SELECT client, feature, coalesce(median(value), 0) AS med FROM sg WHERE train GROUP BY ALL),
    st AS (SELECT sg.client, sg.feature, any_value(med) AS med, count(*) AS n_rows, count(value) AS n_seen,
                  avg(coalesce(value, med)) AS mu, stddev_pop(coalesce(value, med)) + 1e-6 AS sd
           FROM sg JOIN md ON sg.client = md.client AND sg.feature = md.feature WHERE train GROUP BY ALL)"""


@query("client_normaliser", f"""
    WITH {_NORM} SELECT client, feature, n_rows, n_seen, round(med, 6) AS median, round(mu, 6) AS mean,
                        round(sd, 6) AS sd FROM st""")
def client_normaliser(spark, sf):
    s = clients.fit_normaliser(_site_grid(spark, sf).where("train"))
    return s.select("client", "feature", "n_rows", "n_seen", *[r6(k).alias(k) for k in ("median", "mean", "sd")])


@query("avg_normaliser", f"""
    WITH {_NORM} SELECT feature, round(avg(med), 6) AS median, round(avg(mu), 6) AS mean, round(avg(sd), 6) AS sd
    FROM st GROUP BY feature""")
def avg_normaliser(spark, sf):
    s = clients.average_normaliser(clients.fit_normaliser(_site_grid(spark, sf).where("train")))
    return s.select("feature", *[r6(k).alias(k) for k in ("median", "mean", "sd")])


@query("normalised_grid", f"""
    WITH {_NORM} SELECT stay_id, sg.feature, hr, round((coalesce(value, med) - mu) / sd, 5) AS z
    FROM sg JOIN st ON sg.client = st.client AND sg.feature = st.feature""")
def normalised_grid(spark, sf):
    g = _site_grid(spark, sf)
    z = clients.apply_normaliser(g, clients.fit_normaliser(g.where("train")))
    return z.select("stay_id", "feature", "hr", F.round("z", 5).alias("z"))


@query("renormalise_domains", f"""
    WITH {_NORM},
    src AS (SELECT feature, avg(med) AS med, avg(mu) AS mu, avg(sd) AS sd FROM st WHERE client <> 's0' GROUP BY 1),
    tg AS (SELECT feature, value, coalesce(median(value) OVER (PARTITION BY feature), 0) AS tmed
           FROM sg WHERE client = 's0'),
    own AS (SELECT feature, any_value(tmed) AS med, avg(coalesce(value, tmed)) AS mu,
                   stddev_pop(coalesce(value, tmed)) + 1e-6 AS sd FROM tg GROUP BY 1)
    SELECT t.feature, round(avg((coalesce(value, src.med) - src.mu) / src.sd), 5) AS z_source_mean,
           round(stddev_pop((coalesce(value, src.med) - src.mu) / src.sd), 5) AS z_source_sd,
           round(avg((coalesce(value, own.med) - own.mu) / own.sd) + 0.0, 5) AS z_self_mean,
           round(stddev_pop((coalesce(value, own.med) - own.mu) / own.sd), 5) AS z_self_sd
    FROM tg t JOIN src ON t.feature = src.feature JOIN own ON t.feature = own.feature GROUP BY t.feature""")
def renormalise_domains(spark, sf):
    g = _site_grid(spark, sf)
    target = g.where(F.col("client") == "s0").select("stay_id", "feature", "hr", "value")
    source = clients.average_normaliser(
        clients.fit_normaliser(g.where(F.col("train") & (F.col("client") != "s0"))))
    own = clients.fit_normaliser(target, by=["feature"])
    a = clients.apply_normaliser(target, source, by=["feature"]).withColumnRenamed("z", "z_source")
    b = clients.apply_normaliser(a, own, by=["feature"])
    return b.groupBy("feature").agg(
        F.round(F.avg("z_source"), 5).alias("z_source_mean"), F.round(F.stddev_pop("z_source"), 5).alias("z_source_sd"),
        (F.round(F.avg("z"), 5) + 0.0).alias("z_self_mean"), F.round(F.stddev_pop("z"), 5).alias("z_self_sd"))


# --- integrity --------------------------------------------------------------------------

@query("dq_required_columns", """
    SELECT name, level, detail, n_rows FROM (VALUES
        ('orders', CASE WHEN (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'orders'
                              AND column_name IN ('o_orderkey', 'o_custkey', 'o_orderdate')) = 3 THEN 'ok' END,
         (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'orders') || ' columns', (SELECT count(*) FROM orders)),
        ('events', 'FAIL', 'missing: charttime', (SELECT count(*) FROM events)),
        ('labels', 'ok', (SELECT count(*) FROM duckdb_columns() WHERE table_name = 'labels') || ' columns', (SELECT count(*) FROM labels))
    ) t(name, level, detail, n_rows)""")
def dq_required_columns(spark, sf):
    spec = {"orders": ["o_orderkey", "o_custkey", "o_orderdate"], "events": ["event_id", "ts", "charttime"],
            "labels": ["doc_id", "quality", "toxic"]}
    found = quality.required_columns({k: fx.table(spark, sf, k) for k in spec}, spec)
    report = spark.createDataFrame(found, "name string, level string, detail string")
    rows = None
    for k in spec:
        n = fx.table(spark, sf, k).agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        rows = n if rows is None else rows.unionByName(n)
    return report.join(rows, "name")


@query("dq_missing_codes", """
    SELECT grp, code, level FROM (VALUES ('types', 'ECONOMY', 'FAIL'), ('types', 'GIGANTIC', 'FAIL'),
        ('extra', 'SMALL', 'WARN'), ('extra', 'NOWHERE', 'WARN')) t(grp, code, level)
    WHERE code NOT IN (SELECT p_type FROM part)""")
def dq_missing_codes(spark, sf):
    return quality.missing_codes(fx.table(spark, sf, "part"), "p_type",
                                 {"types": ["ECONOMY", "GIGANTIC"], "extra": ["SMALL", "NOWHERE"]}, ["extra"])


@query("dq_domain_diff", """
    SELECT DISTINCT event_type AS value, 'unexpected' AS problem FROM events
    WHERE event_type NOT IN ('click', 'view', 'refund')
    UNION ALL SELECT v, 'absent' FROM (VALUES ('click'), ('view'), ('refund')) t(v)
    WHERE v NOT IN (SELECT event_type FROM events)""")
def dq_domain_diff(spark, sf):
    return quality.domain_diff(fx.table(spark, sf, "events"), "event_type", ["click", "view", "refund"])


@query("dq_group_sizes", """
    SELECT unit, count(*) AS n, CAST(count(*) < 150 AS INTEGER) AS below_min,
           (SELECT count(*) FROM fx_stays) AS n_total FROM fx_stays GROUP BY unit""")
def dq_group_sizes(spark, sf):
    return quality.group_sizes(fx.stays(spark, sf), "unit", 150)


@query("order_violations", """
    SELECT count(*) AS violations FROM (
        SELECT o_custkey AS k, lag(o_custkey) OVER (ORDER BY o_orderkey) AS prev FROM orders) WHERE k < prev""")
def order_violations(spark, sf):
    return quality.order_violations(fx.table(spark, sf, "orders"), "o_orderkey", "o_custkey", chunk=1000)


@query("prefix_cutoff", """
    SELECT min(user_id) AS min_key, max(user_id) AS max_key, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys,
           max(user_id) FILTER (user_id < (SELECT max(user_id) FROM events)) AS cutoff FROM events""")
def prefix_cutoff(spark, sf):
    return quality.prefix_stats(fx.table(spark, sf, "events"), "user_id")


@query("prefix_survivors", """
    WITH k AS (SELECT max(subject_id) AS c FROM fx_cohort WHERE subject_id < (SELECT max(subject_id) FROM fx_cohort))
    SELECT count(*) AS n_stays, count(DISTINCT subject_id) AS n_subjects FROM fx_cohort, k WHERE subject_id <= c""")
def prefix_survivors(spark, sf):
    c = fx.stored_cohort(spark, sf)
    cutoff = quality.prefix_stats(c, "subject_id").select("cutoff").scalar()
    return c.where(F.col("subject_id") <= cutoff).agg(
        F.count(F.lit(1)).alias("n_stays"), F.countDistinct("subject_id").alias("n_subjects"))


def _tree_sql():
    levels = ["""t0 AS (SELECT stay_id AS k, stay_id || ':' || count(*) AS v FROM fx_cohort GROUP BY stay_id)"""]
    for i in range(5):
        levels.append(f"""t{i + 1} AS (SELECT CAST(floor(k / 4096) AS BIGINT) AS k,
            sha256(string_agg(v, ',' ORDER BY k)) AS v FROM t{i} GROUP BY CAST(floor(k / 4096) AS BIGINT))""")
    return "WITH " + ", ".join(levels) + (
        " SELECT substring(sha256(string_agg(v, ',' ORDER BY k)), 1, 16) AS fingerprint FROM t5")


@query("cohort_fingerprint", _tree_sql())
def cohort_fingerprint(spark, sf):
    return quality.fingerprint(fx.stored_cohort(spark, sf))


@query("partition_membership", """
    WITH u AS (SELECT unit, avg(label) AS r FROM fx_cohort GROUP BY 1)
    SELECT s.client, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS events, round(avg(label), 6) AS test_rate,
           round(avg(CAST(s.unit = s.client AS DOUBLE)), 6) AS own_share, round(any_value(u.r), 6) AS unit_rate,
           CAST(avg(CAST(s.unit = s.client AS DOUBLE)) > 0.99 AS INTEGER) AS valid,
           (SELECT count(*) FROM fx_cohort) AS n_cohort
    FROM fx_split s LEFT JOIN u ON u.unit = s.client WHERE split = 'test' GROUP BY s.client""")
def partition_membership(spark, sf):
    m = quality.membership(fx.splits(spark, sf), fx.stored_cohort(spark, sf))
    return m.select(*[r6(c).alias(c) if c in ("test_rate", "own_share", "unit_rate") else c for c in m.columns])


_LEAKY = """
    w AS (SELECT client, subject_id FROM fx_split GROUP BY ALL HAVING count(DISTINCT split) > 1),
    g AS (SELECT subject_id FROM fx_split GROUP BY ALL HAVING count(DISTINCT split) > 1)"""


@query("split_leakage", f"""
    WITH {_LEAKY} SELECT 'within_client' AS scope, client, CAST(subject_id AS VARCHAR) AS subject FROM w
    UNION ALL SELECT 'global', NULL, CAST(subject_id AS VARCHAR) FROM g""")
def split_leakage(spark, sf):
    return quality.split_leakage(fx.splits(spark, sf))


@query("leakage_counts", f"""
    WITH {_LEAKY} SELECT (SELECT count(*) FROM w) AS within_client, (SELECT count(*) FROM g) AS across_clients""")
def leakage_counts(spark, sf):
    return quality.leakage_counts(fx.splits(spark, sf))


@query("thin_clients", """
    SELECT client, CAST(coalesce(sum(label) FILTER (split = 'train'), 0) AS BIGINT) AS train_events,
           CAST(coalesce(sum(label) FILTER (split = 'val'), 0) AS BIGINT) AS val_events,
           CAST(coalesce(sum(label) FILTER (split = 'test'), 0) AS BIGINT) AS test_events
    FROM fx_split GROUP BY client HAVING train_events < 50 OR test_events < 25""")
def thin_clients(spark, sf):
    return quality.thin_clients(fx.splits(spark, sf))


# --- representativeness -------------------------------------------------------------------

_KEPT = "subject_id <= 900"

_BAND = """CASE WHEN {e} IS NULL THEN 'n/a' WHEN abs({e}) < 0.1 THEN 'negligible' WHEN abs({e}) < 0.2 THEN 'very small'
    WHEN abs({e}) < 0.5 THEN 'small' WHEN abs({e}) < 0.8 THEN 'medium' ELSE 'large' END"""


@query("welch_effect", f"""
    WITH l AS (SELECT {_KEPT} AS kept, unnest(['age', 'los_hours']) AS characteristic,
                      unnest([CAST(age AS DOUBLE), los_hours]) AS x FROM fx_cohort),
    s AS (SELECT characteristic, count(x) FILTER (kept) AS n1, count(x) FILTER (NOT kept) AS n2,
                 avg(x) FILTER (kept) AS m1, avg(x) FILTER (NOT kept) AS m2,
                 var_samp(x) FILTER (kept) AS v1, var_samp(x) FILTER (NOT kept) AS v2 FROM l GROUP BY 1),
    e AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s)
    SELECT characteristic, n1 AS n_kept, n2 AS n_excluded, round(m1, 6) AS mean_kept, round(m2, 6) AS mean_excluded,
           round(sqrt(v1), 6) AS sd_kept, round(sqrt(v2), 6) AS sd_excluded,
           round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
           round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df,
           round(d, 6) AS cohens_d, {_BAND.format(e='d')} AS magnitude FROM e""")
def welch_effect(spark, sf):
    w = quality.welch_effect(fx.stored_cohort(spark, sf), F.expr(_KEPT), ["age", "los_hours"])
    return w.select("characteristic", "n_kept", "n_excluded", *[r6(c).alias(c) for c in (
        "mean_kept", "mean_excluded", "sd_kept", "sd_excluded", "t")],
        F.round("df", 4).alias("df"), r6("cohens_d").alias("cohens_d"), "magnitude")


@query("welch_material", f"""
    WITH l AS (SELECT {_KEPT} AS kept, unnest(['age', 'los_hours']) AS characteristic,
                      unnest([CAST(age AS DOUBLE), los_hours]) AS x FROM fx_cohort),
    s AS (SELECT characteristic, count(x) FILTER (kept) AS n1, count(x) FILTER (NOT kept) AS n2,
                 avg(x) FILTER (kept) AS m1, avg(x) FILTER (NOT kept) AS m2,
                 var_samp(x) FILTER (kept) AS v1, var_samp(x) FILTER (NOT kept) AS v2 FROM l GROUP BY 1),
    e AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d,
                 (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
                 pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM s),
    p AS (SELECT *, {sql_p_t('t', 'df')} AS p FROM e)
    SELECT characteristic, round(d, 6) AS cohens_d, round(p, 5) AS p_value, p < 0.05 AND abs(d) >= 0.2 AS material FROM p""")
def welch_material(spark, sf):
    w = quality.welch_effect(fx.stored_cohort(spark, sf), F.expr(_KEPT), ["age", "los_hours"])
    w = quality.with_material(w, p_t("t", "df"), "cohens_d")
    return w.select("characteristic", r6("cohens_d").alias("cohens_d"), F.round("p_value", 5).alias("p_value"), "material")


@query("prop_material", f"""
    WITH l AS (SELECT CAST({_KEPT} AS INTEGER) AS k, unnest(['died', 'male', 'always']) AS characteristic,
                      unnest([label, CAST(gender = 'M' AS INTEGER), 1]) AS x FROM fx_cohort),
    c AS (SELECT characteristic, sum(k)::DOUBLE AS n1, sum(1 - k)::DOUBLE AS n2, sum(k * x)::DOUBLE AS a,
                 sum((1 - k) * x)::DOUBLE AS b FROM l GROUP BY 1),
    g AS (SELECT *, a + b AS yes, n1 + n2 AS n,
                 abs(a - n1 * (a + b) / (n1 + n2)) - least(0.5, abs(a - n1 * (a + b) / (n1 + n2))) AS gap FROM c),
    h AS (SELECT *, CASE WHEN yes < n AND n1 > 0 AND n2 > 0 THEN gap * gap * (n / (n1 * yes) + n / (n2 * yes) + n / (n1 * (n - yes))
                         + n / (n2 * (n - yes))) END AS chi2,
                 CASE WHEN yes < n AND n1 > 0 AND n2 > 0 THEN 2 * asin(sqrt(a / n1)) - 2 * asin(sqrt(b / n2)) END AS h FROM g),
    p AS (SELECT *, CASE WHEN chi2 > 0 THEN {sql_p_normal('sqrt(chi2)')} WHEN chi2 = 0 THEN 1.0::DOUBLE END AS p FROM h)
    SELECT characteristic, round(chi2, 6) AS chi2, round(p, 5) AS p_value, p < 0.05 AND abs(h) >= 0.2 AS material FROM p""")
def prop_material(spark, sf):
    p = quality.proportion_effect(fx.stored_cohort(spark, sf), F.expr(_KEPT), {
        "died": F.col("label"), "male": F.col("gender") == "M", "always": F.lit(1)})
    p = quality.with_material(p, p_chi2("chi2", F.lit(1.0)), "cohens_h")
    return p.select("characteristic", r6("chi2").alias("chi2"), F.round("p_value", 5).alias("p_value"), "material")


@query("composition_p", f"""
    WITH c AS (SELECT unit, count(*) FILTER ({_KEPT}) AS a, count(*) FILTER (NOT {_KEPT}) AS b
               FROM fx_cohort GROUP BY 1),
    t AS (SELECT sum(a) AS sa, sum(b) AS sb, sum(a + b) AS n FROM c),
    x AS (SELECT sum(pow(a - (a + b) * sa / n, 2) / ((a + b) * sa / n)
                     + pow(b - (a + b) * sb / n, 2) / ((a + b) * sb / n)) AS chi2, count(*) - 1 AS df FROM c, t)
    SELECT round(chi2, 6) AS chi2, df, round({sql_p_chi2('chi2', 'df')}, 5) AS p_value FROM x""")
def composition_p(spark, sf):
    c = quality.composition_chi2(fx.stored_cohort(spark, sf), F.expr(_KEPT), "unit")
    return c.select(r6("chi2").alias("chi2"), "df", F.round(p_chi2("chi2", "df"), 5).alias("p_value"))


@query("prop_effect", f"""
    WITH l AS (SELECT CAST({_KEPT} AS INTEGER) AS k, unnest(['died', 'male', 'urgent', 'always']) AS characteristic,
                      unnest([label, CAST(gender = 'M' AS INTEGER), CAST(contains(admission_type, 'URGENT') AS INTEGER), 1]) AS x
               FROM fx_cohort),
    c AS (SELECT characteristic, sum(k)::DOUBLE AS n1, sum(1 - k)::DOUBLE AS n2, sum(k * x)::DOUBLE AS a,
                 sum((1 - k) * x)::DOUBLE AS b FROM l GROUP BY 1),
    g AS (SELECT *, a + b AS yes, n1 + n2 AS n,
                 abs(a - n1 * (a + b) / (n1 + n2)) - least(0.5, abs(a - n1 * (a + b) / (n1 + n2))) AS gap FROM c),
    h AS (SELECT *, CASE WHEN yes < n THEN gap * gap * (n / (n1 * yes) + n / (n2 * yes) + n / (n1 * (n - yes))
                         + n / (n2 * (n - yes))) END AS chi2,
                 CASE WHEN yes < n THEN 2 * asin(sqrt(a / n1)) - 2 * asin(sqrt(b / n2)) END AS h FROM g)
    SELECT characteristic, round(a / n1, 6) AS p_kept, round(b / n2, 6) AS p_excluded, round(chi2, 6) AS chi2,
           round(h, 6) AS cohens_h, CASE WHEN h IS NULL THEN 'not testable' ELSE {_BAND.format(e='h')} END AS magnitude
    FROM h""")
def prop_effect(spark, sf):
    p = quality.proportion_effect(fx.stored_cohort(spark, sf), F.expr(_KEPT), {
        "died": F.col("label"), "male": F.col("gender") == "M",
        "urgent": F.col("admission_type").contains("URGENT"), "always": F.lit(1)})
    return p.select("characteristic", *[r6(c).alias(c) for c in ("p_kept", "p_excluded", "chi2", "cohens_h")],
                    "magnitude")


@query("composition_chi2", f"""
    WITH c AS (SELECT unit, count(*) FILTER ({_KEPT}) AS a, count(*) FILTER (NOT {_KEPT}) AS b
               FROM fx_cohort GROUP BY 1),
    t AS (SELECT sum(a) AS sa, sum(b) AS sb, sum(a + b) AS n FROM c)
    SELECT round(sum(pow(a - (a + b) * sa / n, 2) / ((a + b) * sa / n)
                     + pow(b - (a + b) * sb / n, 2) / ((a + b) * sb / n)), 6) AS chi2,
           count(*) - 1 AS df, CAST(any_value(n) AS BIGINT) AS n FROM c, t""")
def composition_chi2(spark, sf):
    return quality.composition_chi2(fx.stored_cohort(spark, sf), F.expr(_KEPT), "unit").withColumn("chi2", r6("chi2"))

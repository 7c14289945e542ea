"""Queries: cohort building, joins, events, series, features, code history, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import scalars as S
from sitewise.operators import cohort, features, joins, quality, series
from sitewise.plans import fixtures as fx
from sitewise.plans.registry import query


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- cohort ---------------------------------------------------------------------------

@query("cohort_build", """
    SELECT subject_id, hadm_id, stay_id, unit, intime, round(los_hours, 6) AS los_hours, age, gender,
           year_group, admission_type, deathtime, label FROM fx_cohort""")
def cohort_build(spark, sf):
    return fx.visit_cohort(spark, sf).withColumn("los_hours", r6("los_hours"))


@query("cohort_flow", """
    WITH j AS (
        SELECT p.anchor_age + (year(s.intime) - p.anchor_year) >= 18 AND s.los * 24.0 >= 24 AS adult,
               coalesce(a.deathtime <= s.intime + INTERVAL 24 HOUR, false) AS early
        FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) AS rn
              FROM fx_stays) s
        JOIN fx_patients p ON s.subject_id = p.subject_id
        JOIN fx_adm a ON a.hadm_id = s.hadm_id WHERE rn = 1),
    n AS (SELECT (SELECT count(*) FROM fx_stays) AS a,
                 (SELECT count(DISTINCT hadm_id) FROM fx_stays) AS b,
                 (SELECT count(*) FROM j WHERE adult) AS c,
                 (SELECT count(*) FROM j WHERE adult AND NOT early) AS d)
    SELECT 1 AS step_no, 'All stays' AS step, a AS n_stays, NULL::BIGINT AS excluded FROM n
    UNION ALL SELECT 2, 'First stay per admission', b, a - b FROM n
    UNION ALL SELECT 3, 'Adults (age >= 18) and stay >= 24h', c, b - c FROM n
    UNION ALL SELECT 4, 'Outcome later than 24h', d, c - d FROM n""")
def cohort_flow(spark, sf):
    return cohort.exclusion_flow(
        fx.stays(spark, sf).drop("label", "deathtime", "admission_type"),
        fx.admissions(spark, sf), fx.patients(spark, sf))


@query("cohort_age_los", """
    SELECT s.stay_id, p.anchor_age + (year(s.intime) - p.anchor_year) AS age,
           round(s.los * 24.0, 6) AS los_hours
    FROM fx_stays s JOIN fx_patients p ON s.subject_id = p.subject_id""")
def cohort_age_los(spark, sf):
    return (fx.stays(spark, sf).join(fx.patients(spark, sf), "subject_id")
            .select("stay_id", S.age_at("anchor_age", "anchor_year", "intime").alias("age"),
                    r6(F.col("los") * 24.0).alias("los_hours")))


@query("exclude_early_outcome", """
    SELECT stay_id, deathtime FROM fx_stays
    WHERE NOT (deathtime IS NOT NULL AND deathtime <= intime + INTERVAL 24 HOUR)""")
def exclude_early_outcome(spark, sf):
    return (fx.stays(spark, sf).where(~cohort.early_outcome("deathtime", "intime", 24))
            .select("stay_id", "deathtime"))


@query("first_stay", """
    SELECT hadm_id, stay_id, intime, n AS n_in_key FROM (
        SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) AS rn,
               count(*) OVER (PARTITION BY hadm_id) AS n FROM fx_stays) WHERE rn = 1""")
def first_stay(spark, sf):
    return cohort.first_per_key(fx.stays(spark, sf).select("hadm_id", "intime", "stay_id"),
                                "hadm_id", "intime", "stay_id")


@query("cohort_summary", """
    SELECT count(*) AS n_stays, count(DISTINCT subject_id) AS n_subjects,
           round(avg(label), 6) AS outcome_rate, count(DISTINCT unit) AS n_units FROM fx_cohort""")
def cohort_summary(spark, sf):
    return (cohort.cohort_summary(fx.visit_cohort(spark, sf))
            .withColumn("outcome_rate", r6("outcome_rate")))


def _offset_patients(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("stay_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("subject_id"),
        (k % 17).alias("site"),
        F.when(k % 10 == 0, "> 89").when(k % 11 == 0, "").when(k % 13 == 0, "unknown")
        .otherwise((k % 90).cast("string")).alias("age"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
        (F.col("o_custkey") % 3 + 1).alias("visit_no"), (F.col("o_totalprice") / 80).alias("unit_end_min"),
        F.when(F.col("o_orderstatus") == "F", "Expired")
        .when(F.col("o_orderstatus") == "O", "Alive").alias("status"),
        (F.col("o_totalprice") / 100).alias("hospital_end_min"))


_OFFSET_VIEW = """
    op AS (SELECT o_orderkey AS stay_id, 'P' || o_custkey AS subject_id, o_orderkey % 17 AS site,
             CASE WHEN o_orderkey % 10 = 0 THEN '> 89' WHEN o_orderkey % 11 = 0 THEN ''
                  WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE CAST(o_orderkey % 90 AS VARCHAR) END AS age,
             CASE WHEN o_orderkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
             o_custkey % 3 + 1 AS visit_no, o_totalprice / 80 AS unit_end_min,
             CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'O' THEN 'Alive' END AS status,
             o_totalprice / 100 AS hospital_end_min FROM orders)"""


@query("cohort_offsets", f"""
    WITH {_OFFSET_VIEW}
    SELECT stay_id, subject_id, 'Site_' || site AS unit, age, gender, 'EMER.' AS admission_type,
           round(los_hours, 9) AS los_hours, label
    FROM (SELECT stay_id, subject_id, site, hospital_end_min, status, visit_no,
                 CASE WHEN age = '> 89' THEN 90.0::DOUBLE WHEN age IS NULL OR age = '' THEN NULL
                      ELSE TRY_CAST(age AS DOUBLE) END AS age, left(gender, 1) AS gender,
                 unit_end_min / 60.0 AS los_hours, CAST(status = 'Expired' AS INTEGER) AS label FROM op)
    WHERE visit_no = 1 AND status IS NOT NULL AND age >= 18 AND los_hours >= 24
      AND NOT (label = 1 AND hospital_end_min <= 1440)""")
def cohort_offsets(spark, sf):
    return (cohort.build_cohort_offsets(_offset_patients(spark, sf))
            .withColumn("los_hours", F.round("los_hours", 9)))


@query("try_cast_bucket", f"""
    WITH {_OFFSET_VIEW}
    SELECT CASE WHEN age = '> 89' THEN 90.0::DOUBLE WHEN age IS NULL OR age = '' THEN NULL
                ELSE TRY_CAST(age AS DOUBLE) END AS age_value,
           CAST(status = 'Expired' AS INTEGER) AS label, count(*) AS n
    FROM op WHERE status IS NOT NULL GROUP BY ALL""")
def try_cast_bucket(spark, sf):
    return (_offset_patients(spark, sf).where(F.col("status").isNotNull())
            .groupBy(S.age_from_text("age").alias("age_value"),
                     (F.col("status") == "Expired").cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- joins ---------------------------------------------------------------------------

@query("event_window_join", """
    SELECT s.stay_id, r.event_type, r.value,
           round(date_diff('minute', s.intime, r.charttime) / 60.0, 6) AS hours_in
    FROM fx_raw r JOIN fx_sess s ON r.stay_id = s.stay_id
    WHERE r.event_type IN ('click', 'view', 'purchase') AND r.value IS NOT NULL
      AND r.charttime >= s.intime AND r.charttime < s.intime + INTERVAL 12 HOUR""")
def event_window_join(spark, sf):
    ev = fx.raw_events(spark, sf).where(
        F.col("event_type").isin("click", "view", "purchase") & F.col("value").isNotNull())
    return (joins.window_join(ev, fx.sessions(spark, sf), "stay_id", "charttime", 12,
                              keep=["event_type", "value"])
            .withColumn("hours_in", r6("hours_in")))


@query("event_window_join_alt", """
    SELECT s.stay_id, s.subject_id, count(*) AS n, round(sum(r.value), 4) AS total
    FROM fx_raw r JOIN fx_sess s ON r.user_id = s.subject_id
    WHERE r.charttime >= s.intime AND r.charttime < s.intime + INTERVAL 6 HOUR GROUP BY ALL""")
def event_window_join_alt(spark, sf):
    sess = fx.sessions(spark, sf)
    ev = fx.raw_events(spark, sf).withColumnRenamed("user_id", "subject_id")
    # a user has many sessions: the join is on a key that is not unique
    hit = joins.window_join(ev, sess.select("subject_id", "stay_id", "intime"), "subject_id", "charttime", 6,
                            keep=["subject_id", "value"])
    return hit.groupBy("stay_id", "subject_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("offset_events", """
    SELECT o_orderkey AS stay_id, l_quantity AS value, round(l_suppkey * 37 % 2000 / 60.0, 6) AS hours_in
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' AND l_suppkey * 37 % 2000 >= 0 AND l_suppkey * 37 % 2000 < 1440""")
def offset_events(spark, sf):
    ev = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), F.col("l_quantity").alias("value"),
        (F.col("l_suppkey") * 37 % 2000).alias("offset_min"))
    keep = (fx.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
            .select(F.col("o_orderkey").alias("stay_id")))
    return (series.offset_events(ev, keep, "offset_min", 24)
            .select("stay_id", "value", r6("hours_in").alias("hours_in")))


@query("prior_history_join", """
    SELECT c.stay_id, count(d.icd_code) AS n_prior,
           count(CASE WHEN d.icd_version = 10 THEN 1 END) AS n_prior_v10
    FROM fx_cohort c
    LEFT JOIN (SELECT d.*, a.subject_id, a.dischtime FROM fx_dx d JOIN fx_adm a ON d.hadm_id = a.hadm_id) d
      ON d.subject_id = c.subject_id AND d.dischtime < c.intime AND d.hadm_id <> c.hadm_id
    GROUP BY c.stay_id""")
def prior_history_join(spark, sf):
    hist = fx.diagnoses(spark, sf).groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("n_dx"), F.count(F.when(F.col("icd_version") == 10, 1)).alias("n_v10"))
    hist = hist.join(fx.admissions(spark, sf).select("hadm_id", "subject_id", "dischtime"), "hadm_id")
    return joins.history_totals(
        hist, fx.stored_cohort(spark, sf), "subject_id", "dischtime", "intime",
        {"n_prior": F.col("n_dx"), "n_prior_v10": F.col("n_v10")}, "hadm_id", "stay_id")


@query("current_history_join", """
    SELECT c.stay_id, d.icd_code, d.icd_version, count(*) AS n
    FROM fx_dx d JOIN fx_cohort c ON d.hadm_id = c.hadm_id GROUP BY ALL""")
def current_history_join(spark, sf):
    return (fx.diagnoses(spark, sf).join(fx.visit_cohort(spark, sf).select("hadm_id", "stay_id"), "hadm_id")
            .groupBy("stay_id", "icd_code", "icd_version").agg(F.count(F.lit(1)).alias("n")))


@query("known_features_semi", """
    SELECT event_id, event_type FROM events
    WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > 10)""")
def known_features_semi(spark, sf):
    ev = fx.table(spark, sf, "events")
    known = ev.groupBy("event_type").agg(F.avg("value").alias("m")).where(F.col("m") > 10)
    return ev.join(known, "event_type", "left_semi").select("event_id", "event_type")


@query("excluded_complement", """
    SELECT stay_id, subject_id FROM fx_stays WHERE stay_id NOT IN (SELECT stay_id FROM fx_cohort)""")
def excluded_complement(spark, sf):
    return (fx.stays(spark, sf).join(fx.visit_cohort(spark, sf).select("stay_id"), "stay_id", "left_anti")
            .select("stay_id", "subject_id"))


# --- events -----------------------------------------------------------------------------

# (feature, lowest, highest) and the codes of each feature
_LIMITS = (("click", 0, 40), ("view", 2, 60), ("purchase", 0, 80), ("error", 0, 30))
_CODES = (("click", "click"), ("view", "view"), ("purchase", "purchase"), ("error", "error"))
_LIMIT_SQL = ("CASE event_type WHEN 'click' THEN value BETWEEN 0 AND 40 "
              "WHEN 'view' THEN value BETWEEN 2 AND 60 WHEN 'purchase' THEN value BETWEEN 0 AND 80 "
              "WHEN 'error' THEN value BETWEEN 0 AND 30 ELSE false END")


def _coded(spark, sf):
    return series.map_codes(fx.raw_events(spark, sf), "event_type", _CODES)


@query("code_to_feature", """
    SELECT CASE event_type WHEN 'click' THEN 'f_click' WHEN 'view' THEN 'f_click'
                WHEN 'purchase' THEN 'f_buy' END AS feature, count(*) AS n, round(sum(value), 4) AS total
    FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def code_to_feature(spark, sf):
    coded = series.map_codes(fx.raw_events(spark, sf), "event_type",
                             (("f_click", "click"), ("f_click", "view"), ("f_buy", "purchase")))
    return coded.groupBy("feature").agg(F.count(F.lit(1)).alias("n"),
                                        F.round(F.sum("value"), 4).alias("total"))


@query("range_filter", f"SELECT event_id, event_type AS feature, value FROM fx_raw WHERE {_LIMIT_SQL}")
def range_filter(spark, sf):
    return series.within_limits(_coded(spark, sf), _LIMITS).select("event_id", "feature", "value")


@query("unit_fold", f"""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS feature,
           round(CASE event_type WHEN 'view' THEN (value - 32.0) * 5.0 / 9.0 ELSE value END, 6) AS value
    FROM fx_raw WHERE {_LIMIT_SQL}""")
def unit_fold(spark, sf):
    ok = series.within_limits(_coded(spark, sf), _LIMITS)
    return (series.fold_unit(ok, "view", "click", series.fahrenheit_to_celsius)
            .select("event_id", "feature", r6("value").alias("value")))


def _window_events(spark, sf):
    sess = fx.sessions(spark, sf)
    ok = series.fold_unit(series.within_limits(_coded(spark, sf), _LIMITS), "view", "click",
                          series.fahrenheit_to_celsius)
    measured = joins.window_join(ok, sess, "stay_id", "charttime", 12, keep=["feature", "value"])
    switch = fx.raw_events(spark, sf).where(F.col("event_type") == "signup")
    switched = series.constant_feature(
        joins.window_join(switch, sess, "stay_id", "charttime", 12), "signup")
    nothing = spark.createDataFrame([], series.EVENT_SCHEMA)      # an optional source that is absent
    return series.union_events(measured, switched, nothing)


_WINDOW_EVENTS = f"""
    we AS (
        SELECT s.stay_id, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS feature,
               CASE event_type WHEN 'view' THEN (value - 32.0) * 5.0 / 9.0 ELSE value END AS value,
               date_diff('minute', s.intime, r.charttime) / 60.0 AS hours_in
        FROM fx_raw r JOIN fx_sess s ON r.stay_id = s.stay_id
        WHERE {_LIMIT_SQL} AND r.charttime >= s.intime AND r.charttime < s.intime + INTERVAL 12 HOUR
        UNION ALL
        SELECT s.stay_id, 'signup', 1.0, date_diff('minute', s.intime, r.charttime) / 60.0
        FROM fx_raw r JOIN fx_sess s ON r.stay_id = s.stay_id
        WHERE event_type = 'signup' AND r.charttime >= s.intime
          AND r.charttime < s.intime + INTERVAL 12 HOUR)"""


@query("events_long", f"""
    WITH {_WINDOW_EVENTS} SELECT stay_id, feature, round(value, 6) AS value,
                                 round(hours_in, 6) AS hours_in FROM we""")
def events_long(spark, sf):
    return _window_events(spark, sf).select("stay_id", "feature", r6("value").alias("value"),
                                            r6("hours_in").alias("hours_in"))


@query("optional_source_union", f"""
    WITH {_WINDOW_EVENTS} SELECT feature, count(*) AS n, round(sum(value), 4) AS total FROM we GROUP BY 1""")
def optional_source_union(spark, sf):
    return _window_events(spark, sf).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("unpivot_vitals", """
    SELECT l_orderkey AS stay_id, l_linenumber AS line, feature, value FROM (
        SELECT l_orderkey, l_linenumber, unnest(['qty', 'disc', 'tax']) AS feature,
               unnest([l_quantity, CASE WHEN l_discount > 0 THEN l_discount END, l_tax]) AS value
        FROM lineitem) WHERE value IS NOT NULL""")
def unpivot_vitals(spark, sf):
    wide = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("line"), "l_quantity",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    return series.unpivot_measures(wide, ["stay_id", "line"],
                                   {"qty": "l_quantity", "disc": "l_discount", "tax": "l_tax"})


@query("coverage_gate", """
    SELECT (SELECT count(*) FROM fx_sess) AS n_stays,
           round(count(DISTINCT stay_id) / (SELECT count(*) FROM fx_sess), 6) AS any_share,
           round(count(DISTINCT CASE WHEN feature = 'click' THEN stay_id END)
                 / (SELECT count(*) FROM fx_sess), 6) AS click_share,
           round(count(DISTINCT CASE WHEN feature = 'error' THEN stay_id END)
                 / (SELECT count(*) FROM fx_sess), 6) AS error_share
    FROM fx_events""")
def coverage_gate(spark, sf):
    c = series.coverage(fx.long_events(spark, sf), fx.sessions(spark, sf), ["click", "error"])
    return c.select("n_stays", *[r6(k).alias(k) for k in c.columns[1:]])


# --- series -----------------------------------------------------------------------------

@query("hourly_bins", """
    SELECT stay_id, feature, CAST(floor(hours_in) AS INTEGER) AS hr,
           round(CASE WHEN feature = 'purchase' THEN sum(value)
                      WHEN feature IN ('error', 'signup') THEN max(value) ELSE avg(value) END, 6) AS value
    FROM fx_events WHERE hours_in >= 0 AND hours_in < 24 GROUP BY stay_id, feature, floor(hours_in)""")
def hourly_bins(spark, sf):
    return (series.hourly_bins(fx.long_events(spark, sf), 24, fx.SUMS, fx.SWITCHES)
            .withColumn("value", r6("value")))


@query("six_hour_bins", "SELECT stay_id, feature, hr, round(value, 6) AS value FROM fx_bins")
def six_hour_bins(spark, sf):
    return fx.bins(spark, sf).withColumn("value", r6("value"))


@query("dense_grid", "SELECT stay_id, feature, hr, round(raw, 6) AS raw, observed FROM fx_grid")
def dense_grid(spark, sf):
    g = series.dense_grid(fx.bins(spark, sf), fx.sessions(spark, sf), fx.FEATURES, fx.STEPS, fx.SWITCHES)
    return g.withColumn("raw", r6("raw"))


@query("observed_mask", """
    SELECT feature, hr, CAST(sum(observed) AS BIGINT) AS n_observed, count(*) AS n FROM fx_grid GROUP BY ALL""")
def observed_mask(spark, sf):
    return fx.grid(spark, sf).groupBy("feature", "hr").agg(
        F.sum("observed").alias("n_observed"), F.count(F.lit(1)).alias("n"))


@query("forward_fill", """
    SELECT stay_id, feature, hr, round(value, 6) AS value FROM fx_filled
    WHERE feature NOT IN ('error', 'signup')""")
def forward_fill(spark, sf):
    return (fx.grid(spark, sf).where(~F.col("feature").isin(*fx.SWITCHES))
            .select("stay_id", "feature", "hr", r6("value").alias("value")))


@query("intervention_fill", """
    SELECT stay_id, feature, hr, round(value, 6) AS value, observed FROM fx_filled
    WHERE feature IN ('error', 'signup')""")
def intervention_fill(spark, sf):
    return (fx.grid(spark, sf).where(F.col("feature").isin(*fx.SWITCHES))
            .select("stay_id", "feature", "hr", r6("value").alias("value"), "observed"))


_SINCE = """least(hr - coalesce(last_value(CASE WHEN observed = 1 THEN hr END IGNORE NULLS) OVER (
        PARTITION BY stay_id, feature ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4)
        / 4.0"""


@query("time_since_measure", f"""
    SELECT stay_id, feature, hr, CAST({_SINCE} AS DOUBLE) AS since FROM fx_filled""")
def time_since_measure(spark, sf):
    return fx.grid(spark, sf).select("stay_id", "feature", "hr", "since")


@query("timeseries_grid", f"""
    SELECT stay_id, feature, hr, round(value, 6) AS value, observed, CAST({_SINCE} AS DOUBLE) AS since
    FROM fx_filled""")
def timeseries_grid(spark, sf):
    return fx.grid(spark, sf).select("stay_id", "feature", "hr", r6("value").alias("value"),
                                     "observed", "since")


@query("pack_series", """
    SELECT stay_id, feature, count(*) AS n_slots, count(*) - count(value) AS n_null,
           round(sum(coalesce(value, 0.0) * (hr + 1)), 4) AS weighted
    FROM fx_filled GROUP BY ALL""")
def pack_series(spark, sf):
    packed = series.pack_series(fx.grid(spark, sf))
    return packed.select(
        "stay_id", "feature", F.size("series").cast("long").alias("n_slots"),
        F.size(F.filter("series", lambda v: v.isNull())).cast("long").alias("n_null"),
        F.round(F.aggregate(
            F.transform("series", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)),
            F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


@query("series_roundtrip", "SELECT stay_id, feature, hr, round(value, 6) AS value FROM fx_filled")
def series_roundtrip(spark, sf):
    return (series.unpack_series(series.pack_series(fx.grid(spark, sf)))
            .withColumn("value", r6("value")))


@query("trajectory", """
    SELECT stay_id, feature, string_agg(CASE WHEN value IS NULL THEN '-' ELSE printf('%.1f', round(round(value, 6), 1)) END,
           ' ' ORDER BY hr) AS points,
           CASE WHEN feature IN ('error', 'signup') THEN CAST(max(round(round(value, 6), 1)) > 0 AS INTEGER) END AS ever_on
    FROM fx_filled GROUP BY stay_id, feature""")
def trajectory(spark, sf):
    t = series.trajectories(fx.grid(spark, sf), fx.SWITCHES)
    text = F.array_join(F.transform("series", lambda v: F.when(v.isNull(), "-").otherwise(
        F.format_string("%.1f", v))), " ")
    return t.select("stay_id", "feature", text.alias("points"), "ever_on")


@query("whatif_override", """
    SELECT stay_id, feature, hr,
           round(CASE WHEN feature = 'click' AND hr = stay_id % 4 THEN stay_id % 50 ELSE value END, 6) AS value,
           CAST(feature = 'click' AND hr = stay_id % 4 AS INTEGER) AS edited FROM fx_filled""")
def whatif_override(spark, sf):
    k = F.col("stay_id")
    edits = fx.sessions(spark, sf).select(
        "stay_id", F.lit("click").alias("feature"), (k % 4).cast("int").alias("hr"),
        (k % 50).cast("double").alias("value"))
    return (series.override(fx.grid(spark, sf), edits)
            .select("stay_id", "feature", "hr", r6("value").alias("value"), "edited"))


_SCENARIO = """
    sc AS (SELECT c_custkey, pattern, hr, CASE pattern
        WHEN 'stable_normal' THEN 82.0 WHEN 'stable_high' THEN 130.0
        WHEN 'crashing' THEN CASE WHEN hr < 18 THEN 82.0 ELSE 77.0 + (25.0 - 77.0) * (hr - 18) / 5.0 END
        ELSE CASE WHEN hr < 21 THEN 82.0 ELSE 72.0 + (25.0 - 72.0) * (hr - 21) / 2.0 END END::DOUBLE AS value
        FROM customer,
             (SELECT unnest(['stable_normal', 'stable_high', 'crashing', 'crashing_late']) AS pattern),
             (SELECT CAST(unnest(range(24)) AS INTEGER) AS hr))"""


@query("scenario_grid", f"WITH {_SCENARIO} SELECT c_custkey, pattern, hr, round(value, 6) AS value FROM sc")
def scenario_grid(spark, sf):
    return (series.scenario_grid(fx.table(spark, sf, "customer").select("c_custkey"))
            .withColumn("value", r6("value")))


@query("scenario_sensitivity", f"""
    WITH {_SCENARIO},
    z AS (SELECT c.c_custkey, pattern, c_acctbal / 10000.0 + sum((value - 82.0) * (hr + 1)) / 4000.0 AS z
          FROM sc JOIN customer c ON c.c_custkey = sc.c_custkey GROUP BY c.c_custkey, pattern, c_acctbal),
    m AS (SELECT pattern, avg(1.0 / (1.0 + exp(-z))) AS risk FROM z GROUP BY 1)
    SELECT pattern, round(risk, 6) AS mean_score,
           round(risk - (SELECT risk FROM m WHERE pattern = 'stable_normal'), 6) AS delta FROM m""")
def scenario_sensitivity(spark, sf):
    base = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    g = series.scenario_grid(base)
    z = g.groupBy("c_custkey", "pattern", "c_acctbal").agg(
        F.sum((F.col("value") - 82.0) * (F.col("hr") + 1)).alias("s"))
    risk = S.sigmoid(F.col("c_acctbal") / 10000.0 + F.col("s") / 4000.0)
    m = z.groupBy("pattern").agg(F.avg(risk).alias("risk"))
    ref = m.where(F.col("pattern") == "stable_normal").select("risk").scalar()
    return m.select("pattern", r6("risk").alias("mean_score"), r6(F.col("risk") - ref).alias("delta"))


# --- features -----------------------------------------------------------------------------

@query("window_aggregates", """
    SELECT stay_id, feature, min(value) AS v_min, max(value) AS v_max, round(avg(value), 6) AS v_mean,
           count(*) AS v_count FROM fx_events GROUP BY ALL""")
def window_aggregates(spark, sf):
    return features.window_aggregates(fx.long_events(spark, sf)).withColumn("v_mean", r6("v_mean"))


def _wide_sql(prefix=""):
    out = []
    for f in fx.FEATURES:
        v = f"CASE WHEN feature = '{f}' THEN value END"
        out += [f"min({v}) AS {f}_v_min", f"max({v}) AS {f}_v_max", f"round(avg({v}), 6) AS {f}_v_mean",
                f"nullif(count({v}), 0) AS {f}_v_count"]
    return ", ".join(out)


def _rounded_means(df):
    return df.select(*[r6(c).alias(c) if c.endswith("_v_mean") else F.col(c) for c in df.columns])


@query("wide_features", f"SELECT stay_id, {_wide_sql()} FROM fx_events GROUP BY stay_id")
def wide_features(spark, sf):
    return _rounded_means(features.wide_features(fx.long_events(spark, sf), fx.FEATURES))


@query("static_features", """
    SELECT stay_id, CAST(age AS DOUBLE) AS age, CAST(coalesce(gender = 'M', false) AS DOUBLE) AS gender_m,
           CAST(contains(coalesce(admission_type, ''), 'URGENT') AS DOUBLE) AS admission_emergency, worst
    FROM fx_cohort LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS worst FROM lineitem GROUP BY 1)
      ON l_orderkey = stay_id""")
def static_features(spark, sf):
    worst = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stay_id")).agg(
        F.min("l_quantity").alias("worst"))
    return features.static_features(fx.visit_cohort(spark, sf), worst, "URGENT")


_VISIT_EVENTS = """ve AS (SELECT l_orderkey AS stay_id, l_returnflag AS feature, l_quantity AS value FROM lineitem)"""


def _cond_flag(c, where="d"):
    return f"coalesce(max(CASE WHEN {where}.condition = '{c}' THEN 1 END), 0)"


def _dx_hits():
    return """dxr AS (SELECT d.hadm_id, d.icd_code, r.condition FROM fx_dx d LEFT JOIN fx_rules r
                ON d.icd_version = r.version AND starts_with(d.icd_code, r.prefix))"""


_PRIOR = f"""
    {_dx_hits()},
    pr AS (SELECT c.stay_id, {_cond_flag('a')} AS a, {_cond_flag('b')} AS b, {_cond_flag('c')} AS c
           FROM fx_cohort c LEFT JOIN (
             SELECT x.*, adm.subject_id, adm.dischtime FROM dxr x JOIN fx_adm adm ON x.hadm_id = adm.hadm_id) d
             ON d.subject_id = c.subject_id AND d.dischtime < c.intime AND d.hadm_id <> c.hadm_id
           GROUP BY c.stay_id),
    prn AS (SELECT c.stay_id, count(d.icd_code) AS n
            FROM fx_cohort c LEFT JOIN (
              SELECT x.*, adm.subject_id, adm.dischtime FROM fx_dx x JOIN fx_adm adm ON x.hadm_id = adm.hadm_id) d
              ON d.subject_id = c.subject_id AND d.dischtime < c.intime AND d.hadm_id <> c.hadm_id
            GROUP BY c.stay_id)"""
_CURRENT = f"""
    cu AS (SELECT c.stay_id, {_cond_flag('a')} AS a, {_cond_flag('b')} AS b, {_cond_flag('c')} AS c
           FROM fx_cohort c LEFT JOIN dxr d ON d.hadm_id = c.hadm_id GROUP BY c.stay_id),
    cun AS (SELECT c.stay_id, count(d.icd_code) AS n FROM fx_cohort c
            LEFT JOIN fx_dx d ON d.hadm_id = c.hadm_id GROUP BY c.stay_id)"""


def _cci_cols(alias, tag):
    end = f"_{tag}" if tag else ""
    mid = f"{tag}_" if tag else ""
    name = f"charlson{end}" if tag else "charlson_score"
    flags = ", ".join(f"CAST({alias}.{c} AS DOUBLE) AS cci_{mid}{c}" for c in "abc")
    return (f"{flags}, CAST({alias}.a + 2 * {alias}.b + 3 * {alias}.c AS DOUBLE) AS {name}, "
            f"CAST({alias}n.n AS DOUBLE) AS n_diagnoses{end}")


@query("comorbidity_index", f"""
    WITH {_PRIOR} SELECT pr.stay_id, {_cci_cols('pr', '')}
    FROM pr JOIN prn ON pr.stay_id = prn.stay_id""")
def comorbidity_index(spark, sf):
    return features.prior_comorbidities(fx.diagnoses(spark, sf), fx.admissions(spark, sf),
                                        fx.stored_cohort(spark, sf), fx.CODE_RULES)


@query("comorbidity_current", f"""
    WITH {_dx_hits()}, {_CURRENT} SELECT cu.stay_id, {_cci_cols('cu', '')}
    FROM cu JOIN cun ON cu.stay_id = cun.stay_id""")
def comorbidity_current(spark, sf):
    return features.current_comorbidities(fx.diagnoses(spark, sf), fx.stored_cohort(spark, sf), fx.CODE_RULES)


@query("comorbidity_both", f"""
    WITH {_PRIOR}, {_CURRENT} SELECT pr.stay_id, {_cci_cols('pr', 'prior')}, {_cci_cols('cu', 'curr')}
    FROM pr JOIN prn ON pr.stay_id = prn.stay_id JOIN cu ON cu.stay_id = pr.stay_id
    JOIN cun ON cun.stay_id = pr.stay_id""")
def comorbidity_both(spark, sf):
    return features.both_comorbidities(fx.diagnoses(spark, sf), fx.admissions(spark, sf),
                                       fx.stored_cohort(spark, sf), fx.CODE_RULES)


@query("feature_table", f"""
    WITH {_dx_hits()}, {_CURRENT}, {_VISIT_EVENTS},
    w AS (SELECT stay_id, {", ".join(
        f"min(CASE WHEN feature = '{f}' THEN value END) AS {f}_v_min, "
        f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}_v_max, "
        f"round(avg(CASE WHEN feature = '{f}' THEN value END), 6) AS {f}_v_mean, "
        f"nullif(count(CASE WHEN feature = '{f}' THEN value END), 0) AS {f}_v_count" for f in "ANR")}
        FROM ve GROUP BY stay_id)
    SELECT c.stay_id, c.subject_id, c.label, CAST(c.age AS DOUBLE) AS age,
           CAST(coalesce(c.gender = 'M', false) AS DOUBLE) AS gender_m,
           CAST(contains(coalesce(c.admission_type, ''), 'URGENT') AS DOUBLE) AS admission_emergency,
           w.* EXCLUDE (stay_id), {_cci_cols('cu', '')}
    FROM fx_cohort c LEFT JOIN w ON w.stay_id = c.stay_id
    JOIN cu ON cu.stay_id = c.stay_id JOIN cun ON cun.stay_id = c.stay_id""")
def feature_table(spark, sf):
    c = fx.stored_cohort(spark, sf)
    ev = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), F.col("l_returnflag").alias("feature"),
        F.col("l_quantity").alias("value"))
    com = features.current_comorbidities(fx.diagnoses(spark, sf), c, fx.CODE_RULES)
    return _rounded_means(features.feature_table(c, ev, ("A", "N", "R"), com, emergency="URGENT"))


@query("leakage_guard_columns", f"""
    WITH {_PRIOR} SELECT pr.stay_id, {_cci_cols('pr', 'prior')}
    FROM pr JOIN prn ON pr.stay_id = prn.stay_id""")
def leakage_guard_columns(spark, sf):
    return features.guard_leaky(comorbidity_both(spark, sf))


# --- sources ------------------------------------------------------------------------------

def _two_sources(spark, sf):
    a = fx.visit_cohort(spark, sf).select("stay_id", "subject_id", "unit", "year_group", "age",
                                          "gender", "label")
    b = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("stay_id"), (F.col("s_suppkey") % 40).alias("subject_id"),
        F.concat(F.lit("Site_"), F.col("s_nationkey").cast("string")).alias("unit"),
        S.sex_code(F.when(F.col("s_suppkey") % 2 == 0, "Male").otherwise("Female")).alias("gender"),
        (F.col("s_acctbal") < 0).cast("int").alias("label"), F.col("s_acctbal").alias("score"))
    return features.union_sources(
        features.tag_source(a, "main"),
        features.tag_source(b, "second", 900_000_000, {"year_group": "second_period"}))


_UNION = """
    un AS (SELECT stay_id, 'main_' || subject_id AS subject_id, unit, year_group, age, gender, label,
                  'main' AS dataset, NULL::DOUBLE AS score FROM fx_cohort
           UNION ALL SELECT s_suppkey + 900000000, 'second_' || s_suppkey % 40, 'Site_' || s_nationkey,
                  'second_period', NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'F' END,
                  CAST(s_acctbal < 0 AS INTEGER), 'second', s_acctbal FROM supplier)"""


@query("union_sources", f"WITH {_UNION} SELECT * FROM un")
def union_sources(spark, sf):
    return _two_sources(spark, sf)


@query("union_client_summary", f"""
    WITH {_UNION} SELECT dataset, unit, count(*) AS n, round(avg(label), 6) AS rate
    FROM un GROUP BY ALL ORDER BY n DESC, dataset, unit LIMIT 20""")
def union_client_summary(spark, sf):
    from sitewise.operators.clients import source_summary
    return source_summary(_two_sources(spark, sf)).withColumn("rate", r6("rate"))


@query("feature_axis_diff", """
    SELECT feature, side FROM (
        SELECT DISTINCT event_type AS feature, 'left_only' AS side FROM events
        WHERE event_type NOT IN (SELECT p_type FROM part)
        UNION ALL SELECT DISTINCT p_type, 'right_only' FROM part
        WHERE p_type NOT IN (SELECT event_type FROM events))""")
def feature_axis_diff(spark, sf):
    return features.feature_axis_diff(
        fx.table(spark, sf, "events").select(F.col("event_type").alias("feature")),
        fx.table(spark, sf, "part").select(F.col("p_type").alias("feature")))


# --- text and scalars ---------------------------------------------------------------------

@query("string_flags", """
    SELECT doc_id, lang || '_' || source AS client_key, CAST(lower(text) LIKE '%the%' AS INTEGER) AS has_the,
           CAST(regexp_matches(lower(text), 'tion|ment|heit') AS INTEGER) AS suffix,
           CAST(contains(text, '%') AS INTEGER) AS has_percent,
           upper(trim(lang)) AS lang_code, CAST(starts_with(source, 'w') AS INTEGER) AS src_w,
           length(replace(text, ' ', '')) AS solid_chars, substring(lang, 1, 1) AS lang_head
    FROM documents""")
def string_flags(spark, sf):
    t = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.concat("lang", F.lit("_"), "source").alias("client_key"),
        F.lower(t).like("%the%").cast("int").alias("has_the"),
        F.lower(t).rlike("tion|ment|heit").cast("int").alias("suffix"),
        t.contains("%").cast("int").alias("has_percent"),
        F.upper(F.trim("lang")).alias("lang_code"), F.col("source").startswith("w").cast("int").alias("src_w"),
        F.length(F.replace(t, F.lit(" "), F.lit(""))).cast("long").alias("solid_chars"),
        F.substring("lang", 1, 1).alias("lang_head"))


@query("logit_sigmoid", """
    SELECT id, round(ln(least(greatest(p1, 1e-9), 1 - 1e-9) / (1 - least(greatest(p1, 1e-9), 1 - 1e-9))), 6) AS z,
           round(1.0 / (1.0 + exp(-(p1 * 4 - 2))), 6) AS s, round(2 * asin(sqrt(p2)), 6) AS arc,
           CAST(round_even(p2 * 1000 / 2, 0) AS BIGINT) AS halves FROM fx_pred""")
def logit_sigmoid(spark, sf):
    return fx.predictions(spark, sf).select(
        "id", r6(S.logit("p1")).alias("z"), r6(S.sigmoid(F.col("p1") * 4 - 2)).alias("s"),
        r6(2 * F.asin(F.sqrt("p2"))).alias("arc"), S.half_even(F.col("p2") * 1000 / 2).alias("halves"))


@query("ci_text_roundtrip", """
    SELECT l_returnflag, l_linestatus, printf('%.3f (%.3f-%.3f)', v, lo, hi) AS txt,
           round(v, 3) AS v, round(lo, 3) AS lo, round(hi, 3) AS hi
    FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v,
                 avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS lo,
                 avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS hi
          FROM lineitem GROUP BY ALL)""")
def ci_text_roundtrip(spark, sf):
    half = F.col("sd") * 1.96 / F.sqrt("n")
    g = fx.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"), F.count(F.lit(1)).alias("n"))
    t = g.select("l_returnflag", "l_linestatus",
                 S.ci_text(F.col("m"), F.col("m") - half, F.col("m") + half).alias("txt"))
    v, lo, hi = S.ci_parse("txt")
    return t.select("*", v.alias("v"), lo.alias("lo"), hi.alias("hi"))

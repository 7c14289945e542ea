"""Queries on the one-call jobs, end to end: events, 24-step series, feature tables, two sources as one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.scalars import plus_hours
from sitewise.plans import clinical as C
from sitewise.plans import fixtures as fx
from sitewise.plans import jobs
from sitewise.plans.catalog_cohort import r6
from sitewise.plans.registry import query

# item ids of the example source tables: every line of an order is a measurement, result or treatment of its stay
_CHART = [i for _, i in C.codes(C.CHART)] + [1]                     # 1: an id without a feature
_LAB = [i for _, i in C.codes(C.LAB)] + [2]
_URINE = [*C.URINE, 3]
_ON = [*C.VASOPRESSOR, *C.VENTILATION, 4]
_RULES = C.diagnosis_rules()
_CODES = [(p + "0", v) for _, _, v, p in _RULES][::3] + [("ZZZ", 9), ("410", 10)]


def _nth(items, n: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in items]), (n % len(items)).cast("int"))


def _nth_sql(items, n: str) -> str:
    return f"([{', '.join(repr(i) for i in items)}])[1 + {n} % {len(items)}]"


def _lines(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("stay_id"), (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("hadm_id"), "l_partkey",
        plus_hours("o_orderdate", (F.col("l_linenumber") * 5 + F.col("l_suppkey") % 7 - 6).cast("int")).alias("charttime"),
        (F.col("l_quantity") * 4 + F.col("l_partkey") % 50).alias("v"), F.col("l_extendedprice").alias("price"), "l_returnflag")


_LINES = """
    ln AS (SELECT l_orderkey AS stay_id, o_custkey * 10000 + year(o_orderdate) AS hadm_id, l_partkey,
                  o_orderdate + to_hours(CAST(l_linenumber * 5 + l_suppkey % 7 - 6 AS INTEGER)) AS charttime,
                  l_quantity * 4 + l_partkey % 50 AS v, l_extendedprice AS price, l_returnflag
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _tables(ln):
    k = F.col("l_partkey")
    return {
        "chartevents": ln.select("stay_id", "charttime", _nth(_CHART, k).alias("itemid"), F.col("v").alias("valuenum")),
        "labevents": ln.where("l_returnflag = 'N'").select("hadm_id", "charttime", _nth(_LAB, k).alias("itemid"), (F.col("price") / 1000).alias("valuenum")),
        "outputevents": ln.where("l_returnflag = 'R'").select("stay_id", "charttime", _nth(_URINE, k).alias("itemid"), (F.col("v") * 30).alias("value")),
        "inputevents": ln.where("l_returnflag = 'A'").select("stay_id", F.col("charttime").alias("starttime"), _nth(_ON, k).alias("itemid")),
        "procedureevents": None}


def _named(table, src: str, value: str, on: str) -> str:
    """Rows of named features in range, inside the window of the stays that share ``on``."""
    rows = ", ".join(f"({i}, '{f}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)" for f, ids, lo, hi in table for i in ids)
    return f"""SELECT c.stay_id, m.feature, e.{value}::DOUBLE AS value, date_diff('minute', c.intime, e.charttime) / 60.0 AS hours_in
        FROM {src} e JOIN (VALUES {rows}) m(itemid, feature, lo, hi) ON m.itemid = e.itemid AND e.{value} BETWEEN m.lo AND m.hi
        JOIN fx_cohort c ON c.{on} = e.{on} WHERE e.charttime >= c.intime AND e.charttime < c.intime + INTERVAL 24 HOUR"""


_EXTRACTED = f"""
    {_LINES},
    ce AS (SELECT stay_id, charttime, {_nth_sql(_CHART, 'l_partkey')} AS itemid, v AS valuenum FROM ln),
    le AS (SELECT hadm_id, charttime, {_nth_sql(_LAB, 'l_partkey')} AS itemid, price / 1000 AS valuenum FROM ln WHERE l_returnflag = 'N'),
    oe AS (SELECT stay_id, charttime, {_nth_sql(_URINE, 'l_partkey')} AS itemid, v * 30 AS value FROM ln WHERE l_returnflag = 'R'),
    ie AS (SELECT stay_id, charttime, {_nth_sql(_ON, 'l_partkey')} AS itemid FROM ln WHERE l_returnflag = 'A'),
    ex AS (
        SELECT stay_id, CASE feature WHEN 'temp_f' THEN 'temp_c' ELSE feature END AS feature,
               CASE feature WHEN 'temp_f' THEN (value - 32.0) * 5.0 / 9.0 ELSE value END AS value, hours_in
        FROM ({_named(C.CHART, 'ce', 'valuenum', 'stay_id')})
        UNION ALL {_named(C.LAB, 'le', 'valuenum', 'hadm_id')}
        UNION ALL {_named((("urine", C.URINE, *C.URINE_RANGE),), 'oe', 'value', 'stay_id')}
        UNION ALL SELECT c.stay_id, 'vasopressor', 1.0, date_diff('minute', c.intime, e.charttime) / 60.0
        FROM ie e JOIN fx_cohort c ON c.stay_id = e.stay_id
        WHERE e.itemid IN {C.VASOPRESSOR} AND e.charttime >= c.intime AND e.charttime < c.intime + INTERVAL 24 HOUR)"""


def _extracted(lines, cohort):
    return jobs.extract_events(_tables(lines), cohort)


@query("job_extract_events", f"""WITH {_EXTRACTED}
    SELECT stay_id, feature, round(value, 6) AS value, round(hours_in, 6) AS hours_in FROM ex""")
def job_extract_events(spark, sf):
    return _extracted(_lines(spark, sf), fx.stored_cohort(spark, sf)).select("stay_id", "feature", r6("value").alias("value"), r6("hours_in").alias("hours_in"))


_GRID_24 = """
    bn AS (SELECT stay_id, feature, CAST(floor(hours_in) AS INTEGER) AS hr,
                  CASE WHEN feature IN ({sums}) THEN sum(value) WHEN feature IN ({switches}) THEN max(value) ELSE avg(value) END AS raw
           FROM {events} WHERE hours_in >= 0 AND hours_in < 24 GROUP BY stay_id, feature, floor(hours_in)),
    gr AS (SELECT s.stay_id, f.feature, h.hr, b.raw, CAST(b.raw IS NOT NULL OR f.feature IN ({switches}) AS INTEGER) AS observed
           FROM {stays} s CROSS JOIN (SELECT unnest([{features}]) AS feature) f CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hr) h
           LEFT JOIN bn b ON b.stay_id = s.stay_id AND b.feature = f.feature AND b.hr = h.hr),
    fl AS (SELECT stay_id, feature, hr, raw, observed,
                  CASE WHEN feature IN ({switches}) THEN max(coalesce(raw, 0.0)) OVER w ELSE last_value(raw IGNORE NULLS) OVER w END AS value,
                  least(hr - coalesce(last_value(CASE WHEN observed = 1 THEN hr END IGNORE NULLS) OVER (
                      PARTITION BY stay_id, feature ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 24) / 24.0 AS since
           FROM gr WINDOW w AS (PARTITION BY stay_id, feature ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _grid_sql(events: str, stays: str, names, sums, switches) -> str:
    return _GRID_24.format(events=events, stays=stays, features=_quoted(names), sums=_quoted(sums), switches=_quoted(switches))


@query("job_hourly_grid", f"""WITH {_grid_sql('fx_events', 'fx_sess', fx.FEATURES, fx.SUMS, fx.SWITCHES)}
    SELECT stay_id, feature, hr, round(raw, 6) AS raw, round(value, 6) AS value, observed, round(since, 6)::DOUBLE AS since FROM fl""")
def job_hourly_grid(spark, sf):
    g = jobs.build_timeseries(fx.long_events(spark, sf), fx.sessions(spark, sf), fx.FEATURES, 24, fx.SUMS, fx.SWITCHES)
    return g.select("stay_id", "feature", "hr", r6("raw").alias("raw"), r6("value").alias("value"), "observed", r6("since").alias("since"))


_TOTAL = """SELECT feature, hr, count(*) AS n, CAST(sum(observed) AS BIGINT) AS n_observed, count(value) AS n_values,
    round(sum(value), 3) AS total, round(sum(since), 4)::DOUBLE AS since FROM {src} GROUP BY feature, hr"""


def _totals(grid):
    return grid.groupBy("feature", "hr").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observed").alias("n_observed"), F.count("value").alias("n_values"),
        F.round(F.sum("value"), 3).alias("total"), F.round(F.sum("since"), 4).alias("since"))


@query("job_clinical_grid", f"""WITH {_EXTRACTED}, {_grid_sql('ex', 'fx_cohort', C.SERIES, C.SUMMED, C.SWITCHES)} {_TOTAL.format(src='fl')}""")
def job_clinical_grid(spark, sf):
    """Source tables to the regular series of all features, 24 steps, summed by feature and step."""
    cohort = fx.stored_cohort(spark, sf)
    return _totals(jobs.build_timeseries(_extracted(_lines(spark, sf), cohort), cohort))


def _coded_diagnoses(ln):
    return ln.select("hadm_id", _nth([c for c, _ in _CODES], F.col("l_partkey")).alias("icd_code"), _nth([v for _, v in _CODES], F.col("l_partkey")).alias("icd_version"))


def _flags_sql(prefix: str, src: str) -> str:
    names = list(dict.fromkeys(c for c, *_ in _RULES))
    return ", ".join(f"coalesce(max({src}.{n}), 0) AS {prefix}{n}" for n in names)


def _history_sql() -> str:
    names = list(dict.fromkeys(c for c, *_ in _RULES))
    weight = {c: w for c, w, _, _ in _RULES}
    rules = ", ".join(f"('{c}', {v}, '{p}')" for c, _, v, p in _RULES)
    score = {t: " + ".join(f"{weight[n]} * {t}{n}" for n in names) for t in ("p_", "c_")}
    columns = ", ".join(f"CAST({t}{n} AS DOUBLE) AS cci_{tag}_{n}" for t, tag in (("p_", "prior"), ("c_", "curr")) for n in names)
    return f"""
    dx AS (SELECT hadm_id, {_nth_sql([c for c, _ in _CODES], 'l_partkey')} AS icd_code, {_nth_sql([v for _, v in _CODES], 'l_partkey')} AS icd_version FROM ln),
    ru AS (SELECT * FROM (VALUES {rules}) t(condition, version, prefix)),
    kinds AS (SELECT DISTINCT icd_code, icd_version FROM dx),
    meant AS (SELECT k.icd_code, k.icd_version, {", ".join(f"max((r.condition = '{n}')::INT) AS {n}" for n in names)}
              FROM kinds k JOIN ru r ON r.version = k.icd_version AND starts_with(k.icd_code, r.prefix) GROUP BY ALL),
    ad AS (SELECT dx.hadm_id, count(*) AS n, {_flags_sql('', 'm')} FROM dx LEFT JOIN meant m USING (icd_code, icd_version) GROUP BY dx.hadm_id),
    pr AS (SELECT c.stay_id, coalesce(sum(a.n), 0) AS p_n, {_flags_sql('p_', 'a')} FROM fx_cohort c
           LEFT JOIN (SELECT ad.*, m.subject_id, m.dischtime FROM ad JOIN fx_adm m USING (hadm_id)) a
             ON a.subject_id = c.subject_id AND a.dischtime < c.intime AND a.hadm_id <> c.hadm_id GROUP BY c.stay_id),
    cu AS (SELECT c.stay_id, coalesce(sum(a.n), 0) AS c_n, {_flags_sql('c_', 'a')} FROM fx_cohort c LEFT JOIN ad a USING (hadm_id) GROUP BY c.stay_id),
    hs AS (SELECT stay_id, {columns}, CAST({score['p_']} AS DOUBLE) AS charlson_prior, CAST({score['c_']} AS DOUBLE) AS charlson_curr,
                  CAST(p_n AS DOUBLE) AS n_diagnoses_prior, CAST(c_n AS DOUBLE) AS n_diagnoses_curr FROM pr JOIN cu USING (stay_id))"""


_SHOWN = ("heart_rate", "temp_c", "creatinine", "urine")


@query("job_features", f"""WITH {_EXTRACTED}, {_history_sql()},
    w AS (SELECT stay_id, {", ".join(
        f"min(value) FILTER (feature = '{f}') AS {f}_v_min, max(value) FILTER (feature = '{f}') AS {f}_v_max, "
        f"avg(value) FILTER (feature = '{f}') AS {f}_v_mean, nullif(count(value) FILTER (feature = '{f}'), 0) AS {f}_v_count" for f in _SHOWN)}
        FROM ex GROUP BY stay_id)
    SELECT c.stay_id, c.subject_id, c.label, CAST(c.age AS DOUBLE) AS age, CAST(coalesce(c.gender = 'M', false) AS DOUBLE) AS gender_m,
           CAST(contains(coalesce(c.admission_type, ''), 'EMER') AS DOUBLE) AS admission_emergency, w.* EXCLUDE (stay_id)
               REPLACE ({", ".join(f"round({f}_v_{s}, 6) AS {f}_v_{s}" for f in _SHOWN for s in ("min", "max", "mean"))}),
           hs.* EXCLUDE (stay_id)
    FROM fx_cohort c LEFT JOIN w ON w.stay_id = c.stay_id JOIN hs ON hs.stay_id = c.stay_id""")
def job_features(spark, sf):
    """Source tables to the wide feature table with the code history before and of the stay."""
    cohort, lines = fx.stored_cohort(spark, sf), _lines(spark, sf)
    t = jobs.build_features(_extracted(lines, cohort), cohort, _coded_diagnoses(lines), fx.admissions(spark, sf), "both", _SHOWN)
    return t.select(*[r6(c).alias(c) if c.endswith(("_v_min", "_v_max", "_v_mean")) else c for c in t.columns])


@query("job_combine", """
    SELECT stay_id, 'main_' || subject_id AS subject_id, unit, year_group, age, gender, label, 'main' AS dataset, NULL::DOUBLE AS score FROM fx_cohort
    UNION ALL SELECT s_suppkey + 900000000, 'other_' || s_suppkey % 40, 'Site_' || s_nationkey, 'second_period', NULL,
        CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'F' END, CAST(s_acctbal < 0 AS INTEGER), 'other', s_acctbal FROM supplier""")
def job_combine(spark, sf):
    first = fx.visit_cohort(spark, sf).select("stay_id", "subject_id", "unit", "year_group", "age", "gender", "label")
    second = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("stay_id"), (F.col("s_suppkey") % 40).alias("subject_id"), F.concat(F.lit("Site_"), F.col("s_nationkey").cast("string")).alias("unit"),
        F.when(F.col("s_suppkey") % 2 == 0, "M").otherwise("F").alias("gender"), (F.col("s_acctbal") < 0).cast("int").alias("label"), F.col("s_acctbal").alias("score"))
    return jobs.combine(first, second, ("main", "other"))


@query("job_combine_grids", """
    SELECT stay_id, feature, hr, round(value, 6) AS value, observed FROM fx_filled WHERE stay_id % 2 = 0
    UNION ALL SELECT stay_id + 900000000, feature, hr, round(value, 6), observed FROM fx_filled WHERE stay_id % 2 = 1""")
def job_combine_grids(spark, sf):
    both = jobs.combine_grids(fx.grid(spark, sf).where(F.col("stay_id") % 2 == 0), fx.grid(spark, sf).where(F.col("stay_id") % 2 == 1))
    return both.select("stay_id", "feature", "hr", r6("value").alias("value"), "observed")

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise import session
from sitewise.operators import cohort, features, series
from sitewise.plans import catalog, clinical, fixtures, jobs

TS = "cast('2020-01-01 {}' as timestamp_ntz)"


@pytest.fixture(scope="module")
def hospital(spark):
    """Three patients: a normal stay with a second one, an early death, a child."""
    stays = spark.sql("""
        select * from values (1, 10, 100, 'A', timestamp_ntz'2020-01-01 00:00:59', 2.0D),
                             (1, 10, 101, 'A', timestamp_ntz'2020-01-03 00:00:00', 3.0D),
                             (2, 20, 200, 'B', timestamp_ntz'2020-01-01 00:00:00', 1.5D),
                             (3, 30, 300, 'B', timestamp_ntz'2020-01-01 00:00:00', 5.0D),
                             (1, 11, 110, 'A', timestamp_ntz'2020-06-01 00:00:00', 1.0D)
        as t(subject_id, hadm_id, stay_id, unit, intime, los)""")
    adm = spark.sql("""
        select * from values (1, 10, 'EW EMER.', cast(null as timestamp_ntz), 0, timestamp_ntz'2020-01-06 00:00:00'),
                             (2, 20, null, timestamp_ntz'2020-01-02 00:00:00', 1, timestamp_ntz'2020-01-02 00:00:00'),
                             (3, 30, 'ELECTIVE', null, 0, timestamp_ntz'2020-01-06 00:00:00'),
                             (1, 11, 'ELECTIVE', timestamp_ntz'2020-06-02 00:00:01', 1, timestamp_ntz'2020-06-02 00:00:01')
        as t(subject_id, hadm_id, admission_type, deathtime, label, dischtime)""")
    pats = spark.sql("""
        select * from values (1, 'M', 60, 2019, 'y'), (2, 'F', 70, 2020, 'y'), (3, 'M', 17, 2020, 'z')
        as t(subject_id, gender, anchor_age, anchor_year, year_group)""")
    return stays, adm, pats


def test_cohort_rules(hospital):
    c = {r["stay_id"]: r for r in cohort.build_cohort(*hospital).collect()}
    assert set(c) == {100, 110}                       # first stay, adult, not dead within 24 h
    assert c[100]["age"] == 61 and c[100]["los_hours"] == 48.0
    kept = {r["stay_id"] for r in cohort.build_cohort(*hospital, drop_early=False, first_only=False).collect()}
    assert kept == {100, 101, 110, 200}               # death exactly at 24 h counts as early
    assert {r["stay_id"] for r in cohort.build_cohort(*hospital, max_subject=0).collect()} == set()


def test_flow_adds_up(hospital):
    rows = cohort.exclusion_flow(*hospital, max_subject=2).orderBy("step_no").collect()
    assert [r["n_stays"] for r in rows] == [5, 4, 3, 3, 2]
    assert [r["excluded"] for r in rows] == [None, 1, 1, 0, 1]


def test_static_flags(hospital):
    c = cohort.build_cohort(*hospital, drop_early=False)
    got = {r["stay_id"]: (r["gender_m"], r["admission_emergency"]) for r in features.static_features(c).collect()}
    assert got == {100: (1.0, 1.0), 110: (1.0, 0.0), 200: (0.0, 0.0)}


def hourly(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, feature string, hr int, value double")


def values(df, stay, feature, col="value"):
    rows = df.where((F.col("stay_id") == stay) & (F.col("feature") == feature)).orderBy("hr").collect()
    return [r[col] for r in rows]


def test_grid_fill_rules(spark):
    h = hourly(spark, [(1, "m", 1, 5.0), (1, "m", 3, 7.0), (1, "s", 2, 1.0), (1, "odd", 0, 9.0), (9, "m", 0, 1.0)])
    stays = spark.createDataFrame([(1,), (2,)], "stay_id long")
    g = series.fill_grid(series.dense_grid(h, stays, ["m", "s"], 5, ["s"]), ["s"], steps=5).persist()
    assert g.count() == 2 * 2 * 5 and not g.where("feature = 'odd' or stay_id = 9").count()
    assert values(g, 1, "m") == [None, 5.0, 5.0, 7.0, 7.0]          # leading gap stays, inner gap fills
    assert values(g, 1, "m", "observed") == [0, 1, 0, 1, 0]
    assert values(g, 1, "m", "since") == [0.0, 0.2, 0.2, 0.4, 0.2]
    assert values(g, 2, "m") == [None] * 5 and values(g, 2, "m", "since") == [0.0, 0.2, 0.4, 0.6, 0.8]
    assert values(g, 1, "s") == [0.0, 0.0, 1.0, 1.0, 1.0] and values(g, 2, "s") == [0.0] * 5
    assert values(g, 1, "s", "observed") == [1] * 5
    back = series.unpack_series(series.pack_series(g))
    assert back.exceptAll(g.select("stay_id", "feature", "hr", "value")).count() == 0


def test_packed_grid_equals_window_fill(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"stay_id": rng.integers(0, 40, n), "feature": rng.choice(["m", "s", "u", "x", "odd"], n), "value": rng.normal(0, 2, n).round(2),
                        "hours_in": rng.uniform(-1, 27, n).round(2)})
    ev = spark.createDataFrame(pdf).withColumn("value", F.when(F.col("value") < 2.5, F.col("value")))
    ev = ev.unionByName(spark.createDataFrame([(None, "m", 1.0, 3.0), (3, "s", -4.0, 0.5), (3, "s", -5.0, 1.5)], ev.schema))
    stays = spark.createDataFrame([(i,) for i in [*range(30), 77, 77, None]], "stay_id long")
    args = (ev, stays, ["m", "s", "u", "x"], 25, ["u"], ["s", "x"], 2, ["x"])
    packed = series.binned_grid(*args, packed=True)
    filled = series.fill_grid(packed, ["s", "x"], steps=12)
    flat = series.binned_grid(*args)
    windowed = series.fill_grid(flat, ["s", "x"], steps=12)
    assert filled.count() == windowed.count() == 32 * 4 * 12
    assert filled.exceptAll(windowed).count() == 0 and windowed.exceptAll(filled).count() == 0
    # against bins and cells made separately, for stays that are known
    dense = series.dense_grid(series.hourly_bins(ev, 24, ["u"], ["s", "x"], 2), stays.distinct().where("stay_id is not null"),
                              ["m", "s", "u", "x"], 12, ["x"])
    raw = [F.round("raw", 9).alias("raw")]
    known = flat.where("stay_id is not null").select("stay_id", "feature", "hr", *raw, "observed")
    assert known.exceptAll(dense.select("stay_id", "feature", "hr", *raw, "observed")).count() == 0


def test_series_fill_without_windows_and_shuffle_what_was_measured(spark):
    ev = spark.createDataFrame([(i, "heart_rate", 80.0, 1.5) for i in range(20)], "stay_id long, feature string, value double, hours_in double")
    stays = spark.range(500).select(F.col("id").alias("stay_id"))
    g = jobs.build_timeseries(ev, stays)
    assert "Window" not in g._jdf.queryExecution().optimizedPlan().toString()
    plan = g._jdf.queryExecution().executedPlan().toString()
    # nothing is unfolded below an exchange: all rows of steps come after the last one
    assert plan.index("Generate") < plan.index("Exchange") and "Generate" not in plan[plan.index("Exchange"):]
    assert g.count() == 500 * len(clinical.SERIES) * 24


def test_binning_by_feature(spark):
    ev = spark.createDataFrame([(1, "u", 2.0, 0.1), (1, "u", 3.0, 0.9), (1, "x", 2.0, 0.0), (1, "x", 5.0, 0.5),
                                (1, "m", 2.0, 0.0), (1, "m", 4.0, 0.5), (1, "m", 9.0, 24.0), (1, "m", 9.0, -0.1)],
                               "stay_id long, feature string, value double, hours_in double")
    got = {r["feature"]: r["value"] for r in series.hourly_bins(ev, 24, ["u"], ["x"]).collect()}
    assert got == {"u": 5.0, "x": 5.0, "m": 3.0}
    plain = {r["feature"]: r["value"] for r in series.hourly_bins(ev, 24).collect()}
    assert plain["u"] == 2.5


def test_scenarios(spark):
    g = series.scenario_grid(spark.range(1).withColumnRenamed("id", "stay_id"))
    def line(p):
        return [r["value"] for r in g.where(F.col("pattern") == p).orderBy("hr").collect()]
    assert line("stable_high") == [130.0] * 24
    assert line("crashing")[17:19] == [82.0, 77.0] and line("crashing")[-1] == 25.0
    assert line("crashing_late")[20:] == pytest.approx([82.0, 72.0, 48.5, 25.0])


def test_coverage_gate(spark):
    stays = spark.range(10).withColumnRenamed("id", "stay_id")
    ev = spark.range(9).select(F.col("id").alias("stay_id"), F.lit("heart_rate").alias("feature"),
                               F.lit(1.0).alias("value"), F.lit(1.0).alias("hours_in"))
    assert series.check_coverage(ev, stays, {"heart_rate": 0.9}, {"creatinine": 0.6}) == ["creatinine: 0.0% < 60%"]
    with pytest.raises(ValueError, match="heart_rate"):
        series.check_coverage(ev.where("stay_id < 8"), stays, {"heart_rate": 0.9})


def test_column_choice():
    names = ["age", "cci_prior_a", "cci_curr_a", "charlson_curr", "n_diagnoses_curr", "hr_v_min"]
    assert features.pick(names, include=["age"], prefix=["cci_prior_"]) == ["age", "cci_prior_a"]
    assert features.pick(names, exclude=["cci_", "charlson_", "n_diagnoses"]) == ["age", "hr_v_min"]


def test_leak_guard(spark):
    df = spark.createDataFrame([(1, 2, 3)], "age int, cci_curr_a int, cci_prior_a int")
    assert features.guard_leaky(df).columns == ["age", "cci_prior_a"]
    assert features.guard_leaky(df, allow=True).columns == df.columns


# --- whole jobs on small clinical tables ------------------------------------------------------

def test_clinical_jobs(spark, hospital):
    c = cohort.build_cohort(*hospital)
    chart = spark.sql("""select * from values
        (100, 220045, timestamp_ntz'2020-01-01 00:01:01', 80.0D), (100, 220045, timestamp_ntz'2020-01-01 00:30:00', 90.0D),
        (100, 220045, timestamp_ntz'2020-01-01 05:00:00', 900.0D), (100, 223761, timestamp_ntz'2020-01-01 02:00:30', 98.6D),
        (100, 999, timestamp_ntz'2020-01-01 02:00:00', 1.0D), (100, 220045, timestamp_ntz'2020-01-02 00:00:59', 80.0D)
        as t(stay_id, itemid, charttime, valuenum)""")
    labs = spark.sql("""select * from values (10, 50912, timestamp_ntz'2020-01-01 03:00:00', 1.2D),
        (cast(null as int), 50912, timestamp_ntz'2020-01-01 03:00:00', 1.2D) as t(hadm_id, itemid, charttime, valuenum)""")
    out = spark.sql("""select * from values (100, 226559, timestamp_ntz'2020-01-01 01:00:59', 50.0D),
        (100, 226560, timestamp_ntz'2020-01-01 01:20:00', 25.0D) as t(stay_id, itemid, charttime, value)""")
    vaso = spark.sql("select 100 stay_id, 221906 itemid, timestamp_ntz'2020-01-01 04:00:59' starttime")
    tables = {"chartevents": chart, "labevents": labs, "outputevents": out, "inputevents": vaso, "procedureevents": None}
    ev = jobs.extract_events(tables, c)
    rows = sorted((r["feature"], round(r["value"], 3), round(r["hours_in"], 4)) for r in ev.collect())
    assert rows == [("creatinine", 1.2, 3.0), ("heart_rate", 80.0, 0.0167), ("heart_rate", 90.0, 0.5),
                    ("temp_c", 37.0, 2.0), ("urine", 25.0, 1.3333), ("urine", 50.0, 1.0), ("vasopressor", 1.0, 4.0)]
    g = jobs.build_timeseries(ev, c).persist()
    assert g.count() == 2 * 24 * 43
    assert values(g, 100, "urine")[:3] == [None, 75.0, 75.0] and values(g, 100, "heart_rate")[0] == 85.0
    assert values(g, 100, "vasopressor")[3:5] == [0.0, 1.0] and values(g, 110, "ventilation") == [0.0] * 24

    dx = spark.sql("""select * from values (10, '41071', 9), (10, ' i50x', 10), (10, 'Z999', 10), (11, 'C780', 10)
                      as t(hadm_id, icd_code, icd_version)""")
    f = {r["stay_id"]: r for r in jobs.build_features(ev, c, dx, hospital[1], "both").collect()}
    assert f[110]["charlson_prior"] == 2.0 and f[110]["n_diagnoses_prior"] == 3.0
    assert f[110]["cci_prior_myocardial_infarction"] == 1.0 and f[110]["cci_prior_congestive_heart_failure"] == 1.0
    assert f[100]["charlson_prior"] == 0.0 and f[100]["charlson_curr"] == 2.0 and f[110]["charlson_curr"] == 6.0
    assert f[100]["heart_rate_v_count"] == 2 and f[100]["urine_v_max"] == 50.0 and f[110]["urine_v_count"] is None


def test_offset_jobs(spark):
    pat = spark.createDataFrame([
        (1, "p1", 7, "> 89", "Male", 1, 2000.0, "Alive", 5000.0), (2, "p2", 7, "50", "Female", 1, 2000.0, "Expired", 1440.0),
        (3, "p3", 8, "", "Male", 1, 2000.0, "Alive", 1.0), (4, "p4", 8, "40", "Female", 1, 1440.0, "Expired", 1441.0),
        (5, "p5", 8, "40", "Male", 2, 2000.0, "Alive", 1.0), (6, "p6", 8, "40", "Male", 1, 2000.0, None, 1.0)],
        "stay_id long, subject_id string, site int, age string, gender string, visit_no int, unit_end_min double, "
        "status string, hospital_end_min double")
    c = cohort.build_cohort_offsets(pat)
    assert {(r["stay_id"], r["age"], r["gender"], r["label"]) for r in c.collect()} == {(1, 90.0, "M", 0), (4, 40.0, "F", 1)}
    vit = spark.createDataFrame([(1, 30.0, 80.0, None), (1, 1440.0, 81.0, 1.0), (3, 5.0, 1.0, 1.0)],
                                "stay_id long, offset_min double, heartrate double, temperature double")
    for col in clinical.OFFSET_VITALS.values():
        if col not in vit.columns:
            vit = vit.withColumn(col, F.lit(None).cast("double"))
    labs = spark.createDataFrame([(1, 60.0, "HCO3", "24"), (1, 60.0, "pH", "high"), (1, 60.0, "unknown", "1")],
                                 "stay_id long, offset_min double, labname string, labresult string")
    drug = spark.createDataFrame([(1, 90.0, "NorEpinephrine drip")], "stay_id long, offset_min double, drugname string")
    ev = jobs.extract_offset_events({"vitals": vit, "labs": labs, "infusions": drug}, c)
    assert {(r["feature"], r["value"], r["hours_in"]) for r in ev.collect()} == {
        ("heart_rate", 80.0, 0.5), ("bicarbonate", 24.0, 1.0), ("vasopressor", 1.0, 1.5)}


def test_combined_sources(spark):
    a = spark.createDataFrame([(1, 5, "x")], "stay_id long, subject_id long, year_group string")
    b = spark.createDataFrame([(1, "u5", 3.0)], "stay_id long, subject_id string, score double")
    got = {tuple(r) for r in jobs.combine(a, b).select("stay_id", "subject_id", "year_group", "dataset", "score").collect()}
    assert got == {(1, "first_5", "x", "first", None), (900000001, "second_u5", "second_period", "second", 3.0)}
    g = spark.createDataFrame([(1, "m", 0, 1.0)], "stay_id long, feature string, hr int, value double")
    assert jobs.combine_grids(g, g).count() == 2
    with pytest.raises(ValueError, match="axes differ"):
        jobs.combine_grids(g, g.withColumn("feature", F.lit("other")))


def test_diagnosis_rules_expand_in_order():
    rules = clinical.diagnosis_rules()
    assert len({r[0] for r in rules}) == 17 and {len(r[3]) for r in rules} == {2, 3, 4, 5}
    assert len(clinical.SERIES) == len(set(clinical.SERIES)) == 43


@pytest.mark.parametrize("name", ["job_features", "job_clinical_grid"])
def test_cohort_is_built_once(spark, sf, name, monkeypatch):
    made = []
    monkeypatch.setattr(fixtures, "store", lambda df, tag: made.append(tag) or session.store(df, tag))
    catalog.QUERIES[name](spark, sf)
    assert made == ["cohort"]

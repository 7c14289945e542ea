"""One-call jobs: raw source tables to events, regular series, feature tables, one cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators import features, joins, series
from sitewise.plans import clinical as C

Tables = Mapping[str, DataFrame | None]


def extract_events(tables: Tables, cohort: DataFrame, window_h: int = 24) -> DataFrame:
    """Events of a timestamped source inside every stay's window.

    tables: chartevents, labevents, outputevents, and optionally inputevents and
    procedureevents (None or absent: no such events). The code filter and the
    column choice reach the scan; labs join on the admission, the rest on the stay.
    """
    def measured(name: str, table, on: str, value: str) -> DataFrame:
        raw = tables[name].where(F.col(value).isNotNull() & F.col(on).isNotNull()
                                 & F.col("itemid").isin([i for _, i in C.codes(table)]))
        named = series.map_codes(raw.withColumnRenamed(value, "value"), "itemid", C.codes(table))
        ok = series.within_limits(named, C.limits(table))
        return joins.window_join(ok, cohort, on, "charttime", window_h, keep=["feature", "value"])

    chart = series.fold_unit(measured("chartevents", C.CHART, "stay_id", "valuenum"), "temp_f", "temp_c",
                             series.fahrenheit_to_celsius)
    lab = measured("labevents", C.LAB, "hadm_id", "valuenum")
    urine = measured("outputevents", (("urine", C.URINE, *C.URINE_RANGE),), "stay_id", "value")
    parts = [chart, lab, urine]
    for name, feature, ids in (("inputevents", "vasopressor", C.VASOPRESSOR),
                               ("procedureevents", "ventilation", C.VENTILATION)):
        if tables.get(name) is not None:
            on = tables[name].where(F.col("itemid").isin(list(ids)))
            parts.append(series.constant_feature(
                joins.window_join(on, cohort, "stay_id", "starttime", window_h), feature))
    return series.union_events(*parts)


def extract_offset_events(tables: Tables, cohort: DataFrame, window_h: int = 24,
                          check_ranges: bool = False) -> DataFrame:
    """Events of a source with minute offsets.

    tables: vitals, labs, and optionally infusions, treatments, outputs; each with
    ``stay_id`` and ``offset_min``. Ranges are not checked unless asked for.
    """
    def inside(df: DataFrame) -> DataFrame:
        return series.offset_events(df, cohort, "offset_min", window_h)

    vitals = inside(series.unpivot_measures(tables["vitals"], ["stay_id", "offset_min"], C.OFFSET_VITALS))
    results = tables["labs"].withColumn("value", F.col("labresult").try_cast("double")).where(
        F.col("value").isNotNull())
    parts = [vitals, inside(series.map_codes(results, "labname", C.OFFSET_LABS))]
    if tables.get("infusions") is not None:
        on = tables["infusions"].where(F.lower("drugname").rlike(C.VASOPRESSOR_PATTERN))
        parts.append(series.constant_feature(inside(on), "vasopressor"))
    if tables.get("treatments") is not None:
        on = tables["treatments"].where(F.lower("treatmentstring").like("%ventilat%"))
        parts.append(series.constant_feature(inside(on), "ventilation"))
    if tables.get("outputs") is not None:
        urine = tables["outputs"].where(F.lower("celllabel").like("%urine%")
                                        & F.col("outputtotal").between(*C.URINE_RANGE))
        parts.append(inside(urine).select("stay_id", F.lit("urine").alias("feature"),
                                          F.col("outputtotal").alias("value"), "hours_in"))
    out = series.union_events(*parts)
    if not check_ranges:
        return out
    bounds = [b for b in C.limits(C.CHART) + C.limits(C.LAB) if b[0] != "temp_f"]
    return series.within_limits(out, [*bounds, ("urine", *map(float, C.URINE_RANGE)),
                                      *[(s, 0.0, 1.0) for s in C.SWITCHES]])


def build_timeseries(events: DataFrame, cohort: DataFrame, features_: Sequence[str] = C.SERIES, steps: int = 24,
                     sums: Sequence[str] = C.SUMMED, switches: Sequence[str] = C.SWITCHES) -> DataFrame:
    """Hourly grid of every stay: raw, causally filled value, observed flag, time since measured."""
    grid = series.binned_grid(events, cohort, features_, steps, sums, switches, always_observed=switches, packed=True)
    return series.fill_grid(grid, switches, steps=steps)


def build_features(events: DataFrame, cohort: DataFrame, dx: DataFrame | None = None,
                   admissions: DataFrame | None = None, source: str = "prior",
                   features_: Sequence[str] = C.SERIES, extra: DataFrame | None = None) -> DataFrame:
    """Wide feature table; ``source`` is none, prior, current or both (code history)."""
    if source not in ("none", "prior", "current", "both"):
        raise ValueError(f"unknown code history {source!r}")
    rules = C.diagnosis_rules()
    history = None
    if dx is not None and source == "current":
        history = features.current_comorbidities(dx, cohort, rules)
    elif dx is not None and source == "prior":
        history = features.prior_comorbidities(dx, admissions, cohort, rules)
    elif dx is not None and source == "both":
        history = features.both_comorbidities(dx, admissions, cohort, rules)
    return features.feature_table(cohort, events, features_, history, extra)


def combine(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("first", "second"),
            id_offset: int = 900_000_000, second_period: str = "second_period") -> DataFrame:
    """One cohort of two sources: ids apart, subjects prefixed, source tagged."""
    a = features.tag_source(first, names[0])
    b = features.tag_source(second, names[1], id_offset,
                            {} if "year_group" in second.columns else {"year_group": second_period})
    return features.union_sources(a, b)


def combine_grids(first: DataFrame, second: DataFrame, id_offset: int = 900_000_000) -> DataFrame:
    """Stack two grids; both must have the same features."""
    odd = features.feature_axis_diff(first, second).limit(5).collect()
    if odd:
        raise ValueError("feature axes differ: " + ", ".join(f"{r['feature']} ({r['side']})" for r in odd))
    return first.unionByName(second.withColumn("stay_id", F.col("stay_id") + F.lit(id_offset).cast("long")))

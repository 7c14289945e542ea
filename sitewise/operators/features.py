"""Wide aggregate features, static features, code-history flags, source union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import contains_flag, equals_flag
from sitewise.operators.joins import history_totals, rule_frame
from sitewise.session import store

STATS = ("v_min", "v_max", "v_mean", "v_count")


def window_aggregates(events: DataFrame) -> DataFrame:
    return events.groupBy("stay_id", "feature").agg(
        F.min("value").alias("v_min"), F.max("value").alias("v_max"),
        F.avg("value").alias("v_mean"), F.count(F.lit(1)).alias("v_count"))


def wide_features(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per stay, ``<feature>_v_min|max|mean|count``.

    The feature list is given, so no extra pass looks for the pivot values; the
    aggregates are computed straight from the events in one shuffle.
    """
    return events.groupBy("stay_id").pivot("feature", list(features)).agg(
        F.min("value").alias("v_min"), F.max("value").alias("v_max"),
        F.avg("value").alias("v_mean"), F.count("value").alias("v_count"))


def static_features(cohort: DataFrame, extra: DataFrame | None = None,
                    emergency: str = "EMER") -> DataFrame:
    """age, gender_m, admission_emergency, plus optional per-stay scores."""
    out = cohort.select("stay_id", *_static(emergency))
    return out if extra is None else out.join(extra, "stay_id", "left")


def _static(emergency: str) -> list[Column]:
    return [F.col("age").cast("double").alias("age"), equals_flag("gender", "M").alias("gender_m"),
            contains_flag("admission_type", emergency).alias("admission_emergency")]


def feature_table(cohort: DataFrame, events: DataFrame, features: Sequence[str],
                  comorbidities: DataFrame | None = None, extra: DataFrame | None = None,
                  emergency: str = "EMER") -> DataFrame:
    """Cohort, static flags, wide aggregates and code history side by side, raw scale.

    Static flags are columns of the cohort's rows; every other part arrives laid out by stay.
    """
    out = cohort.select("stay_id", "subject_id", "label", *_static(emergency))
    for part in (extra, wide_features(events, features), comorbidities):
        out = out if part is None else out.join(part, "stay_id", "left")
    return out


# --- code history ---------------------------------------------------------------

Rules = Sequence[tuple[str, int, int, str]]


def _weights(rules: Rules) -> dict[str, int]:
    return {c: w for c, w, _, _ in rules}


def code_counts(dx: DataFrame, rules: Rules, key: str = "hadm_id", code: str = "icd_code",
                version: str = "icd_version") -> DataFrame:
    """One row per ``key``: number of codes ``n_dx``, and 0/1 for every condition that one of them stands for.

    A code is cut to the few prefix lengths that occur and looked up in the broadcast table of prefixes. Counts
    and flags are one aggregation, combined before the shuffle, so a key with very many codes is one row per task.
    """
    meant: dict[tuple[int, str], list[str]] = {}
    for condition, _, v, prefix in rules:
        meant.setdefault((v, prefix), []).append(condition)
    table = rule_frame(dx.sparkSession, [(v, p, c) for (v, p), c in meant.items()], "_version int, _prefix string, _means array<string>")
    lengths = sorted({len(p) for _, p in meant})
    clean = F.upper(F.trim(F.col(code)))
    cuts = F.array_distinct(F.array(*[F.substring(clean, 1, n) for n in lengths])) if lengths else F.array(clean)
    cut = dx.select(key, F.col(version).cast("int").alias("_version"), F.posexplode(cuts).alias("_at", "_prefix"))
    flag = {c: F.coalesce(F.max(F.array_contains("_means", c).cast("int")), F.lit(0)) for c in _weights(rules)}
    return (cut.join(table, ["_version", "_prefix"], "left").where(F.col(key).isNotNull())
            .groupBy(key).agg(F.count_if(F.col("_at") == 0).alias("n_dx"), *[v.alias(c) for c, v in flag.items()]))


def _scored(frame: DataFrame, rules: Rules, tag: str) -> DataFrame:
    weights = _weights(rules)
    flag = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in weights}
    score = sum((flag[c] * float(w) for c, w in weights.items()), F.lit(0.0))
    t = f"{tag}_" if tag else ""
    end = f"_{tag}" if tag else ""
    return frame.select(
        "stay_id", *[flag[c].alias(f"cci_{t}{c}") for c in weights],
        score.alias("charlson_score" if not tag else f"charlson{end}"),
        F.coalesce(F.col("n_dx"), F.lit(0)).cast("double").alias(f"n_diagnoses{end}"))


def current_comorbidities(dx: DataFrame, cohort: DataFrame, rules: Rules, tag: str = "") -> DataFrame:
    """Flags and weighted index from the codes of the stay's own admission.

    These codes are assigned at discharge: fine for description, a leak for prediction.
    dx: hadm_id, icd_code, icd_version.
    """
    return _current(code_counts(dx, rules), cohort, rules, tag)


def prior_comorbidities(dx: DataFrame, admissions: DataFrame, cohort: DataFrame, rules: Rules,
                        tag: str = "") -> DataFrame:
    """The same from admissions of the patient that had ended before the stay began.

    Codes are reduced to one row per admission first; the history of a patient is
    then a running total along time, so a patient with very many admissions does
    not produce admission x stay pairs.
    """
    return _prior(code_counts(dx, rules), admissions, cohort, rules, tag)


def both_comorbidities(dx: DataFrame, admissions: DataFrame, cohort: DataFrame,
                       rules: Rules) -> DataFrame:
    """Prior and current variants side by side: cci_prior_*, cci_curr_*, ...; the codes are read once."""
    counts = store(code_counts(dx, rules), "admission-codes")
    return _prior(counts, admissions, cohort, rules, "prior").join(_current(counts, cohort, rules, "curr"), "stay_id")


def _current(counts: DataFrame, cohort: DataFrame, rules: Rules, tag: str) -> DataFrame:
    return _scored(cohort.select("stay_id", "hadm_id").join(counts, "hadm_id", "left"), rules, tag)


def _prior(counts: DataFrame, admissions: DataFrame, cohort: DataFrame, rules: Rules, tag: str) -> DataFrame:
    names = ["n_dx", *_weights(rules)]
    history = admissions.select("subject_id", "hadm_id", "dischtime").join(counts, "hadm_id")
    before = history_totals(history, cohort, "subject_id", "dischtime", "intime", {k: F.col(k) for k in names}, "hadm_id", "stay_id")
    seen = before.select("stay_id", "n_dx", *[(F.col(c) > 0).cast("int").alias(c) for c in _weights(rules)])
    return _scored(seen, rules, tag)


# --- columns ----------------------------------------------------------------------

# fixed values: columns that carry same-admission codes
LEAKY_PREFIXES = ("cci_curr_", "charlson_curr", "n_diagnoses_curr")


def pick(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (),
         prefix: Sequence[str] = ()) -> list[str]:
    """Names that equal one of ``include`` or start with a ``prefix`` (all, if neither
    is given) and contain no ``exclude`` text."""
    chosen = [n for n in names
              if (not include and not prefix) or n in include or n.startswith(tuple(prefix) or ("\0",))]
    return [n for n in chosen if not any(x in n for x in exclude)]


def guard_leaky(df: DataFrame, allow: bool = False) -> DataFrame:
    """Drop same-admission code columns unless they are asked for."""
    return df if allow else df.drop(*[c for c in df.columns if c.startswith(LEAKY_PREFIXES)])


# --- sources ------------------------------------------------------------------------

def tag_source(df: DataFrame, name: str, id_offset: int = 0,
               constants: Mapping[str, str] | None = None) -> DataFrame:
    """Mark a source: ids moved clear of other sources, subjects prefixed by its name."""
    out = df.withColumn("stay_id", F.col("stay_id") + F.lit(id_offset).cast("long"))
    if "subject_id" in df.columns:
        out = out.withColumn("subject_id", F.concat(F.lit(f"{name}_"), F.col("subject_id").cast("string")))
    for col, text in (constants or {}).items():
        out = out.withColumn(col, F.lit(text))
    return out.withColumn("dataset", F.lit(name))


def union_sources(*tagged: DataFrame) -> DataFrame:
    """Stack sources of different columns; a column a source lacks is null there."""
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def feature_axis_diff(a: DataFrame, b: DataFrame, column: str = "feature") -> DataFrame:
    """Features that only one of two sources has: (feature, side)."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return (x.join(y, column, "left_anti").withColumn("side", F.lit("left_only"))
            .unionByName(y.join(x, column, "left_anti").withColumn("side", F.lit("right_only"))))


"""Cohort building: first entity per key, age and stay filters, outcome-window guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import age_at, age_from_text, plus_hours, sex_code


def first_per_key(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The earliest row of every key, with the key's row count as ``n_in_key``; a null ``order`` is last.

    A minimum over a struct is combined before the shuffle, so a key with a third
    of all rows costs no more than any other; a row_number window would sort it
    in one task.
    """
    rest = [c for c in df.columns if c not in (key, order, tie)]
    best = df.groupBy(key).agg(
        F.min(F.struct(F.col(order).isNull().alias("_late"), order, tie, *rest)).alias("_first"),
        F.count(F.lit(1)).alias("n_in_key"))
    return best.select(key, "_first.*", "n_in_key").drop("_late")


def early_outcome(outcome_time: str, start: str, hours: int) -> Column:
    """True where the outcome happened inside the observation window; never null."""
    return F.coalesce(F.col(outcome_time) <= plus_hours(start, hours), F.lit(False))


def _placed(stays: DataFrame, patients: DataFrame, first_only: bool, how: str) -> DataFrame:
    base = (first_per_key(stays, "hadm_id", "intime", "stay_id") if first_only
            else stays.withColumn("n_in_key", F.lit(1).cast("long")))
    pats = patients.select("subject_id", "gender", "anchor_age", "anchor_year", "year_group",
                           F.lit(True).alias("_patient"))
    return (base.join(pats, "subject_id", how)
            .withColumn("los_hours", F.col("los") * 24.0)
            .withColumn("age", age_at("anchor_age", "anchor_year", "intime")))


def _admitted(admissions: DataFrame) -> DataFrame:
    return admissions.select("hadm_id", "admission_type", "deathtime", "label",
                             F.lit(True).alias("_admitted"))


def build_cohort(stays: DataFrame, admissions: DataFrame, patients: DataFrame, *,
                 min_age: int = 18, min_los_h: float = 24, window_h: int = 24,
                 first_only: bool = True, drop_early: bool = True,
                 max_subject: int | None = None) -> DataFrame:
    """One row per kept stay.

    stays: subject_id, hadm_id, stay_id, unit, intime, los (days); admissions:
    hadm_id, admission_type, deathtime, label; patients: subject_id, gender,
    anchor_age, anchor_year, year_group. ``max_subject`` restricts to the intact
    prefix of a damaged source.
    """
    c = (_placed(stays, patients, first_only, "inner")
         .where((F.col("age") >= min_age) & (F.col("los_hours") >= min_los_h))
         .join(_admitted(admissions), "hadm_id"))
    if max_subject is not None:
        c = c.where(F.col("subject_id") <= max_subject)
    if drop_early:
        c = c.where(~early_outcome("deathtime", "intime", window_h))
    return c.select("subject_id", "hadm_id", "stay_id", "unit", "intime", "los_hours", "age",
                    "gender", "year_group", "admission_type", "deathtime", "label")


def exclusion_flow(stays: DataFrame, admissions: DataFrame, patients: DataFrame, *,
                   min_age: int = 18, min_los_h: float = 24, window_h: int = 24,
                   max_subject: int | None = None) -> DataFrame:
    """The exclusion cascade as rows (step_no, step, n_stays, excluded), in one pass.

    Every rule is a flag on the joined rows and every step a conditional count,
    so the sources are read once however many steps there are.
    """
    flagged = (_placed(stays, patients, True, "left")
               .join(_admitted(admissions), "hadm_id", "left"))
    adult = (F.col("_patient").isNotNull() & (F.col("age") >= min_age)
             & (F.col("los_hours") >= min_los_h))
    kept = adult & F.col("_admitted").isNotNull()
    steps = [("All stays", F.sum("n_in_key")),
             ("First stay per admission", F.count(F.lit(1))),
             (f"Adults (age >= {min_age}) and stay >= {min_los_h}h",
              F.count(F.when(adult, 1)))]
    if max_subject is not None:
        kept = kept & (F.col("subject_id") <= max_subject)
        steps.append((f"Restricted to subject_id <= {max_subject}", F.count(F.when(kept, 1))))
    final = kept & ~early_outcome("deathtime", "intime", window_h)
    steps.append((f"Outcome later than {window_h}h", F.count(F.when(final, 1))))

    counts = flagged.agg(*[agg.alias(f"_s{i}") for i, (_, agg) in enumerate(steps)])
    rows = []
    for i, (text, _) in enumerate(steps):
        lost = F.col(f"_s{i - 1}") - F.col(f"_s{i}") if i else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i + 1).alias("step_no"), F.lit(text).alias("step"),
                             F.col(f"_s{i}").alias("n_stays"), lost.alias("excluded")))
    return counts.select(F.inline(F.array(*rows)))


def build_cohort_offsets(patient: DataFrame, *, min_age: int = 18, min_los_h: float = 24,
                         window_h: int = 24, unit_prefix: str = "Site_",
                         admission_type: str = "EMER.", died: str = "Expired") -> DataFrame:
    """Cohort of a source that stores minute offsets and text ages.

    patient: stay_id, subject_id, site, age (text), gender, visit_no,
    unit_end_min, status, hospital_end_min. There is no time of death, so a death
    counts as early when the hospital stay ended inside the window.
    """
    age = age_from_text("age")
    c = (patient.where((F.col("visit_no") == 1) & F.col("status").isNotNull())
         .select("stay_id", "subject_id",
                 F.concat(F.lit(unit_prefix), F.col("site").cast("string")).alias("unit"),
                 age.alias("age"), sex_code("gender").alias("gender"),
                 F.lit(admission_type).alias("admission_type"),
                 (F.col("unit_end_min") / 60.0).alias("los_hours"),
                 (F.col("status") == died).cast("int").alias("label"),
                 "hospital_end_min"))
    early = (F.col("label") == 1) & F.coalesce(F.col("hospital_end_min") <= window_h * 60,
                                               F.lit(False))
    return (c.where((F.col("age") >= min_age) & (F.col("los_hours") >= min_los_h) & ~early)
            .drop("hospital_end_min"))


def cohort_summary(cohort: DataFrame) -> DataFrame:
    return cohort.agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.countDistinct("subject_id").alias("n_subjects"),
        F.avg("label").alias("outcome_rate"),
        F.countDistinct("unit").alias("n_units"))

"""Event extraction, regular binning, densifying and causal filling of time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators.joins import rule_frame, salted_join

EVENT_SCHEMA = "stay_id bigint, feature string, value double, hours_in double"


# --- extraction --------------------------------------------------------------

def map_codes(events: DataFrame, code: str, codes: Sequence[tuple[str, int | str]],
              feature: str = "feature") -> DataFrame:
    """Name the feature of every coded row; rows with an unknown code are dropped.

    ``codes`` are (feature, code). The table is broadcast and joins inner, so it
    is the membership filter as well.
    """
    kind = "string" if isinstance(codes[0][1], str) else "bigint"
    table = rule_frame(events.sparkSession, codes, f"{feature} string, _code {kind}")
    return events.join(table, F.col(code) == F.col("_code")).drop("_code")


def within_limits(events: DataFrame, limits: Sequence[tuple[str, float, float]],
                  value: str = "value") -> DataFrame:
    """Keep values inside their feature's closed range; unknown features are dropped."""
    table = rule_frame(events.sparkSession, [(f, float(a), float(b)) for f, a, b in limits],
                       "feature string, _lo double, _hi double")
    return (events.join(table, "feature").where(F.col(value).between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def fold_unit(events: DataFrame, source: str, target: str, convert) -> DataFrame:
    """Convert the values of one feature and give them another feature's name."""
    hit = F.col("feature") == source
    return (events.withColumn("value", F.when(hit, convert(F.col("value")))
                              .otherwise(F.col("value")))
            .withColumn("feature", F.when(hit, target).otherwise(F.col("feature"))))


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def constant_feature(frame: DataFrame, feature: str, value: float = 1.0) -> DataFrame:
    """Presence events: the named feature with a constant value."""
    return frame.select("stay_id", F.lit(feature).alias("feature"),
                        F.lit(float(value)).alias("value"), "hours_in")


def unpivot_measures(wide: DataFrame, ids: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Wide measurement columns (feature -> column) to long rows; nulls are dropped."""
    renamed = wide.select(*ids, *[F.col(c).cast("double").alias(f) for f, c in columns.items()])
    return renamed.unpivot(list(ids), list(columns), "feature", "value").where(
        F.col("value").isNotNull())


def offset_events(events: DataFrame, cohort: DataFrame, minutes: str, hours: int) -> DataFrame:
    """Events of cohort members with 0 <= offset < hours, offsets in minutes."""
    inside = events.where((F.col(minutes) >= 0) & (F.col(minutes) < hours * 60))
    return (salted_join(inside, cohort.select("stay_id").distinct(), ["stay_id"], [minutes], "left_semi")
            .withColumn("hours_in", F.col(minutes) / 60.0))


def union_events(*parts: DataFrame) -> DataFrame:
    """All event sources in one long table; rows without a feature are dropped."""
    out = None
    for p in parts:
        p = p.select("stay_id", "feature", F.col("value").cast("double").alias("value"),
                     F.col("hours_in").cast("double").alias("hours_in"))
        out = p if out is None else out.unionByName(p)
    return out.where(F.col("feature").isNotNull() & (F.col("feature") != ""))


def coverage(events: DataFrame, cohort: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of the cohort with any event and with each named feature (one row)."""
    # one row per stay before the join
    seen = (events.groupBy("stay_id").agg(*[F.max((F.col("feature") == f).cast("int")).alias(f) for f in features])
            .join(cohort.select("stay_id"), "stay_id", "left_semi"))
    n = cohort.agg(F.count(F.lit(1)).alias("n")).scalar()
    return seen.agg(F.count(F.lit(1)).alias("_any"), *[F.sum(f).alias(f) for f in features]).select(
        n.alias("n_stays"), (F.col("_any") / F.greatest(n, F.lit(1))).alias("any_share"),
        *[(F.coalesce(F.col(f), F.lit(0)) / F.greatest(n, F.lit(1))).alias(f"{f}_share")
          for f in features])


def check_coverage(events: DataFrame, cohort: DataFrame, required: Mapping[str, float],
                   advised: Mapping[str, float] | None = None) -> list[str]:
    """Stop on a feature below its required share; return warnings for advised ones."""
    advised = advised or {}
    row = coverage(events, cohort, [*required, *advised]).first()
    for f, low in required.items():
        if row[f"{f}_share"] < low:
            raise ValueError(f"only {row[f'{f}_share']:.1%} of stays have {f}, expected at least "
                             f"{low:.0%}: the source looks incomplete")
    return [f"{f}: {row[f'{f}_share']:.1%} < {low:.0%}" for f, low in advised.items()
            if row[f"{f}_share"] < low]


# --- regular series ------------------------------------------------------------

def hourly_bins(events: DataFrame, hours: int, sums: Sequence[str] = (),
                maxima: Sequence[str] = (), width_h: int = 1) -> DataFrame:
    """One row per (stay, feature, bin): sum, maximum or mean by feature."""
    f = F.col("feature")
    value = (F.when(f.isin(*sums), F.sum("value")) if sums else F.when(F.lit(False), F.sum("value")))
    if maxima:
        value = value.when(f.isin(*maxima), F.max("value"))
    return (events.where((F.col("hours_in") >= 0) & (F.col("hours_in") < hours))
            .groupBy("stay_id", "feature",
                     F.floor(F.col("hours_in") / width_h).cast("int").alias("hr"))
            .agg(value.otherwise(F.avg("value")).alias("value")))


def dense_grid(hourly: DataFrame, cohort: DataFrame, features: Sequence[str], steps: int,
               always_observed: Sequence[str] = ()) -> DataFrame:
    """Every stay x feature x step, with the binned value (or null) and ``observed``.

    Only the sparse bins are shuffled: they are packed per stay (at most
    features x steps entries), joined to the cohort, and unfolded after the join.
    The dense rows stay where their stay is, ready for per-stay windows.
    """
    known = hourly.where(F.col("feature").isin(*features) & F.col("hr").between(0, steps - 1))
    packed = (known.groupBy("stay_id", "feature")
              .agg(F.map_from_entries(F.collect_list(F.struct("hr", "value"))).alias("slots"))
              .groupBy("stay_id").agg(F.collect_list(F.struct("feature", "slots")).alias("packs")))
    kind = "array<struct<feature:string,slots:map<int,double>>>"
    packs = F.coalesce(F.col("packs"), F.array().cast(kind))
    names = F.array(*[F.lit(f) for f in features])
    absent = F.transform(
        F.array_except(names, F.transform(packs, lambda p: p["feature"])),
        lambda f: F.struct(f.alias("feature"), F.lit(None).cast("map<int,double>").alias("slots")))
    by_feature = (cohort.select("stay_id").join(packed, "stay_id", "left")
                  .select("stay_id", F.inline(F.concat(packs, absent))))
    rows = by_feature.select("stay_id", "feature", "slots",
                             F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("hr"))
    value = F.try_element_at(F.col("slots"), F.col("hr"))
    seen = value.isNotNull()
    if always_observed:
        seen = seen | F.col("feature").isin(*always_observed)
    return rows.select("stay_id", "feature", "hr", value.alias("raw"), seen.cast("int").alias("observed"))


def binned_grid(events: DataFrame, cohort: DataFrame, features: Sequence[str], hours: int, sums: Sequence[str] = (),
                maxima: Sequence[str] = (), width_h: int = 1, always_observed: Sequence[str] = (), packed: bool = False) -> DataFrame:
    """``hourly_bins`` and ``dense_grid`` in one: every stay x feature x step with the binned value or null.

    Only what was measured is shuffled: bins, combined before the shuffle, so a stay with very many events is at most
    features x steps rows per task, and one row per stay of the cohort. Features that a stay lacks appear after it.
    ``packed`` gives a row per stay and feature instead, (stay_id, feature, bins, always) with the measured bins
    (hr, raw) in order, which ``fill_grid`` fills and unfolds without a window.
    """
    steps = hours // width_h
    f = F.col("feature")
    slot = F.floor(F.col("hours_in") / width_h).cast("int")
    found = events.where((F.col("hours_in") >= 0) & (F.col("hours_in") < hours) & f.isin(*features)).select(
        "stay_id", "feature", slot.alias("hr"), F.col("value").cast("double").alias("_x")).where(F.col("hr") < steps)
    value = F.avg("_x")
    if maxima:
        value = F.when(f.isin(*maxima), F.max("_x")).otherwise(value)
    if sums:
        value = F.when(f.isin(*sums), F.sum("_x")).otherwise(value)
    bins = found.groupBy("stay_id", "feature", "hr").agg(value.alias("raw")).where(F.col("raw").isNotNull())
    seeds = cohort.select("stay_id", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("hr"),
                          F.lit(None).cast("double").alias("raw"), F.lit(True).alias("_seed"))
    # laid out by stay once, for both aggregations
    rows = bins.withColumn("_seed", F.lit(False)).unionByName(seeds).repartition("stay_id")
    by_feature = rows.groupBy("stay_id", "feature").agg(
        F.max("_seed").alias("_seed"), F.array_sort(F.collect_list(F.when(F.col("hr").isNotNull(), F.struct("hr", "raw")))).alias("bins"))
    by_stay = by_feature.groupBy("stay_id").agg(
        F.max("_seed").alias("_seed"), F.collect_list(F.when(f.isNotNull(), F.struct("feature", "bins"))).alias("_packs")).where("_seed")
    absent = F.transform(
        F.array_except(F.array(*[F.lit(x) for x in features]), F.transform("_packs", lambda p: p["feature"])),
        lambda x: F.struct(x.alias("feature"), F.array().cast("array<struct<hr:int,raw:double>>").alias("bins")))
    always = f.isin(*always_observed) if always_observed else F.lit(False)
    grid = by_stay.select("stay_id", F.inline(F.concat("_packs", absent))).withColumn("always", always)
    return grid if packed else _unfold(grid, (), steps).select("stay_id", "feature", "hr", "raw", "observed")


def _unfold(packed: DataFrame, running_max: Sequence[str], steps: int) -> DataFrame:
    """(stay_id, feature, hr, raw, value, observed, _since) of a packed grid.

    A measured bin holds until the next one, so a row's steps are a few stretches; each carries what its steps share.
    """
    on = F.col("feature").isin(*running_max) if running_max else F.lit(False)

    def stretch(b: Column, i: Column) -> Column:
        highest = F.array_max(F.transform(F.slice("bins", 1, i + 1), lambda c: c["raw"]))
        return F.struct(i.alias("_i"), b["hr"].alias("_from"), F.coalesce(F.get("bins", i + 1)["hr"], F.lit(steps)).alias("_to"),
                        F.coalesce(F.get("bins", i - 1)["hr"], F.lit(0)).alias("_before"), b["raw"].alias("_x"),
                        F.when(F.col("_on"), highest).alias("_m"))

    none = F.lit(None).cast("double")
    start = F.coalesce(F.get("bins", F.lit(0))["hr"], F.lit(steps))
    head = F.struct(F.lit(-1).alias("_i"), F.lit(0).alias("_from"), start.alias("_to"), F.lit(0).alias("_before"), none.alias("_x"), none.alias("_m"))
    measured = F.transform("bins", stretch)
    parts = F.when(start > 0, F.concat(F.array(head), measured)).otherwise(measured)
    rows = (packed.withColumn("_on", on).select("stay_id", "feature", "always", "_on", F.inline(parts))
            .select("*", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("hr")))
    hr, i, from_, m = (F.col(c) for c in ("hr", "_i", "_from", "_m"))
    here = (hr == from_) & (i >= 0)
    # a step without a measurement counts as 0 from there on
    top = F.when(i < 0, F.lit(0.0)).when((hr > from_) | (from_ > i), F.greatest(m, F.lit(0.0))).otherwise(m)
    since = F.when(F.col("always"), F.least(hr, F.lit(1))).when(here, hr - F.col("_before")).otherwise(hr - from_)
    return rows.select("stay_id", "feature", "hr", F.when(here, F.col("_x")).alias("raw"), F.when(F.col("_on"), top).otherwise(F.col("_x")).alias("value"),
                       (here | F.col("always")).cast("int").alias("observed"), since.alias("_since"))


def fill_grid(grid: DataFrame, running_max: Sequence[str] = (), cap: int | None = None,
              steps: int = 24) -> DataFrame:
    """Causal fill of a dense grid.

    ``value``: the last value seen so far (leading gaps stay null); for
    ``running_max`` features, nulls count as 0 and the maximum so far holds.
    ``since``: steps since the last real measurement, capped and scaled to [0, 1].
    A packed grid (``binned_grid``) is filled row by row. Else all windows share one sort
    and never exceed ``steps`` rows.
    """
    cap = float(cap if cap is not None else steps)
    if "bins" in grid.columns:
        return _unfold(grid, running_max, steps).select(
            "stay_id", "feature", "hr", "raw", "value", "observed", (F.least(F.col("_since").cast("double"), F.lit(cap)) / cap).alias("since"))
    w = Window.partitionBy("stay_id", "feature").orderBy("hr")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    value = F.last("raw", ignorenulls=True).over(upto)
    if running_max:
        on = F.max(F.coalesce(F.col("raw"), F.lit(0.0))).over(upto)
        value = F.when(F.col("feature").isin(*running_max), on).otherwise(value)
    last_seen = F.last(F.when(F.col("observed") == 1, F.col("hr")), ignorenulls=True).over(before)
    since = F.col("hr") - F.coalesce(last_seen, F.lit(0))
    return grid.select("stay_id", "feature", "hr", "raw", value.alias("value"), "observed",
                       (F.least(since.cast("double"), F.lit(cap)) / cap).alias("since"))


def override(grid: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the value at (stay, feature, hour) where an edit exists."""
    e = edits.select("stay_id", "feature", "hr", F.col("value").alias("_edit"))
    return (grid.join(e, ["stay_id", "feature", "hr"], "left")
            .withColumn("value", F.coalesce("_edit", "value"))
            .withColumn("edited", F.col("_edit").isNotNull().cast("int")).drop("_edit"))


def pack_series(grid: DataFrame, value: str = "value") -> DataFrame:
    """Long grid to one ordered array of (hr, value) per stay and feature."""
    pairs = F.array_sort(F.collect_list(F.struct("hr", F.col(value).alias("v"))))
    return grid.groupBy("stay_id", "feature").agg(pairs.alias("_p")).select(
        "stay_id", "feature", F.transform("_p", lambda p: p["v"]).alias("series"))


def unpack_series(packed: DataFrame) -> DataFrame:
    return packed.select("stay_id", "feature", F.posexplode("series").alias("hr", "value"))


def trajectories(grid: DataFrame, switches: Sequence[str] = ()) -> DataFrame:
    """Display form per stay and feature: values to one decimal (gaps null), or ever-on."""
    # means wobble in their last digit with the order of summing: settle that before halves round
    rounded = grid.withColumn("value", F.round(F.round("value", 6), 1))
    return pack_series(rounded).withColumn(
        "ever_on", F.when(F.col("feature").isin(*switches),
                          (F.coalesce(F.array_max("series"), F.lit(0.0)) > 0).cast("int"))
        if switches else F.lit(None).cast("int"))


# fixed values: the probe patterns of the trend check
PATTERNS = ("stable_normal", "stable_high", "crashing", "crashing_late")


def scenario_grid(entities: DataFrame, start: float = 82.0, high: float = 130.0,
                  crisis: float = 25.0, steps: int = 24) -> DataFrame:
    """Every entity under every probe pattern: (entity columns, pattern, hr, value).

    Flat; flat and high; a linear drop over the last 6 steps beginning 5 below the
    start; the same over the last 3 steps beginning 10 below.
    """
    hr = F.col("hr").cast("double")

    def drop(last: int, below: float) -> Column:
        begin = steps - last
        at = (start - below) + (crisis - (start - below)) * (hr - begin) / float(last - 1)
        return F.when(hr < begin, F.lit(start)).otherwise(at)

    grid = (entities
            .withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in PATTERNS])))
            .withColumn("hr", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))))
    p = F.col("pattern")
    return grid.withColumn(
        "value", F.when(p == PATTERNS[0], F.lit(start)).when(p == PATTERNS[1], F.lit(high))
        .when(p == PATTERNS[2], drop(6, 5.0)).otherwise(drop(3, 10.0)))

"""Integrity checks: codes, categories, order, coverage, leakage, fingerprints, bias tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.scalars import magnitude


# --- tables, codes, categories -------------------------------------------------------

def required_columns(tables: Mapping[str, DataFrame | None], spec: Mapping[str, Sequence[str]],
                     optional: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """(table, level, detail) per table; only schemas are looked at, no rows are read."""
    out = []
    for name, columns in spec.items():
        df = tables.get(name)
        soft = name in optional
        if df is None:
            out.append((name, "skip" if soft else "FAIL", "table not found"))
            continue
        missing = [c for c in columns if c not in df.columns]
        out.append((name, "FAIL", "missing: " + ", ".join(missing)) if missing
                   else (name, "ok", f"{len(df.columns)} columns"))
    return out


def missing_codes(dictionary: DataFrame, column: str, groups: Mapping[str, Sequence],
                  warn_only: Sequence[str] = ()) -> DataFrame:
    """Configured codes the dictionary lacks: (grp, code, level)."""
    rows = [(g, str(c), "WARN" if g in warn_only else "FAIL") for g, cs in groups.items() for c in cs]
    wanted = dictionary.sparkSession.createDataFrame(rows, "grp string, code string, level string")
    have = dictionary.select(F.col(column).cast("string").alias("code")).distinct()
    return wanted.join(have, "code", "left_anti").select("grp", "code", "level")


def domain_diff(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Values seen but not expected, and expected but not seen: (value, problem)."""
    seen = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    known = df.sparkSession.createDataFrame([(v,) for v in expected], "value string")
    return (seen.subtract(known).withColumn("problem", F.lit("unexpected"))
            .unionByName(known.subtract(seen).withColumn("problem", F.lit("absent"))))


def group_sizes(df: DataFrame, column: str, min_size: int) -> DataFrame:
    """Category sizes, whether each is large enough, and the total row count."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t")).scalar()       # from the same shuffle
    return sizes.select(column, "n", (F.col("n") < min_size).cast("int").alias("below_min"),
                        total.alias("n_total"))


# --- damaged files ---------------------------------------------------------------------

def order_violations(df: DataFrame, sequence: str, key: str, chunk: int = 1_000_000) -> DataFrame:
    """How often ``key`` is smaller than in the row before, in ``sequence`` order.

    The sequence (a file position or row number) is explicit. Chunks of it are
    compared inside one task each; the row before a chunk is the last row of the
    chunk before, so only chunk ends meet in the second step.
    """
    rows = df.select(F.col(sequence).alias("_s"), F.col(key).alias("_k"),
                     F.floor(F.col(sequence) / chunk).alias("_c"))
    w = Window.partitionBy("_c").orderBy("_s")
    inner = rows.withColumn("_prev", F.lag("_k").over(w)).agg(
        F.count(F.when(F.col("_k") < F.col("_prev"), 1)).alias("n")).scalar()
    ends = rows.groupBy("_c").agg(F.min_by("_k", "_s").alias("_first"), F.max_by("_k", "_s").alias("_last"))
    # chunk numbers are grouped once more so that no single task sees all of them
    seams = _seams(ends, span=100_000)
    return seams.select((inner + F.col("n")).alias("violations"))


def _seams(ends: DataFrame, span: int) -> DataFrame:
    """Violations between neighbouring chunks (empty chunks in between are skipped)."""
    blocks = ends.withColumn("_b", F.floor(F.col("_c") / span))
    w = Window.partitionBy("_b").orderBy("_c")
    inside = blocks.withColumn("_prev", F.lag("_last").over(w))
    n_in = inside.agg(F.count(F.when(F.col("_first") < F.col("_prev"), 1)).alias("n"))
    tops = blocks.groupBy("_b").agg(F.min_by("_first", "_c").alias("_first"),
                                    F.max_by("_last", "_c").alias("_last"))
    order = Window.partitionBy(F.lit(0)).orderBy("_b")      # one row per span * chunk rows
    n_top = (tops.withColumn("_prev", F.lag("_last").over(order))
             .agg(F.count(F.when(F.col("_first") < F.col("_prev"), 1)).alias("m")).scalar())
    return n_in.select((F.col("n") + n_top).alias("n"))


def prefix_stats(df: DataFrame, key: str) -> DataFrame:
    """Range, rows and keys of a readable prefix; the cutoff is the largest complete key.

    The last key of a file cut off mid-write is incomplete, so the cutoff is the
    largest key below it.
    """
    keys = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    top = keys.agg(F.max("_k").alias("m")).scalar()         # from the same shuffle
    return keys.withColumn("_top", top).agg(
        F.min("_k").alias("min_key"), F.max("_k").alias("max_key"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("_k").alias("n_keys"),
        F.max(F.when(F.col("_k") < F.col("_top"), F.col("_k"))).alias("cutoff"))


# --- fingerprint -------------------------------------------------------------------------

def fingerprint(df: DataFrame, key: str = "stay_id", fan: int = 4096) -> DataFrame:
    """One 16-digit hash of the set of ids (with multiplicities), any row order.

    A tree of SHA-256 hashes: ids that share id div 4096 are hashed in order, then
    their hashes that share the next quotient, and so on for five levels. No task
    sees more than 4096 ids or hashes per group.
    """
    level = (df.groupBy(F.col(key).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("c"))
             .select("k", F.concat_ws(":", F.col("k").cast("string"), F.col("c").cast("string"))
                     .alias("v")))
    for _ in range(5):
        up = level.select(F.floor(F.col("k") / fan).alias("p"), "k", "v")
        level = up.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv")).select(
            F.col("p").alias("k"),
            F.sha2(F.array_join(F.transform("kv", lambda x: x["v"]), ","), 256).alias("v"))
    root = F.array_sort(F.collect_list(F.struct("k", "v")))
    return level.agg(F.substring(
        F.sha2(F.array_join(F.transform(root, lambda x: x["v"]), ","), 256), 1, 16)
        .alias("fingerprint"))


def check_fingerprint(cohort: DataFrame, expected: str, key: str = "stay_id") -> None:
    found = fingerprint(cohort, key).first()["fingerprint"]
    if found != expected:
        raise ValueError(f"cohort {found} is not the one this partition was built for ({expected})")


# --- partitions ----------------------------------------------------------------------------

def membership(split: DataFrame, cohort: DataFrame, unit: str = "unit") -> DataFrame:
    """Per client: test rows, test events, test rate, its unit's rate, share of own-unit rows."""
    units = cohort.groupBy(unit).agg(F.avg("label").alias("unit_rate"))
    test = split.where(F.col("split") == "test").groupBy("client").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("events"),
        F.avg("label").alias("test_rate"),
        F.avg((F.col(unit) == F.col("client")).cast("double")).alias("own_share"))
    sizes = cohort.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (test.join(units.withColumnRenamed(unit, "client"), "client", "left")
            .withColumn("valid", (F.col("own_share") > 0.99).cast("int"))
            .withColumn("n_cohort", sizes))


def split_leakage(split: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Patients in more than one split: inside a client, and over all clients."""
    per = split.groupBy("client", subject).agg(
        F.min("split").alias("a"), F.max("split").alias("b"))
    over = per.groupBy(subject).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    inside = per.where(F.col("a") < F.col("b")).select(
        F.lit("within_client").alias("scope"), "client", F.col(subject).cast("string").alias("subject"))
    across = over.where(F.col("a") < F.col("b")).select(
        F.lit("global").alias("scope"), F.lit(None).cast("string").alias("client"),
        F.col(subject).cast("string").alias("subject"))
    return inside.unionByName(across)


def leakage_counts(split: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Both leakage checks as numbers; zero within clients is what a split must give."""
    found = split_leakage(split, subject)
    return found.agg(
        F.count(F.when(F.col("scope") == "within_client", 1)).alias("within_client"),
        F.count(F.when(F.col("scope") == "global", 1)).alias("across_clients"))


def assert_no_leakage(split: DataFrame, subject: str = "subject_id", scope: str = "within_client") -> None:
    bad = split_leakage(split, subject).where(F.col("scope") == scope).limit(1).collect()
    if bad:
        raise AssertionError(f"subject {bad[0]['subject']} is in more than one split ({scope})")


def thin_clients(split: DataFrame, min_train: int = 50, min_test: int = 25) -> DataFrame:
    """Clients with few outcome events in train or test."""
    def events(part: str) -> Column:
        return F.sum(F.when(F.col("split") == part, F.col("label")).otherwise(0))

    return (split.groupBy("client").agg(events("train").alias("train_events"),
                                        events("val").alias("val_events"),
                                        events("test").alias("test_events"))
            .where((F.col("train_events") < min_train) | (F.col("test_events") < min_test)))


# --- is the kept part representative? --------------------------------------------------------

def welch_effect(df: DataFrame, kept: Column, columns: Sequence[str]) -> DataFrame:
    """Kept against excluded rows, per numeric column: means, SDs, Welch t, df, Cohen's d."""
    long = df.select(kept.alias("_kept"), *[F.col(c).cast("double").alias(c) for c in columns])
    stats = (long.unpivot(["_kept"], list(columns), "characteristic", "x")
             .where(F.col("x").isNotNull()).groupBy("characteristic"))

    def side(flag: bool):
        x = F.when(F.col("_kept") == F.lit(flag), F.col("x"))
        s = "kept" if flag else "excluded"
        return [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"mean_{s}"), F.var_samp(x).alias(f"var_{s}")]

    out = stats.agg(*side(True), *side(False))
    n1, n2 = F.col("n_kept"), F.col("n_excluded")
    m1, m2 = F.col("mean_kept"), F.col("mean_excluded")
    v1, v2 = F.col("var_kept"), F.col("var_excluded")
    a, b = v1 / n1, v2 / n2
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    d = F.try_divide(m1 - m2, pooled)
    return out.select(
        "characteristic", "n_kept", "n_excluded", "mean_kept", "mean_excluded",
        F.sqrt(v1).alias("sd_kept"), F.sqrt(v2).alias("sd_excluded"),
        F.try_divide(m1 - m2, F.sqrt(a + b)).alias("t"),
        F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)).alias("df"),
        d.alias("cohens_d"), magnitude(d).alias("magnitude"))


def proportion_effect(df: DataFrame, kept: Column, flags: Mapping[str, Column]) -> DataFrame:
    """Kept against excluded rows, per 0/1 flag: 2x2 chi-square (Yates) and Cohen's h."""
    names = list(flags)
    long = (df.select(kept.cast("int").alias("_kept"),
                      *[c.cast("double").alias(k) for k, c in flags.items()])
            .unpivot(["_kept"], names, "characteristic", "x"))
    k, x = F.col("_kept"), F.col("x")
    c = long.groupBy("characteristic").agg(
        F.sum(k).cast("double").alias("n1"), F.sum(1 - k).cast("double").alias("n2"),
        F.coalesce(F.sum(k * x), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum((1 - k) * x), F.lit(0.0)).alias("b"))
    n1, n2, a, b = (F.col(i) for i in ("n1", "n2", "a", "b"))
    n, yes = n1 + n2, a + b
    # |observed - expected| is the same in all four cells; Yates moves it by at most 1/2
    gap = F.abs(a - n1 * yes / n)
    gap = gap - F.least(F.lit(0.5), gap)
    cells = [n1 * yes / n, n2 * yes / n, n1 * (n - yes) / n, n2 * (n - yes) / n]
    testable = (yes > 0) & (yes < n) & (n1 > 0) & (n2 > 0)
    chi2 = sum((F.try_divide(gap * gap, e) for e in cells), F.lit(0.0))
    h = 2 * F.asin(F.sqrt(F.try_divide(a, n1))) - 2 * F.asin(F.sqrt(F.try_divide(b, n2)))
    return c.select("characteristic", F.try_divide(a, n1).alias("p_kept"),
                    F.try_divide(b, n2).alias("p_excluded"),
                    F.when(testable, chi2).alias("chi2"), F.when(testable, h).alias("cohens_h"),
                    F.when(testable, magnitude(h)).otherwise("not testable").alias("magnitude"))


def composition_chi2(df: DataFrame, kept: Column, category: str) -> DataFrame:
    """k x 2 chi-square of a category's composition, kept against excluded."""
    c = (df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("cat"))
         .agg(F.sum(kept.cast("int")).cast("double").alias("a"),
              F.sum((~kept).cast("int")).cast("double").alias("b")))
    # sum over cells of (o - e)^2 / e  =  N * (sum o^2 / (row * col) - 1)
    parts = c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"),
                  F.sum(F.col("a") * F.col("a") / (F.col("a") + F.col("b"))).alias("qa"),
                  F.sum(F.col("b") * F.col("b") / (F.col("a") + F.col("b"))).alias("qb"),
                  F.count(F.lit(1)).alias("k"))
    n = F.col("sa") + F.col("sb")
    return parts.select((n * (F.try_divide("qa", "sa") + F.try_divide("qb", "sb") - 1)).alias("chi2"),
                        (F.col("k") - 1).alias("df"), n.cast("long").alias("n"))


def with_material(report: DataFrame, p_value: Column, effect: str) -> DataFrame:
    """A representativeness report with its p-value and the verdict; both null where nothing can be tested."""
    return report.withColumn("p_value", p_value).withColumn("material", material(F.col("p_value"), F.col(effect)))


def material(p_value: Column, effect: Column) -> Column:
    """A difference that is both detectable and at least 'small'."""
    return (p_value < 0.05) & (F.abs(effect) >= 0.20)



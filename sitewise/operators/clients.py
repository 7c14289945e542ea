"""Assign rows to clients (sites) and to leak-free splits; describe how clients differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import half_even, hash_hex, js_divergence
from sitewise.operators.joins import lookup_join, salted_join
from sitewise.operators.ordered import exact_quantiles, hash_rank, running_totals
from sitewise.session import store

SPLITS = ("train", "val", "test")


# --- assignment ------------------------------------------------------------------

def client_sizes(cohort: DataFrame, column: str, min_size: int) -> DataFrame:
    return (cohort.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size))


def by_category(cohort: DataFrame, column: str, min_size: int = 500) -> DataFrame:
    """Clients are the values of a column; values with too few rows are left out."""
    sizes = client_sizes(cohort, column, min_size)
    return (lookup_join(cohort, sizes.select(column), [column], cohort.columns, "left_semi")
            .withColumn("client", F.col(column)))


def by_source(cohort: DataFrame, source: str, column: str, min_size: int = 500) -> DataFrame:
    """Category clients of one source only."""
    return by_category(cohort.where(F.col("dataset") == source), column, min_size)


def guard_clients(assigned: DataFrame, scheme: str) -> DataFrame:
    """Stop early when a scheme yields no client, or only one."""
    n = assigned.select("client").distinct().limit(2).count()
    if n < 2:
        raise ValueError(f"scheme '{scheme}' gave {n} client(s), at least 2 are needed: "
                         "lower the minimum size or check the cohort")
    return assigned


def shuffled(cohort: DataFrame, column: str, min_size: int = 500, seed: int = 42) -> DataFrame:
    """Size-matched control: the clients' sizes stay, whole patients are reshuffled.

    Patients are laid out in hash order and the running stay count is cut at the
    cumulative client sizes (largest client first). Every client is within one
    patient of its size; patients beyond the last cut belong to no client.
    """
    # clients from large to small, each from where the ones before it end: a prefix sum, as there may be many
    sizes = client_sizes(cohort, column, min_size).select(F.struct((-F.col("n")).alias("d"), F.col(column).alias("client")).alias("_o"), "n")
    targets = store(running_totals(sizes, "_o", {"n": F.col("n")}, index="_p").select(
        F.col("_o.client").alias("client"), F.col("n_before").alias("_at"), (F.col("n_before") + F.col("n")).alias("_stop"),
        (F.col("_p") + 1).alias("_i")), "client-targets")

    patients = cohort.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_stays"))
    # sort value: 32 hex digits, a dash, the patient's own key
    order = patients.withColumn("_h", F.concat_ws("-", hash_hex(seed, "subject_id"),
                                                  F.col("subject_id").cast("string")))
    laid = running_totals(order, "_h", {"n_stays": F.col("n_stays")})
    at = store(laid.select(F.substr("_h", F.lit(34)).alias("_subject"), F.col("n_stays_before").alias("_at")), "client-line")
    # the client at a place is the last that starts at or before it: their number is a prefix sum along the line
    line = at.select("_at", F.lit(0).alias("_m")).union(targets.select("_at", F.lit(1)))
    upto = running_totals(line, "_at", {"_m": F.col("_m")}).select("_at", (F.col("_m_before") + F.col("_m")).alias("_i"))
    placed = (at.join(upto, "_at").join(targets.select("_i", "_stop", "client"), "_i")
              .where(F.col("_at") < F.col("_stop")).select("_subject", "client"))
    keyed = cohort.withColumn("_subject", F.col("subject_id").cast("string"))
    return salted_join(keyed, placed, ["_subject"], ["stay_id"]).drop("_subject")


def dirichlet_shares(labels: Sequence[int], n_clients: int, alpha: float,
                     seed: int = 42) -> list[tuple[int, int, float]]:
    """(label, client, cumulative share) drawn on the driver: labels x clients numbers."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for label in labels:
        cuts = np.cumsum(rng.dirichlet([alpha] * n_clients))
        out += [(int(label), i, float(c)) for i, c in enumerate(cuts)]
    return out


def dirichlet(cohort: DataFrame, shares: Sequence[tuple[int, int, float]], label: str = "label",
              key: str = "stay_id", seed: int = 42) -> DataFrame:
    """Label-skewed clients: the shuffled rows of each label are cut at given shares."""
    ranked = hash_rank(cohort, [key], seed, [label], "_rank", "_n")
    last = {y: max(i for z, i, _ in shares if z == y) for y, _, _ in shares}
    inner = [(int(y), float(c)) for y, i, c in shares if i < last[y]]
    cuts = cohort.sparkSession.createDataFrame(inner, "_y int, _c double")     # labels x clients rows
    sizes = ranked.groupBy(F.col(label).cast("int").alias("_y")).agg(F.first("_n").alias("_n"))
    marks = cuts.join(sizes, "_y").select("_y", F.floor(F.col("_c") * F.col("_n")).alias("_at"), F.lit(1).alias("_m"))
    own = ranked.withColumn("_y", F.col(label).cast("int")).withColumn("_at", F.col("_rank").cast("long"))
    # the number of cuts at or before a rank is a prefix sum along the ranks of a label
    line = own.select("_y", "_at", F.lit(0).alias("_m")).union(marks)
    upto = (running_totals(line, "_at", {"_m": F.col("_m")}, ["_y"])
            .select("_y", "_at", (F.col("_m_before") + F.col("_m")).alias("_i")))
    client = F.when(F.col("_y").isin([int(y) for y, _, _ in shares]),
                    F.concat(F.lit("client_"), F.col("_i").cast("string")))
    return own.join(upto, ["_y", "_at"], "left").withColumn("client", client).select(*cohort.columns, "client")


# --- splits -----------------------------------------------------------------------

def _split_at(rank: Column, n_test: Column, n_val: Column) -> Column:
    return (F.when(rank < n_test, "test").when(rank < n_test + n_val, "val").otherwise("train"))


def grouped_split(assigned: DataFrame, test: float = 0.15, val: float = 0.15, seed: int = 42,
                  group: str = "subject_id", label: str = "label", key: str = "stay_id") -> DataFrame:
    """Train/val/test by patient inside each client, stratified by any-positive.

    All stays of a patient land in one split of a client. Sizes are rounded half
    to even per (client, stratum).
    """
    patients = assigned.groupBy("client", group).agg(F.max(label).alias("_any"))
    ranked = hash_rank(patients, [group], seed, ["client", "_any"], "_rank", "_n")
    n_test = half_even(F.col("_n") * F.lit(test))
    n_val = half_even(F.col("_n") * F.lit(val))
    placed = ranked.select("client", group, _split_at(F.col("_rank"), n_test, n_val).alias("split"))
    return salted_join(assigned, placed, ["client", group], [key])


def row_split(assigned: DataFrame, test: float = 0.15, val: float = 0.15, seed: int = 42,
              key: str = "stay_id") -> DataFrame:
    """Split single rows of each client; sizes rounded down. Patients may straddle splits."""
    ranked = hash_rank(assigned, [key], seed, ["client"], "_rank", "_n")
    n_test = F.floor(F.col("_n") * F.lit(test))
    n_val = F.floor(F.col("_n") * F.lit(val))
    return (ranked.withColumn("split", _split_at(F.col("_rank"), n_test, n_val))
            .drop("_rank", "_n"))


def pooled(split: DataFrame, part: str) -> DataFrame:
    """One split of all clients together."""
    return split.where(F.col("split") == part)


# --- description --------------------------------------------------------------------

def heterogeneity(assigned: DataFrame, cohort: DataFrame, label: str = "label") -> DataFrame:
    """Per client: size, outcome rate, mean age, median stay, divergence from the pool."""
    rate = cohort.agg(F.avg(label).alias("r")).scalar()
    stats = assigned.groupBy("client").agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("_rate"), F.avg("age").alias("mean_age"))
    medians = exact_quantiles(assigned, "los_hours", {"median_los_h": 0.5}, ["client"])
    return (stats.withColumn("_pool", rate).join(medians, "client", "left").select(
        "client", "n", (F.col("_rate") * 100).alias("outcome_pct"), "mean_age", "median_los_h",
        js_divergence(F.col("_rate"), F.col("_pool")).alias("js_divergence")))


def rate_spread(report: DataFrame) -> DataFrame:
    return report.agg(
        F.min("outcome_pct").alias("min_pct"), F.max("outcome_pct").alias("max_pct"),
        (F.max("outcome_pct") - F.min("outcome_pct")).alias("range_pp"),
        F.avg("js_divergence").alias("mean_js"), F.sum("n").alias("n_rows"))


def client_totals(split: DataFrame, label: str = "label") -> DataFrame:
    """Rows, events and rate by client and split, with client and overall totals."""
    return split.rollup("client", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("events"), F.avg(label).alias("rate"))


def source_summary(cohort: DataFrame, top: int = 20) -> DataFrame:
    """The largest (dataset, unit) groups with their outcome rate."""
    return (cohort.groupBy("dataset", "unit")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))
            .orderBy(F.desc("n"), "dataset", "unit").limit(top))


def table_one(assigned: DataFrame, medians: Mapping[str, int], shares: Mapping[str, Column],
              label: str = "label") -> DataFrame:
    """Baseline table: overall, by outcome, by client.

    ``medians`` maps a numeric column to the decimals shown as 'median (q1-q3)';
    ``shares`` maps a name to a condition shown as 'n (%)'. A row is copied to
    its three groups before aggregating; quartiles are exact.
    """
    groups = assigned.withColumn("grp", F.explode(F.array(
        F.lit("Overall"),
        F.when(F.col(label) == 1, "Outcome: yes").otherwise("Outcome: no"),
        F.concat(F.lit("Client: "), F.col("client")))))
    out = groups.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(cond.cast("int")).alias(f"_{k}") for k, cond in shares.items()])
    cols = [F.col("grp"), F.col("n")]
    if medians:
        # all columns at once: a row for each (column, value), quartiles per group and column in one pass
        values = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in medians])
        q = exact_quantiles(groups.select("grp", F.inline(values)), "_x", {"_1": .25, "_2": .5, "_3": .75}, ["grp", "_column"])
        out = out.join(q.groupBy("grp").agg(*[F.max(F.when(F.col("_column") == c, F.col(f"_{i}"))).alias(f"_{c}{i}")
                                              for c in medians for i in (1, 2, 3)]), "grp", "left")
    for c, places in medians.items():
        f = f"%.{places}f"
        cols.append(F.format_string(f"{f} ({f}-{f})", *[F.bround(f"_{c}{i}", places)
                                                        for i in (2, 1, 3)]).alias(c))
    for k in shares:
        pct = F.col(f"_{k}") * 100.0 / F.col("n")
        cols.append(F.format_string("%d (%.1f)", F.col(f"_{k}"), pct).alias(k))
    return out.select(*cols)


# --- normalising ----------------------------------------------------------------------

def fit_normaliser(rows: DataFrame, by: Sequence[str] = ("client", "feature"),
                   value: str = "value", nulls: str = "impute") -> DataFrame:
    """Median, mean and spread per (client, feature); fit on train rows only.

    ``nulls='impute'``: missing values count as the median (0 where nothing was
    ever seen) in mean and spread. ``'ignore'``: they are skipped. ``'poison'``: any
    missing value makes mean 0 and spread null, as plain array statistics would.
    The spread is the population SD plus 1e-6. Mean and spread after imputation
    follow from the counts and moments of the observed values, so the rows are
    read once and never rewritten.
    """
    by = list(by)
    v = F.col(value)
    moments = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_seen"),
        F.avg(v).alias("_m"), F.var_pop(v).alias("_v"))
    med = exact_quantiles(rows, value, {"_med": 0.5}, by)
    s = moments.join(med, by, "left").withColumn("median", F.coalesce("_med", F.lit(0.0)))
    n, k = F.col("n_rows"), F.col("n_seen")
    m, var = F.coalesce("_m", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))
    if nulls == "impute":
        mean = (m * k + F.col("median") * (n - k)) / n
        spread = F.sqrt((k * (var + (m - mean) * (m - mean))
                         + (n - k) * (F.col("median") - mean) * (F.col("median") - mean)) / n)
    elif nulls == "ignore":
        mean, spread = m, F.sqrt(var)
    elif nulls == "poison":
        mean = F.when(k < n, F.lit(0.0)).otherwise(m)
        spread = F.when(k < n, F.lit(None).cast("double")).otherwise(F.sqrt(var))
    else:
        raise ValueError(f"nulls must be impute, ignore or poison, not {nulls!r}")
    return s.select(*by, "n_rows", "n_seen", "median", mean.alias("mean"),
                    (spread + F.lit(1e-6)).alias("sd"))


def apply_normaliser(rows: DataFrame, stats: DataFrame, by: Sequence[str] = ("client", "feature"),
                     value: str = "value", impute: bool = True) -> DataFrame:
    """z-scores with a client's own statistics.

    ``impute``: a missing value becomes the median first. Otherwise it becomes 0
    after scaling (static columns).
    """
    by = list(by)
    joined = lookup_join(rows, stats.select(*by, "median", "mean", "sd"), by, [value], "left")
    x = F.coalesce(F.col(value), F.col("median")) if impute else F.col(value)
    z = (x - F.col("mean")) / F.col("sd")
    return (joined.withColumn("z", z if impute else F.coalesce(z, F.lit(0.0)))
            .drop("median", "mean", "sd"))


def average_normaliser(stats: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean of the clients' statistics: what a model trained on them has seen."""
    return stats.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("median", "mean", "sd")])

"""Order statistics without a global sort in one task.

A window without a partition, or over one hot key, runs in a single task. These
operators first collapse equal values, cut the remaining distinct values into
buckets of similar size, sum the buckets (a few hundred rows per group), and
finish inside the buckets. Ties always share a bucket, so results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_hex

_SAMPLES_PER_BUCKET = 16


def bucket_count(df: DataFrame, n_buckets: int | None = None) -> int:
    """Buckets follow the session's shuffle width, which follows the data; 32 at least."""
    if n_buckets is None:
        n_buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, n_buckets)


def position_in(cuts: Column, value: Column) -> Column:
    """Number of entries of the ascending array ``cuts`` that are <= value, as one expression.

    Interpreted per row; for results that callers may filter on. See ``with_position``.
    """
    # as many halving steps as the array needs
    deepest = F.floor(F.log2(F.greatest(F.size(cuts), F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(deepest, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value),
            at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def with_position(df: DataFrame, name: str, cuts: Column, value: Column, depth: int) -> DataFrame:
    """Add ``name``: how many entries of the ascending array ``cuts`` are <= value.

    A binary search unrolled into ``depth`` projections, enough for 2**depth - 1
    entries. Each one is a plain generated comparison; a higher-order function would
    be interpreted for every row. The result is never null: as a join key a nullable
    position would bring a filter that Spark moves below the aggregation, where the
    search would run for every raw row. For positions that end in a grouping or a join
    only: a filter on them would be moved through the projections, doubling each time.
    """
    df = df.withColumn("_cuts", cuts).withColumn("_v", value).withColumn(name, F.lit(0))
    at = F.col(name)
    for step in (2 ** i for i in reversed(range(depth))):
        passed = F.get("_cuts", at + F.lit(step - 1)) <= F.col("_v")
        df = df.withColumn(name, at + F.when(F.coalesce(passed, F.lit(False)), step).otherwise(0))
    return df.drop("_cuts", "_v")


def balanced_cuts(flat: DataFrame, value: str, by: Sequence[str], sums: Sequence[str],
                  n_buckets: int) -> Column:
    """Ascending cut values as a scalar subquery.

    The cuts come from the (group, value) rows with the smallest hashes: a uniform
    sample that is the same in every evaluation, bounded by n_buckets * 16 rows. It
    only steers the balance of the buckets; every row is still processed. The sums
    ride along unused so that this branch needs exactly the shuffle of the main
    branch, which Spark then runs once for both.
    """
    sample = (flat.select(F.col(value).alias("_v"), *by, *sums)
              .orderBy(F.xxhash64(*by, "_v"), "_v", *by).limit(n_buckets * _SAMPLES_PER_BUCKET))
    ordered = F.array_sort(F.collect_list(F.struct("_v", *sums)))
    every = F.filter(ordered, lambda _, i: (i + 1) % _SAMPLES_PER_BUCKET == 0)
    return sample.agg(F.transform(every, lambda r: r["_v"]).alias("c")).scalar()


def running_totals(df: DataFrame, value: str, sums: Mapping[str, Column],
                   by: Sequence[str] = (), descending: bool = False,
                   n_buckets: int | None = None, index: str | None = None) -> DataFrame:
    """Prefix sums along ``value`` inside each group.

    One row per (by, value) with, for every name in ``sums``: ``name`` (the sum at
    this value), ``name_before`` (over all values ordered strictly before it) and
    ``name_total`` (over the group). ``index`` adds the 0-based position of the value
    among the group's distinct values, and their number as ``<index>_total``. Rows whose value or group is null have no
    place in an order and take no part.
    """
    by = list(by)
    names = list(sums)
    n = bucket_count(df, n_buckets)
    for c in [*by, value]:
        df = df.where(F.col(c).isNotNull())
    flat = df.groupBy(*by, value).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    if index is not None:
        flat = flat.withColumn("_one", F.lit(1).cast("long"))
        names.append("_one")
    cut = with_position(flat, "_b", balanced_cuts(flat, value, by, list(sums), n), F.col(value), n.bit_length())
    if descending:
        cut = cut.withColumn("_b", -F.col("_b"))

    per_bucket = cut.groupBy(*by, "_b").agg(*[F.sum(k).alias(k) for k in names])
    # at most n rows per group from here on
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "_b",
        *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}_off") for k in names],
        *[F.sum(k).over(group).alias(f"{k}_total") for k in names])

    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (Window.partitionBy(*by, "_b").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    done = cut.join(offsets, [*by, "_b"])
    before = {k: F.col(f"_{k}_off") + F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in names}
    cols = [c for k in sums for c in (F.col(k), before[k].alias(f"{k}_before"), F.col(f"{k}_total"))]
    if index is not None:
        cols += [before["_one"].alias(index), F.col("_one_total").alias(f"{index}_total")]
    return done.select(*by, value, *cols)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float] | Mapping[str, float],
                    by: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles, exact, one row per group.

    ``percentile`` keeps every distinct value of a group in one task's memory;
    here the two order statistics around each quantile are picked out of the
    prefix counts instead. ``probs`` may map output names to probabilities.
    """
    if not isinstance(probs, Mapping):
        probs = {f"q{i}": p for i, p in enumerate(probs)}
    counts = running_totals(df, value, {"_n": F.lit(1)}, by, n_buckets=n_buckets)
    last = (F.col("_n_total") - 1).cast("double")
    first, stop = F.col("_n_before"), F.col("_n_before") + F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < stop), F.col(value).cast("double")))

    picks = []
    for i, p in enumerate(probs.values()):
        where = last * F.lit(float(p))
        picks += [at(F.floor(where)).alias(f"_lo{i}"), at(F.ceil(where)).alias(f"_hi{i}")]
    picked = counts.groupBy(*by).agg(F.max("_n_total").alias("_n_total"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        where = last * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (where - F.floor(where))).alias(name))
    return picked.select(*by, *out)


def midranks(df: DataFrame, value: str, by: Sequence[str] = (),
             sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Average rank (1-based) of every distinct value, with its tie count ``n``."""
    rt = running_totals(df, value, {"n": F.lit(1), **(sums or {})}, by)
    return rt.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str = 42,
              by: Sequence[str] = (), name: str = "rank", total: str = "n",
              digits: int | None = None) -> DataFrame:
    """0-based position of every row in a seeded shuffle of its group.

    The order is md5(seed-key...). The leading hex digits of a hash are uniform,
    so they serve as buckets and even one huge group is ranked by 16**digits
    tasks; ``digits`` grows with the session's shuffle width. ``keys`` must be unique
    inside a group.
    """
    by = list(by)
    if digits is None:
        digits = max(3, len(f"{4 * bucket_count(df):x}"))
    hashed = (df.withColumn("_h", hash_hex(seed, *keys))
              .withColumn("_p", F.substring("_h", 1, digits)))
    sizes = hashed.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_c").over(group).alias(total))
    inside = Window.partitionBy(*by, "_p").orderBy("_h", *keys)
    return (hashed.join(offsets, [*by, "_p"], "left")
            .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
            .drop("_h", "_p", "_off"))

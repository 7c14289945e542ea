"""Join helpers: measured salts, lookups by size, window joins, history totals, prefix matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.functions.scalars import hours_between, in_window, plus_hours
from sitewise.session import store

MAX_RULE_ROWS = 10_000
#: Most keys that can be heavy, and ranges of time a heavy key is cut into.
MAX_HEAVY, HEAVY_RANGES = 10_000, 64


def rule_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A code table given in the program; broadcast only because its size is known."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= MAX_RULE_ROWS else df


def _key_hash(df: DataFrame, on: Sequence[str], like: DataFrame | None = None) -> Column:
    """64 bits of a key; ``like`` gives the types in which both sides of a join hash it."""
    kinds = (like if like is not None else df).schema
    return F.xxhash64(*[F.col(c).try_cast(kinds[c].dataType) if like is not None else F.col(c) for c in on])


def heavy_keys(rows: DataFrame, on: Sequence[str], parts: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """(_hash, _shares) of the keys with more rows than one of ``parts`` equal shares (the shuffle width).

    ``_hash`` is the hash of ``on``, ``_shares`` the number of shares its rows fill, 2 at least. A frequent-items
    sketch of fixed size measures them in one pass; there are at most ``parts`` such keys, MAX_HEAVY in all.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    most = max(1, min(parts, MAX_HEAVY))
    top = F.call_function("approx_top_k", F.col("_hash"), F.lit(most), F.lit(min(1_000_000, max(1024, 16 * most))))
    sketch = rows.select(_key_hash(rows, on, like).alias("_hash")).agg(top.alias("_top"), F.count(F.lit(1)).alias("_n"))
    share = F.ceil(F.col("_item.count") * F.lit(parts) / F.col("_n")).cast("int")
    return (sketch.select(F.explode("_top").alias("_item"), "_n")
            .select(F.col("_item.item").alias("_hash"), share.alias("_shares")).where(F.col("_shares") > 1))


def salted_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", measure: DataFrame | None = None) -> DataFrame:
    """Join a large table to a narrower one, keys of any skew.

    Keys that hold more than a share of the facts are measured first (``heavy_keys``): their facts are spread
    over as many sub-keys as they fill shares, by a hash of ``spread``, and only their rows of ``dim`` are
    repeated; all other keys are sent once. The hash is a function of the row, so a re-run task sends the same
    rows. Where ``dim`` turns out small, adaptive execution still replaces the shuffle by a broadcast.
    ``measure`` may name rows with the same columns ``on`` that are cheaper to read than the facts made from them.
    """
    # one row per heavy key, at most MAX_HEAVY
    heavy = F.broadcast(heavy_keys(fact if measure is None else measure, on, like=fact))
    parts = F.coalesce("_shares", F.lit(1))
    f = (fact.withColumn("_hash", _key_hash(fact, on)).join(heavy, "_hash", "left")
         .withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_hash", "_shares"))
    d = (dim.withColumn("_hash", _key_hash(dim, on, fact)).join(heavy, "_hash", "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hash", "_shares"))
    return f.join(d, [*on, "_salt"], how).drop("_salt")


def join_by_size(rows: DataFrame, known: DataFrame, on: Sequence[str], spread: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Join rows to a stored table. Spark knows its size in bytes: below the session's broadcast limit it is broadcast
    and a key with most of the rows is never gathered; beyond it the join is salted where measured."""
    size = int(str(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = int(rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return rows.join(known, list(on), how) if size <= limit else salted_join(rows, known, on, spread, how)


def lookup_join(rows: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join rows to an aggregated table (per site, per class), written once so that its size is known."""
    return join_by_size(rows, store(dim, "lookup"), on, spread, how)


def _bucket(ts: Column, hours: int) -> Column:
    """Number of the stretch of ``hours`` that a moment is in."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(seconds / F.lit(hours * 3600))


def window_join(events: DataFrame, cohort: DataFrame, on: str, time: str, hours: int,
                start: str = "intime", entity: str = "stay_id", keep: Sequence[str] = ()) -> DataFrame:
    """Events that fall in [start, start + hours) of their entity, with ``hours_in``.

    ``on`` may be any key shared by both sides. When the cohort is not unique on it (several entities per
    admission, say) every matching entity gets the event. Both sides are cut into stretches of the window's
    length: a window lies in two of them at most, so an event meets only the entities whose windows are near
    it in time, not all that share its key. A stretch with very many events is spread by measured salts.
    """
    from_, to = _bucket(F.col(start), hours), _bucket(plus_hours(start, hours), hours)
    dim = cohort.select(*{on, entity}, start, F.explode(F.sequence(from_, to)).alias("_stretch"))
    cut = events.select(on, time, *[c for c in keep if c not in (on, time)], _bucket(F.col(time), hours).alias("_stretch"))
    joined = salted_join(cut, dim, [on, "_stretch"], [time, *keep])
    return (joined.where(in_window(time, start, hours))
            .select(entity, *keep, hours_between(start, time).alias("hours_in")))


def history_totals(history: DataFrame, probes: DataFrame, by: str, ended: str, at: str,
                   sums: Mapping[str, Column], own: str, probe_id: str) -> DataFrame:
    """For every probe: sums over the history of ``by`` that ended strictly before it.

    History rows of the probe's own ``own`` key do not count. The pairs of the inequality join are never built.
    History and probes form one line of events along time per ``by`` key, on which a probe reads the total
    before it; a second line per (``by``, ``own``) gives what its own key contributed, with a minus. Both are
    the same shuffle and the same sort. Keys with a large share of all events are measured, cut into ranges of
    time, and each range begins with the carried totals of the earlier ones.
    """
    names = list(sums)
    hist = store(history.withColumnRenamed(ended, "_t").where(F.col(by).isNotNull() & F.col("_t").isNotNull())
                 .groupBy(by, own, "_t").agg(*[F.sum(c).cast("long").alias(k) for k, c in sums.items()]), "history")
    marks = probes.select(by, F.col(at).alias("_t"), F.col(own).cast(hist.schema[own].dataType).alias(own), F.col(probe_id).alias("_probe"),
                          *[F.lit(0).cast("long").alias(k) for k in names])
    both = hist.select(by, "_t", own, F.lit(None).cast(probes.schema[probe_id].dataType).alias("_probe"), *names).unionByName(marks)
    # every event is on the line of its key; with an own key, also on the line of that
    none = F.lit(None).cast(hist.schema[own].dataType)
    lines = F.array(F.struct(F.lit(1).alias("sign"), none.alias("own")), F.struct(F.lit(-1).alias("sign"), F.col(own).alias("own")))
    line = (both.withColumn("_l", F.explode(F.when(F.col(own).isNull(), F.slice(lines, 1, 1)).otherwise(lines)))
            .select(by, "_t", "_probe", *names, F.col("_l.sign").alias("_sign"), F.col("_l.own").alias("_own"), F.lit(0).alias("_r")))
    key = [by, "_sign", "_own"]
    heavy = store(heavy_keys(line, key), "history-heavy")
    carried = None
    if not heavy.isEmpty():
        line, carried = _cut_heavy(line, heavy, key, names)
    # at equal times probes come first: only what ended before them counts
    order = Window.partitionBy(*key, "_r").orderBy("_t", F.col("_probe").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    reached = line.select(*key, "_r", "_probe", *[F.coalesce(F.sum(k).over(order), F.lit(0)).alias(k) for k in names]).where(
        F.col("_probe").isNotNull())
    if carried is not None:
        same = [reached[c].eqNullSafe(carried[c]) for c in [*key, "_r"]]
        reached = reached.join(carried, same, "left").select(
            reached["_probe"], reached["_sign"], *[(reached[k] + F.coalesce(carried[f"_{k}"], F.lit(0))).alias(k) for k in names])
    return reached.groupBy(F.col("_probe").alias(probe_id)).agg(*[F.sum(F.col("_sign") * F.col(k)).cast("long").alias(k) for k in names])


def _cut_heavy(line: DataFrame, heavy: DataFrame, key: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(line with ranges ``_r`` of the heavy keys, carried totals of each such range)."""
    hashed = line.drop("_r").withColumn("_hash", _key_hash(line, key))
    shares = [i / HEAVY_RANGES for i in range(1, HEAVY_RANGES)]
    cuts = store(hashed.join(F.broadcast(heavy), "_hash").groupBy("_hash").agg(
        F.percentile_approx("_t", shares).alias("_cuts")), "history-cuts")           # a row per heavy key
    ranged = (hashed.join(F.broadcast(cuts), "_hash", "left")
              .withColumn("_r", F.when(F.col("_cuts").isNull() | F.col("_t").isNull(), 0).otherwise(
                  F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))))))
    totals = ranged.where(F.col("_cuts").isNotNull()).groupBy(*key, "_r").agg(*[F.sum(k).alias(k) for k in names])
    earlier = Window.partitionBy(*key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)     # HEAVY_RANGES rows
    carried = totals.select(*key, "_r", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in names])
    return ranged.drop("_hash", "_cuts"), store(carried, "history-carried")


def prefix_hits(codes: DataFrame, rules: Sequence[tuple[str, int, int, str]], code: str = "icd_code",
                version: str = "icd_version", keep: Sequence[str] = ("stay_id",)) -> DataFrame:
    """Rows x conditions whose version-specific prefix starts the code.

    ``rules`` are (condition, weight, version, prefix). Every code is cut to the
    few prefix lengths that occur, which turns "starts with any of" into an equal
    join against a broadcast code table: no shuffle, no nested loop.
    """
    lengths = sorted({len(r[3]) for r in rules})
    table = rule_frame(codes.sparkSession, rules,
                       "condition string, weight int, _version int, _prefix string")
    clean = F.upper(F.trim(F.col(code)))
    cut = codes.select(
        *keep, F.col(version).cast("int").alias("_version"),
        F.explode(F.array_distinct(F.array(*[F.substring(clean, 1, k) for k in lengths])))
        .alias("_prefix"))
    return cut.join(table, ["_version", "_prefix"]).select(*keep, "condition", "weight")

"""Thousands of bootstrap replicates of a scored table in two passes over its rows.

A row's weight in a replicate is a Poisson draw from a hash of its key, so nothing is stored
per row and replicate: a task that holds a bucket of scores, from high to low, makes the
weights of a block of rows as a matrix (rows x replicates), sums it by distinct score and keeps
one number per replicate. What is stored is buckets x replicates. The first pass gives the
counts of every bucket; their running sums tell the second pass how many positives and
negatives each replicate has above a bucket, which average precision needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_long, poisson_cdf
from sitewise.operators.keyed import key_runs, output_schema
from sitewise.operators.ordered import balanced_cuts, bucket_count, with_position
from sitewise.session import store

#: Rows a bucket should have, rows of one score beyond which its weights are summed once, rows of one score that a task
#: sums, draws made at once (they stay in a core's cache).
BUCKET_ROWS, SUMMED_ROWS, HOT_ROWS, DRAWS = 50_000, 1 << 10, 1 << 16, 1 << 17
METRICS = ("auroc", "auprc", "f1", "sensitivity", "specificity", "ppv", "npv", "brier", "accuracy", "balanced_accuracy")
_SUMS = ("pos", "neg", "auc", "ap", "tp", "fp", "brier")
_PAIR = (("_pos", "binary"), ("_neg", "binary"))
#: The odd step between replicates and the multipliers of a 32-bit finaliser.
STEP, MIX_1, MIX_2 = 2654435769, 2246822507, 3266489909
#: Words from which on a draw is at least 1, 2, ...
POISSON_WORDS = tuple(c for c in (math.ceil(q * 2 ** 32) for q in poisson_cdf()) if c < 2 ** 32)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_2)
    x ^= x >> np.uint32(16)
    return x


def poisson_weights(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) draws (rows x replicates) from 60-bit hashes of the rows: 32 bits of a mixed hash, inverted."""
    steps = ((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)).astype(np.uint32)
    words = _mix((h & 0xFFFFFFFF).astype(np.uint32)[:, None] ^ steps)
    words ^= (h >> 32).astype(np.uint32)[:, None]
    words = _mix(words)
    out = np.zeros(words.shape, np.uint8)
    for cut in POISSON_WORDS:
        out += words >= np.uint32(cut)
    return out


class _Sweep:
    """Sums of one bucket, per replicate, as its distinct scores pass by from high to low."""

    def __init__(self, n_boot: int, threshold: float, tp: np.ndarray | None = None, fp: np.ndarray | None = None):
        self.threshold = threshold
        self.above = [np.zeros(n_boot) if x is None else x.copy() for x in (tp, fp)]
        self.sums = {k: np.zeros(n_boot) for k in _SUMS}
        self.waiting: tuple[float, np.ndarray, np.ndarray] | None = None       # a score that may go on

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """The next distinct scores with their weights (scores x replicates); the first may be the one before."""
        if self.waiting is not None:
            last, p, n = self.waiting
            if score[0] == last:
                pos[0] += p
                neg[0] += n
            else:
                score, pos, neg = np.r_[last, score], np.vstack([p, pos]), np.vstack([n, neg])
        self.waiting = (score[-1], pos[-1].copy(), neg[-1].copy())
        self._pass(score[:-1], pos[:-1], neg[:-1])

    def close(self) -> dict[str, np.ndarray]:
        if self.waiting is not None:
            score, pos, neg = self.waiting
            self.waiting = None
            self._pass(np.array([score]), pos[None], neg[None])
        return self.sums

    def _pass(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        if not len(score):
            return
        tp, fp = (a + np.cumsum(x, axis=0) for a, x in zip(self.above, (pos, neg), strict=True))
        s, hit = self.sums, score >= self.threshold
        s["ap"] += (pos * tp / np.maximum(tp + fp, 1)).sum(axis=0)
        s["auc"] += (neg * (tp - pos / 2)).sum(axis=0)
        s["pos"] += pos.sum(axis=0)
        s["neg"] += neg.sum(axis=0)
        s["tp"] += pos[hit].sum(axis=0)
        s["fp"] += neg[hit].sum(axis=0)
        s["brier"] += (1 - score) ** 2 @ pos + score ** 2 @ neg
        self.above = [tp[-1], fp[-1]]


def _weigh(score: np.ndarray, y: np.ndarray, h: np.ndarray, n_boot: int, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(distinct scores, positives, negatives) of rows ordered by score and outcome, some rows at a time."""
    every = np.arange(n_boot)
    for at in range(0, len(score), block):
        s, o = score[at:at + block], y[at:at + block]
        weights = poisson_weights(h[at:at + block], every)
        run = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
        sums = np.add.reduceat(weights, run, axis=0, dtype=np.float64)
        fresh = np.r_[True, s[run][1:] != s[run][:-1]]
        which = np.cumsum(fresh) - 1
        pos, neg = np.zeros((which[-1] + 1, n_boot)), np.zeros((which[-1] + 1, n_boot))
        pos[which[o[run] == 1]] = sums[o[run] == 1]
        np.add.at(neg, which[o[run] != 1], sums[o[run] != 1])
        yield s[run][fresh], pos, neg


def _vector(raw: bytes | None) -> np.ndarray | None:
    return None if raw is None else np.frombuffer(raw, float)


def _emit(schema: pa.Schema, keys: Sequence[str], key: tuple, vectors: dict[str, np.ndarray]) -> pa.RecordBatch:
    values = {**dict(zip(keys, key, strict=True)), **{k: v.tobytes() for k, v in vectors.items()}}
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _swept(n_boot: int, threshold: float, keys: Sequence[str], schema: pa.Schema, wanted: Sequence[str],
           from_offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweep the buckets of a partition. A bucket's row of offsets, if it has one, comes first; with ``from_offsets``,
    buckets without one are left out."""
    block = max(1, DRAWS // n_boot)

    def done(key: tuple, sweep: _Sweep) -> pa.RecordBatch:
        sums = sweep.close()
        return _emit(schema, keys, key, {k: sums[k] for k in wanted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep = None, None
        for key, goes_on, rows in key_runs(batches, keys):
            if not goes_on:
                if sweep is not None:
                    yield done(now, sweep)
                now, sweep = key, None if from_offsets else _Sweep(n_boot, threshold)
            kind = rows.column("_kind").to_numpy()
            score, y, h = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_p", "_y", "_h"))
            for at in np.flatnonzero(kind == 0).tolist():
                sweep = _Sweep(n_boot, threshold, *(_vector(rows.column(c)[at].as_py()) for c in ("_pos", "_neg")))
            if sweep is None:
                continue
            # single rows come in runs between summed scores
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for low, high in zip(edges, edges[1:], strict=False):
                if kind[low] == 1:
                    for part in _weigh(score[low:high], y[low:high], h[low:high], n_boot, block):
                        sweep.add(*part)
                elif kind[low] == 2:
                    for at in range(low, high):
                        pos, neg = (_vector(rows.column(c)[at].as_py()) for c in ("_pos", "_neg"))
                        sweep.add(score[at:at + 1], pos[None].copy(), neg[None].copy())
        if sweep is not None:
            yield done(now, sweep)

    return run


def _bucketed(pred: DataFrame, by: Sequence[str], p: str, y: str, key: str, seed: int) -> DataFrame:
    """Stored rows (by, _p, _y, _h, _b, _parts): score buckets from high (small _b) to low, few for a small group."""
    n = bucket_count(pred)
    rows = pred.select(*by, F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"), hash_long(seed, key).alias("_h"))
    for c in [*by, "_p", "_y"]:
        rows = rows.where(F.col(c).isNotNull())
    flat = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    cut = with_position(rows, "_at", balanced_cuts(flat, "_p", [], ["_n"], n), F.col("_p"), n.bit_length())
    sizes = rows.groupBy(*by).agg(F.least(F.lit(n), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS)).cast("int").alias("_parts"))
    # neighbouring cuts go together until a group has as many buckets as its size asks for
    return store(cut.join(sizes, list(by)).select(
        *by, "_p", "_y", "_h", "_parts", F.floor((F.lit(n) - F.col("_at")) * F.col("_parts") / (n + 1)).cast("int").alias("_b")),
        "replicate-rows")


def _items(rows: DataFrame, by: Sequence[str], n_boot: int) -> DataFrame:
    """What sweeps read: rows one by one (_kind 1), and scores with many rows as summed weights (_kind 2).

    The weights of such a score are made once for both sweeps, and stored as about one number a row at most. A score
    with very many rows is split over tasks by the hash of its rows, each of which adds up its share of the weights.
    """
    none = F.lit(None).cast("binary")
    single = rows.select(*by, "_b", "_parts", F.lit(1).alias("_kind"), "_p", "_y", "_h", none.alias("_pos"), none.alias("_neg"))
    hot = store(rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min(HOT_ROWS, max(SUMMED_ROWS, n_boot))), "replicate-hot")
    if hot.isEmpty():
        return single
    at = [*by, "_p"]
    same = [rows[c] == hot[c] for c in at]
    few = rows.join(hot, same, "left_anti")
    share = F.pmod(F.xxhash64("_h"), F.ceil(hot["_n"] / HOT_ROWS))
    many = rows.join(hot, same).select(*[rows[c] for c in [*by, "_b", "_parts", "_p", "_y", "_h"]], share.alias("_share"))
    keys = [*by, "_b", "_parts", "_p", "_share"]
    schema, text = output_schema(many, keys, _PAIR)
    block, every = max(1, DRAWS // n_boot), np.arange(n_boot)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for key, goes_on, part in key_runs(batches, keys):
            if not goes_on:
                if sums is not None:
                    yield _emit(schema, keys, now, sums)
                now, sums = key, {k: np.zeros(n_boot) for k in ("_pos", "_neg")}
            y, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_h"))
            for name, own in (("_pos", h[y == 1]), ("_neg", h[y != 1])):
                for at in range(0, len(own), block):
                    sums[name] += poisson_weights(own[at:at + block], every).sum(axis=0, dtype=np.uint32)
        if sums is not None:
            yield _emit(schema, keys, now, sums)

    # as many tasks as the session has: the work is in the draws, not in the bytes that adaptive execution sees
    summed = many.repartition(bucket_count(rows), *keys).sortWithinPartitions(*keys).mapInArrow(add, text)
    summed = store(summed, "replicate-summed").select(*by, "_b", "_parts", F.lit(2).alias("_kind"), "_p", F.lit(None).cast("int").alias("_y"),
                                                      F.lit(None).cast("long").alias("_h"), "_pos", "_neg")
    return few.select(*by, "_b", "_parts", F.lit(1).alias("_kind"), "_p", "_y", "_h", none.alias("_pos"), none.alias("_neg")).unionByName(summed)


def _in_order(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every bucket in one task: its offsets, then its scores from high to low."""
    filled = items.withColumn("_y", F.coalesce("_y", F.lit(0))).withColumn("_h", F.coalesce("_h", F.lit(0)))
    return (filled.repartition(bucket_count(items), *keys)
            .sortWithinPartitions(*keys, (F.col("_kind") > 0), F.desc("_p"), "_kind", "_y"))


def _division(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b > 0, a / np.where(b > 0, b, 1), np.nan)


def _metrics(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The metrics of each replicate from its sums; nan where one is not defined."""
    tp, fp, pos, neg = s["tp"], s["fp"], s["pos"], s["neg"]
    fn, tn = pos - tp, neg - fp
    sens, spec = _division(tp, pos), _division(tn, neg)
    both = np.where(np.isnan(sens), spec, np.where(np.isnan(spec), sens, (sens + spec) / 2))
    f1 = np.where(pos + neg > 0, np.nan_to_num(_division(2 * tp, tp + fp + pos)), np.nan)
    return {"auroc": _division(s["auc"], pos * neg), "auprc": np.where(neg > 0, _division(s["ap"], pos), np.nan), "f1": f1,
            "sensitivity": sens, "specificity": spec, "ppv": _division(tp, tp + fp), "npv": _division(tn, tn + fn),
            "brier": _division(s["brier"], pos + neg), "accuracy": _division(tp + tn, pos + neg), "balanced_accuracy": both}


def replicate_matrix(pred: DataFrame, threshold: float, n_boot: int, seed: int = 0, key: str = "id", p: str = "p",
                     y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by, b, METRICS) of ``n_boot`` Poisson(1) replicates: the draw of a row is the same in every group it is in.

    Rows without a score, an outcome or a group take no part. A metric that a replicate leaves undefined is null.
    """
    whole = not by
    if whole:
        pred = pred.withColumn("_all", F.lit(0))
    by = ["_all"] if whole else list(by)
    rows = _bucketed(pred, by, p, y, key, seed)
    items = _items(rows, by, n_boot)
    bucket = [*by, "_b"]
    schema, text = output_schema(rows, bucket, [(k, "binary") for k in _SUMS])
    first = store(_in_order(items, bucket).mapInArrow(_swept(n_boot, threshold, bucket, schema, _SUMS, False), text), "replicate-sums")

    off_schema, off_text = output_schema(rows, bucket, _PAIR)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every bucket but a group's first: the positives and negatives above it."""
        total: dict[str, np.ndarray] = {}
        for key, goes_on, part in key_runs(batches, by):
            if not goes_on:
                total = {}
            for row in part.to_pylist():
                if total:
                    yield _emit(off_schema, bucket, (*key, row["_b"]), total)
                total = {f"_{k}": total.get(f"_{k}", 0) + _vector(row[k]) for k in ("pos", "neg")}

    offsets = first.select(*bucket, "pos", "neg").repartition(*by).sortWithinPartitions(*bucket).mapInArrow(above, off_text)
    heads = offsets.select(*bucket, F.lit(0).alias("_parts"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_p"),
                           F.lit(None).cast("int").alias("_y"), F.lit(None).cast("long").alias("_h"), "_pos", "_neg")
    ap_schema, ap_text = output_schema(rows, bucket, [("ap", "binary")])
    second = (_in_order(items.where(F.col("_parts") > 1).unionByName(heads), bucket)
              .mapInArrow(_swept(n_boot, threshold, bucket, ap_schema, ("ap",), True), ap_text)
              .select(*[F.col(c).alias(f"_{c}") for c in bucket], F.col("ap").alias("_ap")))
    whole_sums = first.join(second, [F.col(c) == F.col(f"_{c}") for c in bucket], "left").select(*bucket, *_SUMS, "_ap")

    out_schema, out_text = output_schema(rows, by, [("b", "int"), *((m, "double") for m in METRICS)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(key: tuple, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
            columns = {"b": np.arange(n_boot, dtype=np.int32), **_metrics(sums)}
            values = dict(zip(by, key, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([values[f.name]] * n_boot, f.type) if f.name in values else pa.array(columns[f.name], f.type, from_pandas=True)
                 for f in out_schema], schema=out_schema)

        now, sums = None, None
        for key, goes_on, part in key_runs(batches, by):
            if not goes_on:
                if sums is not None:
                    yield rows_of(now, sums)
                now, sums = key, {k: np.zeros(n_boot) for k in _SUMS}
            for row in part.to_pylist():
                own = {k: _vector(row[k]) for k in _SUMS}
                own["auc"] = own["auc"] + own["neg"] * sums["pos"]           # the positives above the bucket
                if row["_ap"] is not None:
                    own["ap"] = _vector(row["_ap"])
                sums = {k: sums[k] + own[k] for k in _SUMS}
        if sums is not None:
            yield rows_of(now, sums)

    found = whole_sums.repartition(*by).sortWithinPartitions(*bucket).mapInArrow(finish, out_text)
    return found.drop("_all") if whole else found


def draw_sql(source: str, n_boot: int, seed: int = 0, key: str = "id", columns: Sequence[str] = ("y", "p1")) -> str:
    """The same draws as SQL: common table expressions that end in ``bs`` (columns, b, w)."""
    kept = ", ".join(columns)

    def mixed(before: str) -> str:
        m = 4294967295
        steps = ["xor(x, x >> 16)", f"(x * {MIX_1}::UBIGINT) & {m}::UBIGINT", "xor(x, x >> 13)", f"(x * {MIX_2}::UBIGINT) & {m}::UBIGINT", "xor(x, x >> 16)"]
        out = before
        for s in steps:
            out = f"SELECT {kept}, b, hi, {s} AS x FROM ({out})"
        return out

    first = (f"SELECT {kept}, b, (h >> 32)::UBIGINT AS hi, xor((h & 4294967295)::UBIGINT, (((b + 1) * {STEP}) & 4294967295)::UBIGINT) AS x "
             f"FROM (SELECT {kept}, ('0x' || substring(md5('{seed}-' || {key}), 1, 15))::BIGINT AS h FROM {source}), range({n_boot}) r(b)")
    second = f"SELECT {kept}, b, hi, xor(x, hi) AS x FROM ({mixed(first)})"
    draws = " + ".join(f"(x >= {c})::INT" for c in POISSON_WORDS)
    return f"bs AS (SELECT {kept}, b, {draws} AS w FROM ({mixed(second)}))"

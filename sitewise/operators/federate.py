"""Parameter averaging and server steps as table jobs, drift, and a federated linear model.

Parameter tables are long: (client, pos, value) with pos a parameter index or name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_long, sigmoid
from sitewise.operators.joins import lookup_join
from sitewise.operators.keyed import key_runs, output_schema
from sitewise.operators.ordered import hash_rank
from sitewise.session import store


# --- weights ------------------------------------------------------------------------------

def client_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per client: class counts, the three averaging weights, the positive-class weight."""
    c = rows.groupBy("client").agg(F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
                                   F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
                                   F.count(F.lit(1)).alias("n"))
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return c.select("client", "n_pos", "n_neg", F.col("n").cast("double").alias("w_samples"),
                    F.greatest(p, F.lit(1.0)).alias("w_events"),
                    (2.0 * p * q / F.greatest(p + q, F.lit(1.0))).alias("w_effective"),
                    (q / F.greatest(p, F.lit(1.0))).alias("pos_weight"))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Row weights 1 / (size of the row's class inside its client)."""
    sizes = rows.groupBy("client", label).agg(F.count(F.lit(1)).alias("_n"))
    sized = lookup_join(rows, sizes, ["client", label], rows.columns)
    return sized.withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def balanced_resample(rows: DataFrame, key: str = "stay_id", label: str = "label", seed: int = 42) -> DataFrame:
    """As many draws as the client has rows, classes equally likely: row x ``times`` drawn.

    Draw k of a client first picks a class, then a position in the class's shuffled
    rows, both from hashes; draws are counted and joined back on the position.
    """
    ranked = hash_rank(rows, [key], f"{seed}pos", ["client", label], "_at", "_n")
    classes = ranked.groupBy("client").agg(F.array_sort(F.collect_set(F.struct(label, "_n"))).alias("_c"))
    drawn = lookup_join(rows.select("client", key), classes, ["client"], [key])
    head = hash_long(f"{seed}class", key)
    chosen = F.get("_c", F.pmod(head, F.size("_c")).cast("int"))
    place = hash_long(f"{seed}row", key)
    picks = drawn.select("client", chosen.alias("_k"), place.alias("_h")).select(
        "client", F.col(f"_k.{label}").alias(label), F.pmod(F.col("_h"), F.col("_k._n")).alias("_at"))
    times = picks.groupBy("client", label, "_at").agg(F.count(F.lit(1)).alias("times"))
    return ranked.drop("_n").join(times, ["client", label, "_at"]).drop("_at")


# --- averaging ----------------------------------------------------------------------------

def fedavg(params: DataFrame, weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Weighted mean of every parameter over the clients: (pos, value)."""
    w = F.col(weight)
    return (params.join(weights.select("client", weight), "client").groupBy("pos")
            .agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value")))


def fedavg_partial(params: DataFrame, weights: DataFrame, personal: Sequence[str],
                   weight: str = "weight") -> DataFrame:
    """Averaging that leaves parameters of the personal branches with their client.

    ``pos`` is a name; a branch 'head' covers 'head' and 'head.*'. Result:
    (client, pos, value, shared).
    """
    own = F.lit(False)
    for b in personal:
        own = own | (F.col("pos") == b) | F.col("pos").startswith(f"{b}.")
    avg = fedavg(params.where(~own), weights, weight).withColumnRenamed("value", "_global")
    return params.join(avg, "pos", "left").select(
        "client", "pos", F.coalesce("_global", "value").alias("value"),
        F.col("_global").isNotNull().cast("int").alias("shared"))


def fedadam_step(state: DataFrame, averaged: DataFrame, lr: float, b1: float = 0.9, b2: float = 0.99,
                 eps: float = 1e-3) -> DataFrame:
    """One adaptive server step. state: pos, value, m, v; averaged: pos, value."""
    delta = F.col("_avg") - F.col("value")
    m = b1 * F.col("m") + (1.0 - b1) * delta
    v = b2 * F.col("v") + (1.0 - b2) * delta * delta
    joined = state.join(averaged.select("pos", F.col("value").alias("_avg")), "pos")
    return joined.select("pos", (F.col("value") + lr * m / (F.sqrt(v) + eps)).alias("value"),
                         m.alias("m"), v.alias("v"))


def prox_gradient(local: DataFrame, shared: DataFrame, mu: float) -> DataFrame:
    """The proximal term mu * (local - global) per client and parameter."""
    return local.join(shared.select("pos", F.col("value").alias("_g")), "pos").select(
        "client", "pos", (mu * (F.col("value") - F.col("_g"))).alias("value"))


# --- drift --------------------------------------------------------------------------------

def client_updates(params: DataFrame, shared: DataFrame) -> DataFrame:
    return prox_gradient(params, shared, 1.0)


def update_norms(updates: DataFrame) -> DataFrame:
    return updates.groupBy("client").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def pairwise_cosine(updates: DataFrame, by: Sequence[str] = (), block: int = 1024,
                    chunks: int | None = None) -> DataFrame:
    """Cosine of every unordered pair of clients: (by, client_a, client_b, cosine).

    All clients hold the same parameters, numbered from 0. The vectors are cut into
    blocks of positions and the clients into ``chunks`` by hash; every pair of chunks is
    a key of its own for every block, so that pairs spread over the session's shuffle
    width even where vectors have one block. A pair's partial dot products are summed.
    One row per pair of clients is the result asked for; their number is the square of
    the sites, not of the rows.
    """
    by = list(by)
    if chunks is None:
        chunks = max(2, math.isqrt(2 * int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    parts = updates.groupBy(*by, "client", F.floor(F.col("pos") / block).alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    own = F.pmod(F.xxhash64("client"), F.lit(chunks)).cast("int")
    parts = (parts.withColumn("_c", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
             .withColumn("_i", F.least("_c", "_x")).withColumn("_j", F.greatest("_c", "_x")))
    keys = [*by, "_b", "_i", "_j"]
    a = parts.select(*keys, F.col("client").alias("client_a"), F.col("_c").alias("_ca"), F.col("_v").alias("_va"))
    b = parts.select(*keys, F.col("client").alias("client_b"), F.col("_c").alias("_cb"), F.col("_v").alias("_vb"))
    here = (F.least("_ca", "_cb") == F.col("_i")) & (F.greatest("_ca", "_cb") == F.col("_j"))
    product = F.aggregate(
        F.zip_with("_va", "_vb", lambda x, y: F.when(x["pos"] == y["pos"], x["value"] * y["value"])
                   .otherwise(F.raise_error(F.lit("clients hold different parameters")).cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x)
    dots = (a.join(b, keys).where(here & (F.col("client_a") < F.col("client_b")))
            .groupBy(*by, "client_a", "client_b").agg(F.sum(product).alias("_dot")))
    norms = updates.groupBy(*by, "client").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    na = norms.select(*by, F.col("client").alias("client_a"), F.col("norm").alias("_na"))
    nb = norms.select(*by, F.col("client").alias("client_b"), F.col("norm").alias("_nb"))
    scale = F.greatest(F.col("_na") * F.col("_nb"), F.lit(1e-12))
    return (dots.join(na, [*by, "client_a"]).join(nb, [*by, "client_b"])
            .select(*by, "client_a", "client_b", (F.col("_dot") / scale).alias("cosine")))


def mean_cosine(updates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_clients, mean_pairwise_cosine) without a pair: the squared norm of the sum of n unit vectors is n plus
    twice the sum of all cosines. A vector of zeros has cosine 0 with every other."""
    by = list(by)
    norms = updates.groupBy(*by, "client").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    unit = lookup_join(updates, norms, [*by, "client"], ["pos"]).withColumn("_u", F.coalesce(F.try_divide("value", "_norm"), F.lit(0.0)))
    summed = unit.groupBy(*by, "pos").agg(F.sum("_u").alias("_s")).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"))
    n = norms.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clients"), F.count_if(F.col("_norm") > 0).alias("_some"))
    both = n.join(summed, by) if by else n.withColumn("_ss", summed.select("_ss").scalar())
    pairs = F.col("n_clients") * (F.col("n_clients") - 1)
    return both.select(*by, "n_clients", F.try_divide(F.col("_ss") - F.col("_some"), pairs).alias("mean_pairwise_cosine"))


def agreement(updates: DataFrame, by: Sequence[str] = (), block: int = 1024, per_chunk: int = 512) -> DataFrame:
    """(by, mean_pairwise_cosine, min_pairwise_cosine, frac_negative_cosine) over all pairs of clients.

    Gram matrices by blocks: clients fall into chunks by hash, vectors into blocks of positions, and a task adds up
    the products of two chunks over the blocks as they stream by. It returns sums of its pairs, not the pairs. All
    clients hold the same positions.
    """
    by = list(by)
    width = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = store(updates.groupBy(*by, "client", F.floor(F.col("pos") / block).alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value")))).alias("_v")), "client-blocks")
    most = parts.groupBy(*by).agg(F.approx_count_distinct("client").alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = max(1, min(math.isqrt(2 * width), most), -(-most // per_chunk))
    own = F.pmod(F.xxhash64("client"), F.lit(chunks)).cast("int")
    sent = (parts.withColumn("_c", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            .select(*by, F.least("_c", "_x").alias("_i"), F.greatest("_c", "_x").alias("_j"), "_b", "_c",
                    F.col("client").cast("string").alias("_client"), F.transform("_v", lambda v: v["pos"]).alias("_pos"),
                    F.transform("_v", lambda v: v["value"]).alias("_value")))
    keys = [*by, "_i", "_j"]
    schema, text = output_schema(sent, by, [("_n", "long"), ("_sum", "double"), ("_least", "double"), ("_below", "long")])

    def lists(column: pa.ChunkedArray) -> np.ndarray:
        lengths = {len(v) for v in column}
        if len(lengths) > 1:
            raise ValueError("clients hold different parameters")
        return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(len(column), -1)

    def matrices(rows: pa.Table, chunk: int) -> tuple[list, np.ndarray]:
        some = rows.filter(pa.compute.equal(rows.column("_c"), chunk)).sort_by("_client")
        return some.column("_client").to_pylist(), lists(some.column("_value")) if len(some) else np.zeros((0, 0))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: tuple, state: dict) -> Iterator[pa.RecordBatch]:
            *group, i, j = key
            if state["dots"] is None:
                return
            cosine = state["dots"] / np.maximum(np.sqrt(np.outer(state["left"], state["right"])), 1e-12)
            values = cosine[np.triu_indices(len(cosine), 1)] if i == j else cosine.ravel()
            if len(values):
                found = [*group, len(values), values.sum(), values.min(), int((values < 0).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(found, schema, strict=True)], schema=schema)

        def add(key: tuple, rows: pa.Table, state: dict) -> None:
            *_, i, j = key
            places = lists(rows.column("_pos"))
            if (places != places[0]).any():
                raise ValueError("clients hold different parameters")
            names, left = matrices(rows, i)
            others, right = (names, left) if i == j else matrices(rows, j)
            if not names or not others:
                return
            if state["dots"] is None:
                state.update(dots=0.0, left=0.0, right=0.0, names=(names, others))
            elif state["names"] != (names, others):
                raise ValueError("clients hold different parameters")
            state["dots"] = state["dots"] + left @ right.T
            state["left"], state["right"] = state["left"] + (left ** 2).sum(axis=1), state["right"] + (right ** 2).sum(axis=1)

        now, state, held, at = None, {}, [], None
        for key, goes_on, rows in key_runs(batches, [*keys, "_b"]):
            *key, b = key
            if held and not goes_on:
                add(now, pa.Table.from_batches(held), state)
                held = []
            if tuple(key) != now:
                if now is not None:
                    yield from close(now, state)
                now, state = tuple(key), {"dots": None}
            held.append(rows)
        if held:
            add(now, pa.Table.from_batches(held), state)
        if now is not None:
            yield from close(now, state)

    found = sent.repartition(*keys).sortWithinPartitions(*keys, "_b").mapInArrow(gram, text)
    return found.groupBy(*by).agg((F.sum("_sum") / F.sum("_n")).alias("mean_pairwise_cosine"), F.min("_least").alias("min_pairwise_cosine"),
                                  (F.sum("_below") / F.sum("_n")).alias("frac_negative_cosine"))


def drift(updates: DataFrame, by: Sequence[str] = ("round",), pairs: bool = True) -> DataFrame:
    """Per round: update norms (mean, max, ratio) and agreement between clients.

    The smallest cosine and the share of negative ones need every pair of clients; without ``pairs`` only the mean
    cosine is given, at a cost that follows the number of parameters.
    """
    by = list(by)
    norms = updates.groupBy(*by, "client").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    n = norms.groupBy(*by).agg(
        F.avg("norm").alias("mean_update_norm"), F.max("norm").alias("max_update_norm"),
        (F.max("norm") / F.greatest(F.min("norm"), F.lit(1e-12))).alias("norm_ratio_max_min"))
    c = agreement(updates, by) if pairs else mean_cosine(updates, by).drop("n_clients")
    return n.join(c, by, "left")


def drift_diagnosis(history: DataFrame, run: str = "run", round_col: str = "round") -> DataFrame:
    """Verdict per run from the second half of its rounds (the warm-up is ignored)."""
    w = Window.partitionBy(run)                               # rounds of one run
    late = (history.withColumn("_i", F.row_number().over(w.orderBy(round_col)) - 1)
            .withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_i") >= F.floor(F.col("_n") / 2)))
    g = late.groupBy(run).agg(F.avg("mean_pairwise_cosine").alias("cosine"),
                              F.avg("norm_ratio_max_min").alias("norm_ratio"),
                              F.avg("frac_negative_cosine").alias("frac_negative"))
    verdict = (F.when(F.col("cosine") > 0.5, "agree: more rounds, fewer local steps")
               .when(F.col("cosine") > 0.15, "partial: rounds first, then personal parameters")
               .otherwise("disagree: personal parameters"))
    return g.select(run, "cosine", "norm_ratio", "frac_negative", verdict.alias("verdict"),
                    (F.col("norm_ratio") > 5).cast("int").alias("dominated"))


def early_stop(history: DataFrame, patience: int, metric: str, run: str = "run",
               round_col: str = "round") -> DataFrame:
    """Best round and stopping round per run.

    A round improves when it beats all rounds before it; the run stops at the first
    round that lies ``patience`` rounds after the last improvement (else at its end).
    """
    w = Window.partitionBy(run).orderBy(round_col)            # rounds of one run
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_i", F.row_number().over(w)).withColumn(
        "_up", before.isNull() | (F.col(metric) > before))
    last_up = F.max(F.when(F.col("_up"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = marked.withColumn("_wait", F.col("_i") - last_up)
    stop = F.coalesce(F.min(F.when(F.col("_wait") >= patience, F.col("_i"))).over(Window.partitionBy(run)),
                      F.max("_i").over(Window.partitionBy(run)))
    kept = seen.withColumn("_stop", stop).where(F.col("_i") <= F.col("_stop"))
    # earliest of equally good rounds: later ones do not improve
    return kept.groupBy(run).agg(
        F.max_by(round_col, F.struct(F.col(metric), -F.col("_i"))).alias("best_round"),
        F.max(metric).alias("best"), F.max(round_col).alias("stopped_at"))


# --- a linear model trained the federated way -------------------------------------------------

def linear_score(features: Sequence[str], w: Column) -> Column:
    """Intercept (entry 0) plus the weighted features; missing features count as 0."""
    z = F.get(w, F.lit(0))
    for i, f in enumerate(features):
        z = z + F.get(w, F.lit(i + 1)) * F.coalesce(F.col(f), F.lit(0.0))
    return z


def client_gradients(rows: DataFrame, weights: DataFrame, features: Sequence[str],
                     label: str = "label") -> DataFrame:
    """Mean logistic gradient of every client at its current weights: (client, n, grad).

    ``weights``: client, _w (array), and optionally _pw, the weight of a positive
    row. One aggregation serves all clients; a client is a group, not a task, so a
    very large one is split like any other data.
    """
    importance = (F.when(F.col(label) == 1, F.col("_pw")).otherwise(1.0) if "_pw" in weights.columns
                  else F.lit(1.0))
    err = (sigmoid(linear_score(features, F.col("_w"))) - F.col(label)) * importance
    scored = rows.join(weights, "client").withColumn("_e", err)
    parts = [F.sum("_e"), *[F.sum(F.col("_e") * F.coalesce(F.col(f), F.lit(0.0))) for f in features]]
    g = scored.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("_g"))
    return g.select("client", "n", F.transform("_g", lambda x: x / F.col("n")).alias("grad"))


def score(rows: DataFrame, weights: DataFrame, features: Sequence[str],
          keep: Sequence[str] = ("stay_id", "client", "label")) -> DataFrame:
    """Every client's rows scored with its own parameters (client, _w), pooled in one frame: z and p."""
    z = linear_score(features, F.col("_w"))
    joined = lookup_join(rows, weights, ["client"], list(features))
    return joined.select(*keep, z.alias("z"), sigmoid(z).alias("p"))

"""Exact top-k search by inner product: segment statistics bound the scores, coarse to fine.

A vector is cut into segments. The mean and the deviation of a segment of length m bound a
squared distance from below, m ((mean difference)^2 + (deviation difference)^2), and so an
inner product from above. Pairs whose bound is under the query's k-th best known score are
dropped, first with one segment, then with ever finer ones; exact scores are computed for
the pairs that are left. Vectors travel as packed blocks: each block of candidates meets
each block of queries in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.llm.common import discard, query, small_batches, stored, stored_at

#: Components in a block of candidates (16,384 vectors of 64) and in one of queries.
BLOCK_CELLS, QUERY_CELLS = 1 << 20, 1 << 17
#: Pairs whose bounds a task holds at once; share of pairs alive below which they are listed one by one.
TILE_PAIRS, LISTED_SHARE = 1 << 21, 0.02
_PAIRS_AT_ONCE = 1 << 16
_EXACT = 2.0 ** 53

BLOCK = "block long, rows binary, ids array<long>, asks array<boolean>, width int, kind string, cells binary"
QUERIES_OF = "block long, rows binary, ids array<long>, floors binary, width int, kind string, cells binary"


def _pack(matrix: np.ndarray) -> tuple[str, bytes]:
    """The narrowest number format that holds whole-numbered floats."""
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def _unpack(kind: str, cells: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(cells, kind).astype(float)
    return flat.reshape(-1, width) if width else np.zeros((0, 0))


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    """Missing components at the end count as 0."""
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def segments(width: int) -> list[np.ndarray]:
    """Starts of the segments of each resolution: 1, 2, 4, ... of them, at least two components in each."""
    out, n = [], 1
    while n == 1 or 2 * n <= width:
        out.append(np.unique(np.linspace(0, width, n, endpoint=False).astype(int)))
        n *= 2
    return out


def statistics(matrix: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every segment its mean and its deviation, both times the root of its length.

    The inner product of two rows of statistics is at least that of the vectors.
    """
    lengths = np.diff(np.r_[starts, matrix.shape[1]])
    sums = np.add.reduceat(matrix, starts, axis=1)
    centred = matrix - np.repeat(sums / lengths, lengths, axis=1)
    return np.hstack([sums / np.sqrt(lengths), np.sqrt(np.add.reduceat(centred * centred, starts, axis=1))])


def _fits(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether floats hold every partial sum of the inner products exactly."""
    return np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1) < _EXACT


def exact(queries: np.ndarray, vectors: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Whole-numbered inner products of listed pairs; beyond the range of a long, its nearest value."""
    out = np.empty(len(qi), np.int64)
    fits = _fits(queries, vectors)
    low, high = -(1 << 63), (1 << 63) - 1
    for at in range(0, len(qi), _PAIRS_AT_ONCE):
        part = slice(at, at + _PAIRS_AT_ONCE)
        a, b = queries[qi[part]], vectors[vi[part]]
        out[part] = np.einsum("ij,ij->i", a, b) if fits else [
            min(high, max(low, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)]
    return out


def _highest(k: int, q: np.ndarray, score: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Which pairs are among the k highest of their query; ties go to the smaller of ``ties``, the first named first."""
    order = np.lexsort((*ties[::-1], -score.astype(float) if score.dtype != np.int64 else ~score, q))
    fresh = np.r_[True, q[order][1:] != q[order][:-1]] if len(q) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


def search_tile(queries: np.ndarray, vectors: np.ndarray, floors: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, vector, score) that may be among the k highest: every pair at or above its query's k-th known score.

    ``floors`` has a score per query that k candidates are known to reach; ``own`` masks pairs out. It is
    raised in place. Bounds are floats: what they miss by rounding is allowed for.
    """
    width = max(queries.shape[1], vectors.shape[1], 1)
    queries, vectors = widened(queries, width), widened(vectors, width)
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0) + 1e-6
    alive: np.ndarray | None = ~own
    qi = vi = np.zeros(0, np.int64)
    for starts in segments(width):
        a, b = statistics(queries, starts), statistics(vectors, starts)
        if alive is not None:                           # many pairs are left: bounds of all of them
            bound = np.where(alive, a @ b.T, -np.inf)
            best = np.argpartition(bound, -k, axis=1)[:, -k:] if bound.shape[1] > k else np.tile(
                np.arange(bound.shape[1]), (len(bound), 1))
            tq, tv = np.repeat(np.arange(len(bound)), best.shape[1]), best.ravel()
            open_ = alive[tq, tv]
            tq, tv = tq[open_], tv[open_]
        else:
            bound = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[qi[s:s + _PAIRS_AT_ONCE]], b[vi[s:s + _PAIRS_AT_ONCE]])
                                                   for s in range(0, len(qi), _PAIRS_AT_ONCE))])
            top = _highest(k, qi, bound)
            tq, tv = qi[top], vi[top]
        score = exact(queries, vectors, tq, tv)          # the most promising pairs raise the floor
        full = np.flatnonzero(np.bincount(tq, minlength=len(queries)) >= k)
        least = np.full(len(queries), np.inf)
        np.minimum.at(least, tq, score.astype(float))
        floors[full] = np.maximum(floors[full], least[full])
        if alive is not None:
            alive &= bound >= (floors - slack)[:, None]
            if np.count_nonzero(alive) < LISTED_SHARE * alive.size:
                (qi, vi), alive = np.nonzero(alive), None
        else:
            keep = bound >= (floors - slack)[qi]
            qi, vi = qi[keep], vi[keep]
    if alive is not None and _fits(queries, vectors):    # the survivors are not few: a product of whole blocks is cheaper
        score = np.where(alive, queries @ vectors.T, -np.inf)
        qi, vi = np.nonzero(score >= np.where(np.isfinite(floors), floors, -_EXACT)[:, None])
        return qi, vi, score[qi, vi].astype(np.int64)
    if alive is not None:
        qi, vi = np.nonzero(alive)
    return qi, vi, exact(queries, vectors, qi, vi)


def _pairs(queries: dict, vectors: dict, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, vector, score) of two blocks, the k highest of each query and tile."""
    q, v = queries["matrix"], vectors["matrix"]
    step = max(1, TILE_PAIRS // max(1, len(v)))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        own = queries["rows"][part][:, None] == vectors["rows"][None]
        qi, vi, score = search_tile(q[part], v, floors[part], own, k)
        keep = _highest(k, qi, score, vectors["unnamed"][vi], vectors["ids"][vi], vectors["rows"][vi])
        yield qi[keep] + at, vi[keep], score[keep]


def _block(row: dict) -> dict:
    ids = row["ids"]
    rows = np.frombuffer(row["rows"], np.int64)
    matrix = _unpack(row["kind"], row["cells"], row["width"])
    return {"rows": rows, "ids": np.array([i or 0 for i in ids], np.int64), "unnamed": np.array([i is None for i in ids], bool),
            "matrix": matrix if len(matrix) else np.zeros((len(rows), 0))}


def packed_vectors(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, scale: float) -> DataFrame:
    """Blocks of whole-numbered vectors, floor(scale * x). Null vectors and null or non-finite components: left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        width = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            matrix = np.zeros((len(held), width))
            for i, (_, _, c) in enumerate(held):
                matrix[i, :len(c)] = c
            kind, cells = _pack(matrix)
            rows = np.arange(made, made + len(held), dtype=np.int64) + first
            out = {"block": [first + made], "rows": [rows.tobytes()], "ids": [[i for i, _, _ in held]],
                   "asks": [[a for _, a, _ in held]], "width": [width], "kind": [kind], "cells": [cells]}
            made += len(held)
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

        for batch in batches:
            ids, asks, lists = (batch.column(c) for c in ("id", "asks", "v"))
            values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(float) * scale)
            ends = lists.offsets.to_numpy()
            for i, a, s, e in zip(ids.to_pylist(), asks.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if held and (len(held) + 1) * max(width, e - s) > BLOCK_CELLS:
                    yield block()
                    held, width = [], 0
                held.append((i, a, values[s:e]))
                width = max(width, e - s)
        if held:
            yield block()

    kinds = {"block": pa.int64(), "rows": pa.binary(), "ids": pa.list_(pa.int64()), "asks": pa.list_(pa.bool_()),
             "width": pa.int32(), "kind": pa.string(), "cells": pa.binary()}
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                            F.col(vector).cast("array<double>").alias("v"))
    return small_batches(narrow.where(sound)).mapInArrow(pack, BLOCK)


def query_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """Blocks of the queries; the k-th best score inside a query's own block is its first floor."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        width = 0

        def block() -> pa.RecordBatch:
            matrix = np.vstack([widened(m, width) for *_, m in held])
            kind, cells = _pack(matrix)
            rows = np.concatenate([r for r, *_ in held])
            out = {"block": [int(rows[0])], "rows": [rows.tobytes()], "ids": [np.concatenate([i for _, i, *_ in held]).tolist()],
                   "floors": [np.concatenate([f for _, _, f, _ in held]).tobytes()], "width": [width], "kind": [kind], "cells": [cells]}
            return pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in out.items()})

        for batch in batches:
            for row in batch.to_pylist():
                vectors = _block(row)
                asks = np.flatnonzero(row["asks"])
                if not len(asks):
                    continue
                some = {"rows": vectors["rows"][asks], "matrix": vectors["matrix"][asks]}
                floors = np.full(len(asks), -np.inf)
                for _ in _pairs(some, vectors, floors, k):
                    pass
                step = max(1, QUERY_CELLS // max(1, row["width"]))
                for at in range(0, len(asks), step):
                    part = slice(at, at + step)
                    n = len(asks[part])
                    if held and (sum(len(r) for r, *_ in held) + n) * max(width, row["width"]) > QUERY_CELLS:
                        yield block()
                        held, width = [], 0
                    held.append((some["rows"][part], vectors["ids"][asks[part]], floors[part], some["matrix"][part]))
                    width = max(width, row["width"])
        if held:
            yield block()

    kinds = {"block": pa.int64(), "rows": pa.binary(), "ids": pa.list_(pa.int64()), "floors": pa.binary(),
             "width": pa.int32(), "kind": pa.string(), "cells": pa.binary()}
    return blocks.mapInArrow(pick, QUERIES_OF)


def top_k(vectors: DataFrame, k: int, is_query: Column, scale: float = 256.0, vec_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for every query row.

    Every row but the query's own is a candidate, also one with the same id or no id. Equal scores go to the
    smaller id (no id last). Null vectors and vectors with null or non-finite components take no part; a
    shorter vector's missing components are 0, so an empty one scores 0 with everything. A query without an
    id asks nothing unless ``is_query`` says so. Fewer candidates than k: all of them. Rows that share an id
    answer one by one. Scores beyond a long are cut to its range. Other columns are not read. A query block
    is sent to every block of candidates; both are at most a few MB, however many rows there are.
    """
    blocks, path = stored_at(packed_vectors(vectors, vec_id, vector, is_query, scale), "search-vectors", "zstd")
    asking, asked_path = stored_at(query_blocks(blocks, k), "search-queries", "zstd")
    n = max(1, blocks.count())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, found = _block(row["q"]), _block(row["v"])
                floors = np.frombuffer(row["q"]["floors"], float).copy()
                for qi, vi, score in _pairs(queries, found, floors, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries["rows"][qi]), pa.array(queries["ids"][qi], mask=queries["unnamed"][qi]),
                         pa.array(found["ids"][vi], mask=found["unnamed"][vi]), pa.array(found["rows"][vi]), pa.array(score)],
                        names=["query", "query_id", "vec_id", "row", "score"])

    # a bucket holds one block of candidates on average; every block of queries visits every bucket
    left = asking.select(F.struct("*").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    right = blocks.select(F.struct("rows", "ids", "width", "kind", "cells").alias("v"),
                          F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("bucket"))
    found = small_batches(left.join(right, "bucket").select("q", "v")).mapInArrow(
        search, "query long, query_id long, vec_id long, row long, score long")
    best = stored(found, "search-found")
    discard(vectors.sparkSession, path)
    discard(vectors.sparkSession, asked_path)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op12_topk_search", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.c, d.c)::BIGINT AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, 5, F.col("vec_id") % 50 == 0)

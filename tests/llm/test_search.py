"""Top-k search against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.llm import search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType()), T.StructField("bucket", T.StringType())])


def rows(seed: int = 3, n: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(24)]) for i in range(n)]
    out += [(n + i, list(out[7][1])) for i in range(30)]                        # a group of copies: ties
    out += [(n + 40, None), (n + 41, [0.1, None, 0.3]), (n + 42, [math.nan] * 24), (n + 43, [math.inf, 1.0]), (n + 44, []),
            (n + 45, [0.5] * 5), (n + 46, [3.0] * 40), (None, [0.2] * 24), (350, [3e38, 1.0]), (400, [-3e38, 3e38]), (0, out[0][1]),
            out[50], (450, [float(i % 3) for i in range(300)])]
    return [(i, v, "s", "b") for i, v in out]


def brute(table: list[tuple], k: int) -> list[tuple]:
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in table
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, c) in enumerate(kept):
        if q is None or q % 50:
            continue
        scored = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(c, d)))), v is None, v or 0, v) for b, (v, d) in enumerate(kept) if a != b]
        out += [(q, r, v, -s) for r, (s, _, _, v) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [search.BLOCK_CELLS, 600])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(search, "BLOCK_CELLS", cells)
    monkeypatch.setattr(search, "QUERY_CELLS", cells)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = search.top_k(df, 5, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows(), 5)


def test_few_candidates_and_none(spark):
    few = [(0, [1.0, -2.0], "", ""), (50, [0.5, 0.25], "", ""), (3, [1.0, 1.0], "", "")]
    for table in (few, few[:1], []):
        got = search.top_k(spark.createDataFrame(table, SCHEMA), 5, F.col("vec_id") % 50 == 0)
        assert sorted(tuple(r) for r in got.collect()) == brute(table, 5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (40, 64))
    vectors = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 12, (3000, 64)))
    queries, truth = vectors[:64], None
    for starts in search.segments(64):
        bound = search.statistics(queries, starts) @ search.statistics(vectors, starts).T
        truth = queries @ vectors.T
        assert (bound >= truth - 1e-6 * np.abs(truth).max()).all()
    own = np.zeros((64, 3000), bool)
    own[np.arange(64), np.arange(64)] = True
    qi, vi, score = search.search_tile(queries, vectors, np.full(64, -np.inf), own, 5)
    assert len(qi) < 0.1 * own.size                    # most pairs need no exact score
    fifth = np.sort(np.where(own, -np.inf, truth), axis=1)[:, -5]
    assert all((score[qi == q] >= fifth[q]).sum() >= 5 for q in range(64))

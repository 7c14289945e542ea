import random

import pytest

from sitewise.llm.graph import components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    order = rng.sample(range(200), 60)
    edges = {"chain": list(zip(order, order[1:])), "star": [(7, i) for i in range(50) if i != 7] + [(100, 101)],
             "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)]}[kind]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((i, find(i)) for i in root)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

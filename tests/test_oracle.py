"""Every registered query against its SQL counterpart, and what their plans must not hold."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from sitewise.plans import catalog

# the library's own queries; the training-data operators have tests of their own
QUERIES = {name: q for name, q in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: q for name, q in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="session")
def outcomes(spark, sf):
    con = duck(sf)

    def one(name):
        try:
            df = QUERIES[name](spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
            if name in ORACLES:
                return name, compare(df, con.cursor(), ORACLES[name]), plan
            return name, None if df.count() > 0 else "no rows", plan
        except Exception as e:  # noqa: BLE001 - reported by the test of this query
            return name, f"{type(e).__name__}: {e}"[:2000], ""

    with ThreadPoolExecutor(6) as pool:
        return {n: (problem, plan) for n, problem, plan in pool.map(one, QUERIES)}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(outcomes, name):
    assert outcomes[name][0] is None


@pytest.mark.parametrize("name", QUERIES)
def test_plan_has_no_pair_joins(outcomes, name):
    plan = outcomes[name][1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

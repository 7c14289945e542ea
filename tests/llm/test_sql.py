"""The queries that have SQL counterparts, over the given tables; the pipeline's stages."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from sitewise.llm import catalog


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name]) is None


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert names == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op8_secret_scan", "op9_mix_sources"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_pipeline_stages(spark):
    import small
    docs = spark.createDataFrame(small.repeated(), small.SCHEMA)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = spark.createDataFrame(stage(spark, table, "").collect(), small.SCHEMA)
            assert table.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, table, "")
        assert "sequence_id" in packed.columns
        assert (packed.count() > 0) == (table.count() > 0)

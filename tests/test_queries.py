"""Every query against its SQL, and every plan that must reach the scan."""

import pytest

import oracle
from lexgrain.plans import catalogue


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, folder, con, name):
    assert oracle.difference(spark, folder, catalogue.queries()[name], catalogue.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, folder, name):
    df = catalogue.queries()[name](spark, folder)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filter_and_columns_reach_the_scan(spark, folder):
    df = catalogue.queries()["vector_topk_filtered"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan or "EqualTo(label,3)" in plan
    plan = catalogue.queries()["by_subject"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]

import pytest

from lodestone.jobs import catalogue

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_citations"] > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["filter_date_between"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    plan = catalogue.QUERIES["filter_num_cmp"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan and "GreaterThanOrEqual(p_size,30)" in plan


def test_single_search_takes_ordered(spark):
    plan = catalogue.QUERIES["knn_l2_topk"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in plan or "Limit" in plan

"""Queries of the subpackage that SQL can express, against that SQL on whole tables."""

import pytest

from cellweft.llm.queries import R
from oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(R.sql))
def test_query_equals_sql(spark, sf, name):
    d = sf("0.01")
    assert spark_rows(R.queries[name](spark, d)) == sql_rows(connect(d), R.sql[name])


@pytest.mark.parametrize("name", sorted(set(R.queries) - set(R.sql)))
def test_other_queries_run(spark, sf, name):
    df = R.queries[name](spark, sf("0.01"))
    assert df.columns and df.count() > 0

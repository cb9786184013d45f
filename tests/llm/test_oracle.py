"""Queries against their SQL."""

import pytest

from weftline.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert df.columns == columns
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, found.fetchall()))

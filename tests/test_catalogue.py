"""Each query against its SQL over the smallest tables."""

import pytest

from weftline.plans import catalogue


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(found.fetchall(), columns)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

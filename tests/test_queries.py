"""Every registered query with SQL gives DuckDB's rows; the others run."""

import math

import pytest

from flightline.plans import registry

SQL = registry.oracle_sql()


def rows(names, values):
    def plain(x):
        return round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, tables, name):
    df = registry.queries()[name](spark, sf)
    expected = tables.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", ["pca_embedding", "bootstrap_ci"])
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

import pytest
from compare import SF, connect, rows

from quillgraph.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(con.execute(sql).df())
    else:
        assert len(got.columns) and len(got)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

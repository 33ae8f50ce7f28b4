import duckdb
import pytest

import __spark_entry__ as entry
from providerfx.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = [n for n in entry.oracle_sql() if n in registry.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer orders lineitem events documents labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    a, b = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(repr, a[cols].astype(object).itertuples(index=False, name=None))) == sorted(map(repr, b[cols].astype(object).itertuples(index=False, name=None)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and entry.queries().keys() >= entry.oracle_sql().keys()

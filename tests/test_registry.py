import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import registry
from weftline.session import TABLES

NAMES = sorted(registry.queries())


def plain(v):
    """A value as both engines give it: doubles to six places, times as text."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_columns(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    n = df.count()
    sql = registry.oracle_sql().get(name)
    if sql:
        r = con.execute(sql)
        names = [x[0] for x in r.description]
        cols = sorted(df.columns)
        assert sorted(names) == cols
        want = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
        got = sorted(repr([plain(row[c]) for c in cols]) for row in df.collect())
        assert got == want and len(want) == n


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

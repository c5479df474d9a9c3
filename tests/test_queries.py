"""Every query with SQL agrees with DuckDB at sf0.001."""

import duckdb
import pytest

from strataq import bind

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(records):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(bind.ORACLE_SQL))
def test_oracle(spark, db, name):
    want = db.execute(bind.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = bind.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.category for r in e.entry(spark).collect()} == {"emails", "ips"}
    assert set(e.oracle_sql()) <= set(e.queries())

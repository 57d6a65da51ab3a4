from __future__ import annotations

import __spark_entry__
import duckdb
import pytest

from tallyweave.plans import boxes, items, records

QUERIES = {k: v for m in (records, boxes, items) for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con(small):
    import pathlib

    c = duckdb.connect()
    for p in pathlib.Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, small, con, name):
    query, sql = QUERIES[name]
    df = query(spark, small)
    names = sorted(df.columns)
    found = con.execute(sql)
    at = [[d[0] for d in found.description].index(n) for n in names]
    assert sorted(map(str, (tuple(plain(r[n]) for n in names) for r in df.collect()))) == sorted(map(str, (tuple(plain(r[i]) for i in at) for r in found.fetchall())))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_partitions_do_not_matter(spark, small, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name][0](spark, small)
        return sorted(str(tuple(plain(v) for v in r)) for r in df.collect())

    try:
        assert run(1) == run(7) != []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

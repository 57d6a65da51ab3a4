from __future__ import annotations

import pathlib

import duckdb
import pytest

from tallyweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for p in pathlib.Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, small)
    found = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(n) for n in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())

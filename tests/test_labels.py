from __future__ import annotations

import pytest
from test_queries import con, plain  # noqa: F401

from tallyweave.plans import labels


@pytest.mark.parametrize("name", list(labels.QUERIES))
def test_against_sql(spark, small, con, name):  # noqa: F811
    query, sql = labels.QUERIES[name]
    df = query(spark, small)
    names = sorted(df.columns)
    found = con.execute(sql)
    at = [[d[0] for d in found.description].index(n) for n in names]
    got = {tuple(plain(r[n]) for n in names) for r in df.collect()}
    want = {tuple(plain(r[i]) for i in at) for r in found.fetchall()}
    n = len(labels.CASES[name].rows) if name in labels.CASES else 1
    key = names.index("p_partkey")
    assert sorted({(int(x[key]) % n, *x) for x in map(lambda t: tuple(map(str, t)), got - want)})[:n] == [] and got == want

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import queries, va_search


def brute(rows, is_query, k):
    ok = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for qid, q in sorted(ok):
        if is_query(qid):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qid and len(v) == len(q))[:k]
            want += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(want)


@pytest.mark.parametrize(("block", "query_block"), [(7, 3), (4096, 512)])
def test_against_brute_force(spark, block, query_block):
    rnd = random.Random(block)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, rnd.uniform(-1, 1)]) for _ in range(4)]) for i in range(90)]
    rows += [(100, None), (101, [None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (104, [0.25, 0.25]), (105, [0.5, -0.5]), (None, [1.0] * 4), rows[3], rows[3], (106, [1e6, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = va_search.top_k(df, F.col("vec_id") % 3 == 0, 5, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 3 == 0, 5)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert va_search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    assert va_search.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0])], schema)
    assert list(map(tuple, va_search.top_k(two, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 65536)]


def test_reads_only_what_the_bounds_leave(monkeypatch):
    rng = np.random.default_rng(0)
    exact = np.floor(rng.normal(size=(4000, 8)) * 100)
    lo = exact.min(0)
    step = np.maximum(np.ceil((exact.max(0) - lo + 1) / va_search.CELLS), 1.0)
    read = []
    real = np.argpartition
    monkeypatch.setattr(va_search.np, "argpartition", lambda a, n: read.append(n + 1) or real(a, n))
    found = list(va_search.scan_block(exact[:20], np.arange(20), np.arange(4000), exact, lo, step, (exact - lo) // step, 5))
    assert len(found) == 100 and max(read) < 400


def test_query_op9(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op9_va_search(spark, small).collect())) == brute(rows, lambda i: i % 50 == 0, 5)

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import extract, similarity
from tallyweave.operators import matching
from tallyweave.operators.cases import by_case

BIG = 2**53


def test_keys_are_exact_and_null_is_no_case(spark):
    rows = spark.createDataFrame([(BIG, 1, None), (BIG + 1, 2, 5), (None, 3, BIG + 1), (BIG + 1, 2, BIG + 1), (-1, None, 0)], "k long, n long, v long")
    got = by_case(rows, ["k"], [F.col("n"), F.col("v")], lambda held: [(held[0][0], len(held), held[-1][2])], "k long, n long, last long").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(BIG, 1, None), (BIG + 1, 2, BIG + 1), (-1, 1, 0)], key=str)


def test_keys_of_several_columns(spark):
    rows = spark.createDataFrame([(1, "a", float("nan")), (1, "a", float("nan")), (1, None, 2.0), (1, "b", 2.0)], "k int, s string, d double")
    got = by_case(rows, ["k", "s", "d"], [], lambda held: [(held[0][1], len(held))], "s string, n int").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1)]
    assert by_case(rows.limit(0), ["k"], [], lambda held: [], "n int").collect() == []
    assert by_case(rows, ["k"], [], lambda held: [], "n int").collect() == []


def test_greedy_with_large_and_null_keys(spark):
    pairs = spark.createDataFrame([(BIG, 1, 1, 0.5), (BIG + 1, 1, 1, 0.9), (BIG + 1, 1, 2, 0.8), (BIG + 1, 2, 1, 0.7), (BIG + 1, 2, 2, 0.6), (None, 1, 1, 1.0)], "case long, l_idx long, r_idx long, score double")
    got = matching.greedy(pairs, ["case"], [F.col("score").desc()]).collect()
    assert sorted(map(tuple, got)) == [(BIG, 1, 1, 0.5), (BIG + 1, 1, 1, 0.9), (BIG + 1, 2, 2, 0.6)]


def test_replies_that_break_a_reader(spark):
    for bad in ('{"a":' * 50_000, "{" * 100_000, "[" * 100_000 + '{"a": 1}', '{"a": ' + "[" * 1_000 + "]" * 1_000 + "}"):
        assert extract.salvage(bad) is None
    assert extract.salvage("{x " * 500 + '{"a": 1}') is None  # nested too deep to tell
    assert extract.salvage("{x} " * 500 + '{"a": 1}') == {"a": 1}
    rows = spark.createDataFrame([('{"decision":"\\ud800"}',), ('{"a":' * 50_000,), (None,)], "t string").select(extract.salvaged(F.col("t")).alias("o"))
    assert [r["o"] for r in rows.collect()] == ['{"decision": "�"}', None, None]


def test_harvest_of_a_column(spark):
    rows = spark.createDataFrame([('{"4": true, "x": [5, "6 7"]}',), ("8 and 9",), (None,), ("[" * 5_000,)], "t string")
    valid = F.array(*[F.lit(i).cast("long") for i in range(4, 9)])
    assert [r["h"] for r in rows.select(similarity.harvested(F.col("t"), valid).alias("h")).collect()] == [[4, 5, 6, 7], [8], [], []]

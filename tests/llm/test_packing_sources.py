from __future__ import annotations

import random

import numpy as np
import pytest
from test_packing import check, ids_of, round_robin

from tallyweave.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_ranks_of_many_queues_against_the_walk(seed):
    rnd = random.Random(seed)
    tokens = sorted((rnd.choice([0, 15, 16, 40, rnd.randint(0, 3000)]) for _ in range(400)), reverse=True)
    weights = np.array([rnd.choice([1, 2, 4, 8]) for _ in tokens])
    mix = packing.Mixture(np.array(tokens), weights, 64, 16)
    want = round_robin(mix)
    assert mix.ranks(np.array([s for s, _ in want], int), np.array([j for _, j in want], int)).tolist() == list(range(len(want)))


def test_each_of_many_sources_has_its_queue_and_target(spark):
    rows = [(i, f"word{i % 7} " * 40, f"host{i}") for i in range(300)] + [(1000 + i, "alpha beta gamma " * 200, ("big", "other")[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for targets in (None, {"big": 0.9, "other": 0.1}):
        got = packing.pack(docs, targets).collect()
        check(got, ids_of(docs))
        assert {r["queue"] for r in got} == {r[2] for r in rows}
    held = {q: sum(r["length"] for r in got if r["queue"] == q and r["sequence_id"] < 20) for q in ("big", "other")}
    assert held["big"] > 0.8 * 20 * 1024 and 0 < held["other"] < 0.2 * 20 * 1024

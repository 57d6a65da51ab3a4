from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import packing, queries, tokenize

TOK = Tokenizer.from_file(tokenize.default_path())


def round_robin(mix):
    """The served order by walking due times: (queue, quantum) of each place."""
    due = [((2 * j + 1) / (2 * int(mix.weights[s])), s, j) for s in range(len(mix.weights)) for j in range(int(mix.quanta[s]))]
    return [(s, j) for _, s, j in sorted(due)]


@pytest.mark.parametrize("seed", range(12))
def test_ranks_against_the_walk(seed):
    rnd = random.Random(seed)
    tokens = [rnd.choice([0, 1, 17, 400, rnd.randint(0, 9000)]) for _ in range(rnd.randint(1, 7))]
    weights = np.array([rnd.choice([1, 2, 4, 8]) for _ in tokens])  # powers of two: the walk's fractions are exact
    mix = packing.Mixture(np.array(tokens), weights, 64, 16)
    want = round_robin(mix)
    got = mix.ranks(np.array([s for s, _ in want], int), np.array([j for _, j in want], int))
    assert got.tolist() == list(range(len(want)))


def spread(mix, tokens):
    cells = defaultdict(set)
    for q, t in enumerate(tokens):
        s, o = mix.place(np.full(t, q), np.arange(t))
        for a, b in zip(s.tolist(), o.tolist()):
            assert b not in cells[a]
            cells[a].add(b)
    return cells


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.2}, {"c": 1.0}])
def test_each_place_is_taken_once(targets):
    tokens = [5000, 1213, 77, 0, 16]
    mix = packing.Mixture.of(list("abcde"), tokens, targets, 64, 16)
    cells = spread(mix, tokens)
    last = max(cells)
    assert sorted(cells) == list(range(last + 1)) and sum(map(len, cells.values())) == sum(tokens)
    assert all(c == set(range(len(c))) and (len(c) == 64 or k == last) for k, c in cells.items())


def test_deficits_stay_within_a_quantum():
    names, tokens = list("abcd"), [90_000, 30_000, 9_000, 900]
    mix = packing.Mixture.of(names, tokens, None, 1024, 128)
    assert all(np.abs(mix.deficits(w)).max() <= 2 * 128 for w in range(0, mix.full, 7))
    mix = packing.Mixture.of(names, tokens, {"a": 0.25, "b": 0.5, "c": 0.2, "d": 0.05}, 1024, 128)
    out = next(w for w in range(mix.full) if mix.deficits(w).max() > 256)
    assert out == 23  # d holds 7 quanta: it is owed 0.05 * 1024 w - 896 once they are gone


def check(rows, ids):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(ids)
    for d, pieces in by.items():
        at = 0
        for start, length, crc, n in sorted(pieces):
            assert start == at and length > 0 and n == len(ids[d])
            assert crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[d])
    last = max(seqs)
    for k, pieces in seqs.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or (k == last and at < 1024)
    assert sorted(seqs) == list(range(last + 1))


def ids_of(docs):
    return {r["doc_id"]: [*TOK.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}


def test_query_op4(spark, small):
    check(queries.op4_packing(spark, small).collect(), ids_of(spark.read.parquet(f"{small}/documents.parquet")))


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    docs = odd_docs.withColumn("doc_id", F.monotonically_increasing_id())
    check(packing.pack(docs).collect(), ids_of(docs))
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    check(packing.pack(docs.repartition(3)).collect(), ids_of(docs))
    assert packing.pack(no_docs).collect() == []
    assert packing.pack(odd_docs).filter("doc_id is null").count() >= 1


def test_sequences_hold_the_ids(spark, odd_docs):
    seqs = packing.sequences(packing.pack(odd_docs, with_ids=True)).orderBy("sequence_id").collect()
    joined = b"".join(bytes(r["ids"]) for r in seqs)
    assert sorted(np.frombuffer(joined, "<u4").tolist()) == sorted(i for r in odd_docs.collect() for i in [*TOK.encode(r["text"] or "", add_special_tokens=False).ids, 0])

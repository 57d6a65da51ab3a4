from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, n=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, k):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= k:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("seed", range(8))
def test_lists_are_linked_as_by_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(simhash, "PAIRED", 10)
    k = rnd.randint(1, 3)
    members = sorted({rnd.getrandbits(rnd.choice([3, 8, 14])) for _ in range(rnd.randint(2, 300))})
    want = brute_roots(members, k)
    got = simhash.linked(np.array(members, np.uint64), k)
    assert got.tolist() == [want[m] for m in members]


def test_fingerprints(spark, odd_docs):
    got = odd_docs.select("text", simhash.hex_print(simhash.fingerprints(F.col("text"))).alias("h")).collect()
    assert all(r["h"] == f"{brute_print(r['text']):016x}" for r in got)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_classes_against_brute_force(spark, k):
    rnd = random.Random(k)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base) | {0, (1 << 64) - 1, 1 << 63, 3}
    for _ in range(600):  # chains of near prints, and one large list
        p = rnd.choice(sorted(prints) if rnd.random() < 0.5 else base[:2])
        for b in rnd.sample(range(64 if rnd.random() < 0.5 else 16), rnd.randint(1, 3)):
            p ^= 1 << b
        prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s, i) for i, s in enumerate(sorted(signed.values()))], "fp long, n long")
    first = {r["fp"]: r["n"] for r in df.collect()}
    roots = brute_roots(prints, k)
    low = {}
    for p, r in roots.items():
        low[r] = min(low.get(r, 1 << 40), first[signed[p]])
    got = {r["fp"]: r["class"] for r in simhash.classes(df, "n", k).collect()}
    assert got == {signed[p]: low[r] for p, r in roots.items()}


def test_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).collect() == []


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[None] is None
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(c) for c in {r["component_id"] for r in got})
    assert simhash.dedup(no_docs).collect() == []


def test_query_op6(spark, small):
    docs = {r["doc_id"]: brute_print(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    roots = brute_roots(docs.values(), 2)
    first = {}
    for d, p in sorted(docs.items()):
        first.setdefault(roots[p], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, small).collect()}
    assert got == {d: (f"{p:016x}", first[roots[p]]) for d, p in docs.items()}

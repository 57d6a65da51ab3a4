from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from tallyweave.llm import near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The least id of each component of pairs with a Jaccard similarity of 0.8 or more, of (id, text)."""
    rows = sorted(rows)
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {find(d) for d, _ in rows}


def copies(seed):
    """Texts with copies in which some words differ, chains of them, and a group longer than PAIRED."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = [[word() for _ in range(rnd.choice([3, 12, 60, 300]))] for _ in range(60)]
    texts += [[word() for _ in range(300)]]
    for k in range(240):
        t = list(texts[60] if k < 100 else rnd.choice(texts))
        for _ in range(rnd.choice([0, 1, 2, 4, 7])):
            t[rnd.randrange(len(t))] = word()
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_stage_against_brute_force_jaccard(spark, small, seed):
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    assert got == kept(rows)


def test_documents_against_brute_force_jaccard(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    assert got == kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    out = near_copies.dedup(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 3, 5, 6, 7, 8, 9, 10, 11]
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert near_copies.dedup(no_docs).collect() == []


def test_least_similarity():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.alike(a[:8], np.append(a[:8], np.array([20, 21], np.uint64))) and not near_copies.alike(a[:7], a)

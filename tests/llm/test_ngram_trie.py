from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import ngram_trie as trie
from tallyweave.llm import queries, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\n"


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [END]


class Brute:
    """The formulas of the module's docstring over plain dictionaries."""

    def __init__(self, texts, order, min_count, discount):
        rows = [tokens(t) for t in texts]
        self.order, self.d = order, discount
        self.c = Counter(w for r in rows for w in r)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.kept = {}
        for k in range(2, order + 1):
            grams = Counter()
            for r in rows:
                line = [END, *r]
                for i in range(k - 1, len(line)):
                    g = tuple(line[i - k + 1 : i + 1])
                    if k == 2 or g[:-1] in self.kept:
                        grams[g] += 1
            self.kept |= {g: c for g, c in grams.items() if c >= min_count}
        self.mass = Counter()
        for g, c in self.kept.items():
            self.mass[g[:-1]] += c - discount

    def count(self, h):
        return self.c[h[0]] if len(h) == 1 else self.kept[h]

    def p(self, h, w):
        if not h:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        lower = self.p(h[1:], w)
        if (len(h) == 1 and not self.c[h[0]]) or (len(h) > 1 and h not in self.kept):
            return lower
        g = max(1 - self.mass[h] / self.count(h), 1e-9)
        return max(self.kept.get((*h, w), self.d) - self.d, 0) / self.count(h) + g * lower

    def score(self, text):
        out, line = 0.0, [END, *tokens(text)]
        for i in range(1, len(line)):
            out += math.log10(self.p(tuple(line[max(0, i - self.order + 1) : i]), line[i]))
        return out

    def base(self, text):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 40]))) + rnd.choice(["", " ", "\n"]) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    texts = corpus(order, 300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    learn = F.col("doc_id") % 4 != 1
    model = Brute([t for i, t in enumerate(texts) if i % 4 != 1], order, 2, 0.75)
    rows = trie.score(df, learn, order=order, segment_tokens=300).collect()
    assert len(rows) == 300
    for r in rows:
        want, n = model.score(r["text"]), len(tokens(r["text"]))
        assert r["n_tokens"] == n and r["train_tokens"] == model.n
        assert r["n_known"] == sum(model.c[w] > 0 for w in tokens(r["text"]))
        assert math.isclose(r["base_score"], model.base(r["text"]), rel_tol=1e-9)
        assert want - 2 * order * n * trie.STEP - 1e-6 <= r["score"] <= want + 1e-6


def test_distributions_sum_to_one_at_most(spark):
    texts = corpus(5, 200)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    model = trie.build(spark, df, shared.fresh_path(spark, "trie"), 2, segment_tokens=200)
    brute = Brute(texts, 2, 2, 0.75)
    words = sorted(brute.c)
    ids, counts = model.find_words(trie.hash_words([trie.END if w == END else w.encode() for w in words]))
    assert sorted(ids.tolist()) == list(range(len(words))) and counts.tolist() == [brute.c[w] for w in words]
    p1 = trie.quantise(model.p1(counts)).astype(float)
    unknown = float(trie.quantise(model.p1(np.zeros(1)))[0])
    for c in range(len(words)):
        order = np.argsort(ids)
        nodes, steps = model.find_children(2, (np.uint64(c) << np.uint64(32)) | ids[order].astype(np.uint64))
        back = float(model.backoff(2, np.array([c]))[0])
        p = 10 ** (-trie.STEP * np.append(np.where(nodes >= 0, steps, p1[order] + back), unknown + back))
        assert 0.985 < p.sum() <= 1 + 1e-9


def test_packed_rows():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    counts = rng.integers(1, 1 << 40, 1000)
    k, c = trie.unpacked(*trie.packed(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("scores", F.lit(1))
    rows = trie.score(docs, F.lit(True)).collect()
    assert len(rows) == docs.count() and all(r["scores"] == 1 and r["n_known"] == r["n_tokens"] for r in rows)
    model = Brute([r["text"] for r in rows], 3, 2, 0.75)
    for r in rows:
        assert abs(r["score"] - model.score(r["text"])) <= 6 * r["n_tokens"] * trie.STEP + 1e-6
    none = trie.score(odd_docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in none} == {(0, 0, 0.0, 0.0)}
    assert trie.score(no_docs, F.lit(True)).collect() == []


def test_query_op1(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    model = Brute([t for d, t in docs.items() if not held[d]], 3, 2, 0.75)
    rows = queries.op1_ngram_trie(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens(t)), model.n)
        assert math.isclose(r["base_score"], model.base(t), rel_tol=1e-9)
        assert abs(r["score"] - model.score(t)) <= 6 * r["n_tokens"] * trie.STEP
    gain = sum(r["score"] - r["base_score"] for r in rows if r["held_out"])
    assert gain > 0

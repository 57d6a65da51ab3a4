from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import quality, queries


def dense_ftrl(rows, size, epochs, alpha, beta, l1, l2):
    """The textbook per-coordinate update, one feature at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def w(i):
        a, b = (0.0, 0.0) if i == size else (l1, l2)
        if abs(z[i]) <= a and i != size:
            return 0.0
        return -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)

    for _ in range(epochs):
        for at, value, y in rows:
            x = {**dict(zip(at, value)), size: 1.0}
            ws = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-sum(ws[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * ws[i]
                n[i] += g * g
    return [w(i) for i in range(size + 1)]


def test_update_against_the_textbook():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), rng.random(4), int(rng.random() < 0.6)) for _ in range(60)]
    model = quality.train(rows, bits=4, epochs=2, alpha=0.4, beta=1.0, l1=0.3, l2=0.7)
    want = dense_ftrl([(a.tolist(), v.tolist(), y) for a, v, y in rows], 16, 2, 0.4, 1.0, 0.3, 0.7)
    assert np.allclose([*model.weights, model.bias], want)


def test_features_do_not_depend_on_what_was_seen():
    texts = ["One two THREE!!! two two", "", None, "x" * 50_000, "é è *** ### ê\n\nend"]
    first = quality.vectors(texts)
    quality.vectors([f"w{i}" for i in range(40_000)])
    quality._memo.clear()
    for (a, b), (c, d) in zip(first, quality.vectors(texts[::-1])[::-1]):
        assert (a == c).all() and np.allclose(b, d)
    assert len(first[1][0]) == 0 and abs(first[0][1].sum() - quality.SCALE) < 1e-9


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.3)
    texts = ["One two THREE!!! two two", "", None, "é è *** ### ê\n\nend", "a a a a"]
    want = [quality.sigmoid(float(model.weights[i] @ v) + model.bias) for i, v in quality.vectors(texts)]
    assert np.allclose(model.score(texts), want) and np.allclose([model.score([t])[0] for t in texts], want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    held = [(rows[d]["predicted"], q) for d, q in labels.items() if rows[d]["held_out"]]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_held_out_labels_are_not_learned_from(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, ~held), quality.fit(docs.repartition(3), turned.repartition(2), ~held)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (99, 0), (3, 0)], "doc_id long, quality int")
    out = quality.with_quality(odd_docs.withColumn("score", F.lit("x")), labels, F.lit(True))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert quality.with_quality(no_docs, labels, F.lit(True)).collect() == []
    assert {r["score"] for r in quality.with_quality(odd_docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.keep_good(odd_docs, labels.limit(0), F.lit(True)).exceptAll(odd_docs).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0), F.lit(True), threshold=0.6).count() == 0


def test_the_sample_is_bounded(spark, odd_docs):
    labels = spark.range(14).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.sample(odd_docs.filter("doc_id != 3"), labels, F.lit(True), "doc_id", "text", "quality", 4).count() <= 4

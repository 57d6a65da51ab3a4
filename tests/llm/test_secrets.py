from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tallyweave.llm import queries, secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_base_spans(spark, odd_docs):
    out = secrets.scan(odd_docs.drop("spans"), F.col("source"), F.col("source"), keep=("doc_id", "text")).select("doc_id", "text", secrets.joined(F.col("spans_base")).alias("b"), secrets.joined(F.col("spans")).alias("s")).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["b"] == ",".join(brute(r["text"]))
        assert set(brute(r["text"])) <= set(r["s"].split(",")) | set() or not brute(r["text"])


def test_owners_tell_examples_from_live(spark):
    example, live, ident = "password=copied123", "password=mine4567890", "Zx9mixedTokenOfOneOwner1"
    rows = [(i, f"see {example} ok", f"r{i}", f"o{i}") for i in range(5)] + [(9, f"x {live} {ident}", "r1", "o1"), (10, f"y {live}", "r2", "o1")]
    rows += [(20 + i, "SharedMixedIdentifier12345", f"r{i}", f"o{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    out = {r["doc_id"]: r for r in secrets.scan(docs, F.col("repo"), F.col("owner"), keep=("doc_id",)).collect()}
    assert out[0]["live"] == [False] and out[0]["owners"] == [5] and out[0]["repos"] == [5]
    assert [(s["kind"], k) for s, k in zip(out[9]["spans"], out[9]["live"])] == [("assign", True), ("owned", True)]
    assert out[10]["owners"] == [1] and out[10]["repos"] == [2]
    assert out[20]["spans"] == []
    cut = {r["doc_id"]: r["text"] for r in secrets.redact(docs, F.col("repo"), F.col("owner")).collect()}
    assert cut[0] == "see <EXAMPLE:assign> ok" and cut[9] == "x <SECRET:assign> <SECRET:owned>" and cut[20] == rows[-5][1]


def test_redaction_keeps_rows(spark, odd_docs, no_docs):
    out = secrets.redact(odd_docs, F.col("source"), F.col("source"))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[0] is None and by[3] == odd_docs.filter("doc_id = 3").first()["text"]
    assert by[10] == "<SECRET:assign> and <SECRET:access> then <SECRET:hex> ok"
    assert secrets.redact(no_docs, F.col("source"), F.col("source")).count() == 0


def test_query_op8(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_secret_scans(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r["doc_id"]])
        n = [sum(s.startswith(k) for s in spans) for k in BASE]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) or not spans

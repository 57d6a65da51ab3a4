"""Bounds and cases at the edge of the cache, the records, the classifier and the decontamination."""

from __future__ import annotations

import pyspark.sql.functions as F
from test_tokens import ids_of

from tallyweave.llm import binary_records, decontaminate, quality, shared, token_cache


def test_ids_of_documents_may_be_the_least_long(spark):
    docs = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (2**53 + 1, "d")], "doc_id long, text string")
    rows = binary_records.read_records(spark, binary_records.write_records(docs, shared.fresh_path(spark, "r"))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), len(ids_of(t)) + 1) for i, t in ((-(2**63), "a b"), (None, "c"), (2**53 + 1, "d")))


def test_partitions_follow_the_bytes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert shared.partitions_for(docs, 1 << 40) == 4 and shared.partitions_for(docs, 1 << 12) > 20


def test_a_full_cache_moves_no_text(spark, odd_docs):
    at = shared.fresh_path(spark, "cache")
    first = {r["doc_id"]: r["n_tokens"] for r in token_cache.with_token_counts(odd_docs, at).collect()}
    before = spark.read.parquet(at).count()
    again = {r["doc_id"]: r["n_tokens"] for r in token_cache.with_token_counts(odd_docs, at).collect()}
    assert again == first and spark.read.parquet(at).count() == before
    more = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "never seen"), (78, "never seen")], "doc_id long, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.with_token_counts(more, at).collect()}
    assert got == first | {77: len(ids_of("never seen")), 78: len(ids_of("never seen"))} and spark.read.parquet(at).count() == before + 1


def test_the_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = lambda most: quality.sample(docs, labels, F.lit(True), "doc_id", "text", "quality", most).collect()
    assert len(rows(1)) == 1 and len(rows(10)) == 2 and rows(10) == rows(10)


def test_many_blocks_and_clashing_names(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items), 5), (2, "none at all", 6)], "doc_id long, text string, spans long")
    found = decontaminate.find_hits(docs, spark.createDataFrame(items, "item_id long, text string"), ("doc_id", "spans"), block_words=50).collect()
    by = {r["doc_id"]: r for r in found}
    assert [tuple(s) for s in by[1]["spans"]] == [(0, 480)] and by[1]["items"] == sorted(str(i) for i, _ in items)
    assert by[2]["spans"] == [] and by[2]["n_words"] == 3

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyweave.llm import kd_shards, queries


def check(rows, sizes, shards, slack):
    per, slots = Counter(), defaultdict(list)
    for r in rows:
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes) / shards
    assert all(abs(per[k] - mean) <= slack * mean for k in range(shards)), sorted(per.values())


def test_equal_bytes_and_whole_groups(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 9)).otherwise(F.repeat(F.concat(F.lit("w"), (F.col("id") % 7001).cast("string")), (F.col("id") % 40).cast("int"))).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("s0")).otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"), F.lit(None).cast("string").alias("lang"))
    rows = kd_shards.shard(docs.withColumn("again", F.col("text")), 40).collect()
    assert len(rows) == 20000
    check(rows, [r["size"] for r in rows], 40, 0.1)
    homes = defaultdict(set)
    for r in rows:
        homes[r["again"]].add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("hot")) and len(homes["hot text " * 9]) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    rows = kd_shards.shard(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count() and {"doc_id", "lang", "source", "spans", "size", "shard", "slot"} == set(rows[0].asDict())
    assert all(0 <= r["shard"] < 3 for r in rows)
    assert kd_shards.shard(no_docs, 3).count() == 0
    assert {r["shard"] for r in kd_shards.shard(odd_docs, 1).collect()} == {0}


def test_query_op7(spark, small):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op7_kd_shards(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
    check(rows, [r["size"] for r in rows], 40, 1e9)  # 200 documents, a few of them larger than a shard


def test_shards_on_disk(spark, odd_docs, tmp_path):
    kd_shards.write_shards(kd_shards.shard(odd_docs, 2), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == odd_docs.count()

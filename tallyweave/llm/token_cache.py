"""Token counts through a digest cache.

A cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). Texts and the tokenizer
file are named by SHA-256; the only normalisation before the digest is null to empty, since any
other would change the counts. The cache is asked by digests alone, before any text moves. Only distinct texts
whose digest pair is absent are encoded; their counts are appended, and every document then takes its count from the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokenize

#: Digests of misses that may be broadcast, about 50 MB of them; more are joined by an exchange.
BROADCAST_MISSES = 500_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache's rows; none where the path does not exist yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_misses(misses: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Counts of (content_digest, text) rows, in the shape of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenize.encoder(tokenizer_path)
        for b in batches:
            _, counts = enc.encode_array(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts)], ["content_digest", "tokenizer_digest", "n_tokens"])

    return misses.mapInArrow(run, CACHE_SCHEMA)


def with_token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """docs with the token count of each whole text in the column ``count``, through the cache at ``cache_path``.

    Null and empty texts count 0. Repeated rows and rows with null in other columns are kept as
    they are; a column that already has the name ``count`` gives way. An empty table gives an empty
    one. A run that stops before its append leaves the cache as it was; a run that appends twice
    leaves equal rows, which the lookup folds into one.

    Texts that the cache holds are not shuffled, unless more than ``BROADCAST_MISSES`` others are missing; a cache that holds
    every digest costs an exchange of digests. Missing texts are shuffled once, after equal texts of a task have become one row, so a text
    that makes up a third of all rows arrives once from each task. The join back moves 32-byte digests, and the engine
    may split a hot digest on the documents' side.
    """
    spark = docs.sparkSession
    shared.arrow_batches(spark)
    tokenizer_path = tokenizer_path or tokenize.default_path()
    version = tokenize.tokenizer_digest(tokenizer_path)
    key = shared.free_name(docs.columns, "content_digest")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    texts = docs.select(digest.alias("content_digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest")
    some = not known.isEmpty()
    if some:
        missing = shared.written(texts.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "token-misses")
        n = missing.count()
        texts = texts.join(F.broadcast(missing) if n <= BROADCAST_MISSES else missing.hint("merge"), "content_digest", "left_semi")
    if not some or n:
        count_misses(texts.dropDuplicates(["content_digest"]), tokenizer_path, version).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version)
    counts = counts.groupBy("content_digest").agg(F.min("n_tokens").alias("n")).select(F.col("content_digest").alias(key), F.col("n").alias(shared.free_name([*docs.columns, key], "n")))
    counts = shared.written(counts, "token-counts")  # both sides of the join are then plain exchanges, whose hot partitions the engine splits
    n = counts.columns[1]
    out = docs.drop(count).withColumn(key, digest).join(counts, key, "left")
    return out.withColumn(count, F.col(n)).drop(key, *([n] if n != count else []))

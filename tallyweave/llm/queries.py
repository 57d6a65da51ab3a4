"""The operators applied to whole tables: one query opN_<name> each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_records, decontaminate, kd_shards, ngram_trie, packing, quality, secrets, shared, simhash, token_cache, va_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of every n-gram of those outside the held-out seventh."""
    held = shared.crc_mod("doc_id", 7) == 2
    scored = ngram_trie.score(_table(spark, sf_dir, "documents"), ~held, min_count=1, keep=("doc_id",))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labelled ones outside the held-out fifth."""
    held = shared.crc_mod("doc_id", 5) == 0
    scored = quality.with_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a cache that starts empty."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes)
    counted = token_cache.with_token_counts(docs, shared.fresh_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 ids, each source at a flattened share of all ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), temperature=0.7)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of benchmark items."""
    found = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose fingerprints are linked."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes.

    Equal texts share a shard, but for a group that outweighs a quarter of a shard: no law of equal bytes can keep it whole. Its rows have ``spread``.
    """
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    out = kd_shards.shard(docs.select("doc_id", "text", "source", "lang", crc), spread="spread")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "spread")


def repository() -> tuple:
    """What stands for repository and owner of a document: its source and language, and its source."""
    return F.concat_ws("/", "source", "lang"), F.col("source")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, judged by their owners over all documents."""
    found = secrets.scan(_table(spark, sf_dir, "documents"), *repository(), keep=("doc_id",))
    n = lambda kind: F.size(F.filter("spans_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_live = F.size(F.filter("live", lambda x: x)).cast("long").alias("n_live")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(F.col("spans_base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), n_live)


def op9_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by inner product of every 50th vector, among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return va_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as record files, read back."""
    path = shared.fresh_path(spark, "records")
    return binary_records.read_records(spark, binary_records.write_records(_table(spark, sf_dir, "documents"), path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in found}


#: Where SQL can express a query's rows.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op5_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
              FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
        l AS (SELECT DISTINCT n FROM g),
        p AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, l WHERE len(w) >= n)),
        m AS (SELECT p.r, p.k, p.n, g.item FROM p JOIN g USING (n, g)),
        h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS pos FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op9_va_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

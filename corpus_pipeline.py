"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes all rows that the one before kept, and is written and read again before the next.
The first four return the columns of ``documents``; the last returns the pieces of sequences.

A stage's result reads tables that the stage has left in the shared folder. They go when the next stage begins, since the result has been
written by then: a result must be written before another stage is called, as ``run`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, near_copies, packing, quality, secrets, shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows outside the held-out fifth."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), shared.crc_mod("doc_id", 5) != 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return near_copies.dedup(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that holds little else goes."""
    return decontaminate.remove_spans(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark of their kind."""
    return secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, each source at its own share."""
    return packing.pack(docs)


_left: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, clearing what stages before it have left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            shared.delete_path(spark, _left.pop())
        shared.taken()
        out = stage(spark, docs, sf_dir)
        _left.extend(shared.taken())
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _tidy(keep_quality)),
    ("near_copies", _tidy(drop_near_copies)),
    ("benchmark", _tidy(cut_benchmark)),
    ("secrets", _tidy(redact_secrets)),
    ("packing", _tidy(pack_sequences)),
]

#: SQL cannot express a trained classifier, a suffix automaton or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = shared.written(out, name, f"{shared.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}")
    return docs

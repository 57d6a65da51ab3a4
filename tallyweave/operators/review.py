"""Human review: drafts that keep earlier decisions, and the detection history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("true_positive", "false_positive")


def valid_decision(c: Column) -> Column:
    return F.when(c.isin(*DECISIONS), c)


def merge_reviews(draft: DataFrame, earlier: DataFrame, key: list[str], order: str) -> DataFrame:
    """draft rows with the decision and note of the earlier review of the same box; the later of repeated earlier rows counts, boxes no longer drafted are dropped."""
    last = earlier.groupBy(*key).agg(F.max_by(F.struct("decision", "note"), order).alias("_old"))
    out = draft.join(last, key, "left")
    return out.withColumns({"decision": F.coalesce(valid_decision(F.col("_old.decision")), F.lit("unreviewed")), "note": F.coalesce("_old.note", F.lit(""))}).drop("_old")


def recent(history: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The n newest entries by the order of insertion: times have whole seconds only."""
    return history.orderBy(F.col(order).desc()).limit(max(n, 0))


def with_results(history: DataFrame, results: DataFrame, fallback: DataFrame, key: str = "output_dir") -> DataFrame:
    """history with its result document, from either of two file names; entries without one go."""
    both = history.join(results.select(key, F.col("document").alias("_a")), key, "left").join(fallback.select(key, F.col("document").alias("_b")), key, "left")
    return both.withColumn("document", F.coalesce("_a", "_b")).drop("_a", "_b").filter("document IS NOT NULL")

"""Exact top-k search by inner product with vector-approximation files.

Vectors are cut into blocks of ``BLOCK``. An approximation file has one row for each block: the ids, and for each dimension
the block's range, divided into ``CELLS`` cells, with each component named by its cell. The exact vectors are a table of their own.

1. Each task holds the cells of a few blocks and scans them with all queries, which it reads from the shared folder block by block. A vector in
   cells of middle m and half-width r scores within q.m - |q|.r and q.m + |q|.r. The task carries the kth best lower
   bound of each query over its blocks, and passes on the vectors whose upper bound reaches it.
2. Of what the tasks pass on, only vectors whose upper bound reaches the query's kth best lower bound over all tasks remain.
3. In rounds the exact vectors of each query's next ``READ`` candidates are read in descending order of upper bound (then twice as many, and so on), until the kth
   best score is above every bound left (at an equal bound a smaller id could still win a tie, so reading goes on).

Cells never meet exact vectors but by the ids of candidates; no vector is shuffled with the queries, and no pair of vectors is a row
unless its bounds ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

BLOCK = 4096
QUERY_BLOCK = 512
CELLS = 64
#: Candidates of a query whose exact vectors are read in the first round.
READ = 32
#: Blocks whose cells a task holds at once.
AT_ONCE = 16
#: Candidates that may be broadcast to the exact vectors, about 50 MB.
BROADCAST_NEAR = 500_000
CANDIDATES = "query_id long, query_row long, vec_row long, lower double, upper double"


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as a double. Rows with a null id, or a null vector, or one that holds null or non-finite components, are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    return rows.select("id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v"))


def numbered(vectors: DataFrame, name: str) -> DataFrame:
    """(row, id, dim, v), written: a number for each row, so that different vectors of one id are told apart."""
    return shared.written(vectors.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dim"), "v"), f"va-{name}-rows")


def blocks(rows: DataFrame, name: str, size: int, codes: bool) -> DataFrame:
    """(dim, block, rows, ids, then cells of a range, or exact components) of at most about twice ``size`` vectors of one length to a row, written.

    The number of blocks follows from a count, and a hash of the row deals vectors out, so a length
    that most vectors have makes many blocks and none is large.
    """
    counts = shared.written(rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("of")), f"va-{name}-counts")
    dealt = rows.join(F.broadcast(counts) if counts.count() < 100_000 else counts, "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("of")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n, dim = len(pdf), int(pdf["dim"].iloc[0])
        exact = np.array(pdf["v"].tolist(), np.float64).reshape(n, dim)
        row = {"dim": dim, "block": int(pdf["block"].iloc[0]), "rows": pdf["row"].to_numpy(np.int64).tobytes(), "ids": pdf["id"].to_numpy(np.int64).tobytes()}
        if codes:
            lo, hi = (exact.min(0), exact.max(0)) if dim else (np.zeros(0), np.zeros(0))
            step = np.maximum(np.ceil((hi - lo + 1) / CELLS), 1.0)  # whole numbers, so that bounds are exact
            row |= {"lo": lo.tobytes(), "step": step.tobytes(), "cells": ((exact - lo) // step).astype(np.uint8).tobytes()}
        else:
            row |= {"exact": exact.tobytes()}
        return pd.DataFrame([row])

    schema = "dim int, block int, rows binary, ids binary" + (", lo binary, step binary, cells binary" if codes else ", exact binary")
    return shared.written(dealt.select("dim", "block", "row", "id", "v").groupBy("dim", "block").applyInPandas(pack, schema), f"va-{name}")


def scan_cells(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, lo: np.ndarray, step: np.ndarray, cells: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, lower, upper) of the vectors of a block whose upper bound reaches the query's kth best lower bound so far, a query's own id left out.

    floor: the k best lower bounds of each query, in falling order, brought up to date here.
    """
    half = (step - 1) / 2
    middle = queries @ (lo + cells * step + half).T
    spread = (np.abs(queries) @ half)[:, None]
    lower = np.where(query_ids[:, None] == ids[None, :], -np.inf, middle - spread)
    best = np.concatenate([floor, lower], axis=1)
    floor[:] = -np.sort(-np.partition(best, best.shape[1] - k, axis=1)[:, -k:], axis=1)
    upper = np.where(np.isneginf(lower), -np.inf, middle + spread)
    q, v = np.nonzero((upper >= floor[:, -1:]) & ~np.isneginf(upper))
    return q, v, lower[q, v], upper[q, v]


def scan_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, exact: np.ndarray, lo: np.ndarray, step: np.ndarray, cells: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of a block that is held whole, for each query: the same search in one process, read in order of bound."""
    bounds = queries @ (lo + cells * step + (step - 1) / 2).T + (np.abs(queries) @ ((step - 1) / 2))[:, None]
    for q, qid, bound in zip(queries, query_ids.tolist(), bounds, strict=True):
        width = min(len(ids), k + READ)
        while True:  # the next vectors in order of bound
            near = np.argpartition(-bound, width - 1)[:width] if width < len(ids) else np.arange(len(ids))
            own = near[ids[near] != qid]
            best = sorted(zip((-(exact[own] @ q)).tolist(), ids[own].tolist(), strict=True))[:k]
            if width == len(ids) or (len(best) == k and -best[-1][0] > np.delete(bound, near).max()):
                break
            width = min(len(ids), width * 4)
        yield from ((qid, i, int(-s)) for s, i in best)


def candidates(packed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """CANDIDATES of every query: what the cells cannot rule out, each task by what it has seen, written."""
    files_of = asked.inputFiles()
    if not files_of or asked.isEmpty():
        return packed.sparkSession.createDataFrame([], CANDIDATES)
    folder = files_of[0].rpartition("/")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = shared.local_fs(folder)
        held: list[dict] = []

        def scanned() -> Iterator[pa.RecordBatch]:
            grids = [(r["dim"], np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["lo"]), np.frombuffer(r["step"]), np.frombuffer(r["cells"], np.uint8).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0), np.uint8)) for r in held]
            for piece in ds.dataset(at, filesystem=files, format="parquet", partitioning=None).to_batches(batch_size=1):
                for r in piece.to_pylist():
                    qrows, qids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                    queries = np.frombuffer(r["exact"]).reshape(len(qids), r["dim"])
                    floor, found = np.full((len(qids), k), -np.inf), []
                    for dim, rows, ids, lo, step, cells in grids:
                        if dim == r["dim"]:
                            q, v, lower, upper = scan_cells(queries, qids, ids, lo, step, cells, k, floor)
                            found.append((q, rows[v], lower, upper))
                    if found:
                        q, v, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
                        some = upper >= floor[q, -1]  # the floor may have risen since
                        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (qids[q], qrows[q], v, lower, upper)], ["query_id", "query_row", "vec_row", "lower", "upper"])

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == AT_ONCE:
                    yield from scanned()
                    held = []
        if held:
            yield from scanned()

    return shared.written(packed.mapInArrow(run, CANDIDATES), "va-candidates")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row with all rows but its own.

    Components are floor(scale * x). Ties go to the smaller id; where there are fewer rows than k all are
    returned. Vectors that are null or hold null or non-finite components take no part, nor do rows
    with a null id; a vector meets only vectors of its length. Rows that repeat an id and a vector
    count once; different vectors of one id are candidates each, and never of that id's own query.
    Scores are exact while sums stay below 2**53. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    shared.arrow_batches(spark)
    rows = numbered(integer_vectors(vectors, id_col, vector, scale).distinct(), "vectors")
    asked = numbered(integer_vectors(vectors.filter(is_query), id_col, vector, scale).distinct(), "queries")
    packed = blocks(rows, "blocks", block, True).coalesce(max(1, -(-rows.count() // (block * AT_ONCE))))
    left = candidates(packed, blocks(asked, "asked", query_block, False), k)
    mine, row = W.partitionBy("query_id", "query_row"), F.row_number()
    floor = left.withColumn("n", row.over(mine.orderBy(F.col("lower").desc()))).filter(F.col("n") == k).select("query_row", F.col("lower").alias("floor"))
    left = left.join(floor, "query_row", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).drop("floor")
    left = shared.written(left.withColumn("place", row.over(mine.orderBy(F.col("upper").desc(), "vec_row"))), "va-candidates")
    best, width = None, READ
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    while not left.isEmpty():
        near = left.filter(F.col("place") <= width).select("query_id", "query_row", "vec_row")
        near = shared.written(near, "va-near")
        near = F.broadcast(near) if near.count() <= BROADCAST_NEAR else near  # else the vectors are dealt out to be joined
        near = near.join(rows.select(F.col("row").alias("vec_row"), F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_row")
        near = near.join(asked.select(F.col("row").alias("query_row"), F.col("v").alias("a")), "query_row")
        score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x).cast("long")
        seen = near.select("query_id", "query_row", "vec_id", score.alias("score"))
        seen = seen if best is None else seen.unionByName(best.drop("rank"))
        best = shared.written(seen.withColumn("rank", rank).filter(F.col("rank") <= k), "va-best")
        sure = best.filter(F.col("rank") == k).select("query_row", F.col("score").alias("sure"))
        left = left.filter(F.col("place") > width).join(sure, "query_row", "left").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure"))).drop("sure")
        left = shared.written(left.withColumn("place", row.over(mine.orderBy(F.col("upper").desc(), "vec_row"))), "va-candidates")
        width *= 2
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # different vectors of one id are one query
    return best.withColumn("rank", merged).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

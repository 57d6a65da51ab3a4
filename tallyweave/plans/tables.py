"""The test tables as the engine's logical tables.

The tables hold no labels, so operators run on analogous columns: an order is a template and a case, its lines are targets and
boxes. A line's box starts at (quantity, discount in hundredths) and is line-number wide and tax-in-hundredths + 1 high.
Lines of one order are numbered by all that tells them apart, so equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, idx, box, area, cx, cy, kind) of all lines."""
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    x1, y1 = F.col("l_quantity"), F.col("l_discount") * 100
    b = boxes.box(x1, y1, x1 + F.col("l_linenumber"), y1 + F.col("l_tax") * 100 + 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", idx.cast("long").alias("idx"), b.alias("box"), F.when(F.col("l_returnflag") == "N", "text").otherwise("svg").alias("kind"))
    return rows.select("*", boxes.area(F.col("box")).alias("area"), ((F.col("box.x1") + F.col("box.x2")) / 2).alias("cx"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("cy"))


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(odd boxes as expected, even ones as predicted)."""
    return rows.filter("idx % 2 = 1"), rows.filter("idx % 2 = 0")


#: line_boxes in SQL: b(l_orderkey, idx, x1, y1, x2, y2, kind, area, cx, cy), and e and p, its odd and even rows.
BOXES_SQL = f"""
    b0 AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS idx,
        l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_linenumber AS x2, l_discount * 100 + l_tax * 100 + 1 AS y2,
        CASE WHEN l_returnflag = 'N' THEN 'text' ELSE 'svg' END AS kind FROM lineitem),
    b AS (SELECT *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b0),
    e AS (SELECT * FROM b WHERE idx % 2 = 1), p AS (SELECT * FROM b WHERE idx % 2 = 0)"""

#: Pairs of e and p of one order that share area, with their measures.
PAIRS_SQL = f"""{BOXES_SQL},
    i AS (SELECT e.l_orderkey, e.idx AS l_idx, p.idx AS r_idx, e.area AS ea, p.area AS pa,
        greatest(least(e.x2, p.x2) - greatest(e.x1, p.x1), 0) * greatest(least(e.y2, p.y2) - greatest(e.y1, p.y1), 0) AS shared
        FROM e JOIN p USING (l_orderkey)),
    pairs AS (SELECT l_orderkey, l_idx, r_idx, shared / (ea + pa - shared) AS iou, shared / ea AS expected_coverage,
        shared / pa AS predicted_coverage, pa / ea AS area_ratio FROM i WHERE shared > 0)"""


def taken_in_order(pairs: str, case: str, order: str, columns: str, keep: str = "true", once: bool = False) -> str:
    """SQL (after WITH RECURSIVE ...,) of one-to-one matches: the pairs of a case in order, each taken if neither end is used. keep: whether a pair that comes to be judged is kept; once: a left end is judged once even if nothing is kept."""
    used = "list_contains(w.ul, r.l_idx) OR list_contains(w.ur, r.r_idx)"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {case} ORDER BY {order}) AS rn FROM ({pairs})),
    walk({case}, rn, ul, ur, kept) AS (
        SELECT DISTINCT {case}, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ranked UNION ALL
        SELECT w.{case}, r.rn, CASE WHEN {used} OR NOT ({'true' if once else keep}) THEN w.ul ELSE list_append(w.ul, CAST(r.l_idx AS BIGINT)) END,
            CASE WHEN {used} OR NOT ({keep}) THEN w.ur ELSE list_append(w.ur, CAST(r.r_idx AS BIGINT)) END,
            CASE WHEN {used} OR NOT ({keep}) THEN w.kept ELSE list_append(w.kept, r.rn) END
        FROM walk w JOIN ranked r ON r.{case} = w.{case} AND r.rn = w.rn + 1),
    done AS (SELECT {case}, unnest(arg_max(kept, rn)) AS rn FROM walk GROUP BY {case})
    SELECT {columns} FROM done JOIN ranked USING ({case}, rn)"""

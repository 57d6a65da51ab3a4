"""Matching boxes and items of one case: spatial joins, and one-to-one assignments.

A case is a label: a few hundred boxes at most. Joins are on the case with the spatial test as a residual, so
they are hash joins whose pairs never leave a case. Assignments depend on order, so they
run per case over the pairs that the join let through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes

from .cases import by_case


def overlapping(left: DataFrame, right: DataFrame, case: list[str], test) -> DataFrame:
    """Pairs (l_*, r_*) of rows of a case whose boxes (columns idx, box) pass ``test(left box, right box)``."""
    side = lambda df, p: df.select(*case, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in case])
    both = side(left, "l").join(side(right, "r"), case)
    return both.filter(test(F.col("l_box"), F.col("r_box")))


def box_pairs(expected: DataFrame, predicted: DataFrame, case: list[str]) -> DataFrame:
    """All pairs of a case that share area, with iou, both coverages and the area ratio."""
    pairs = overlapping(expected, predicted, case, lambda a, b: boxes.intersection(a, b) > 0)
    a, b = F.col("l_box"), F.col("r_box")
    return pairs.select("*", boxes.iou(a, b).alias("iou"), boxes.coverage(a, b).alias("expected_coverage"), boxes.coverage(b, a).alias("predicted_coverage"), boxes.area_ratio(a, b).alias("area_ratio"))


def strict_candidates(pairs: DataFrame, iou: float, coverage: float, max_ratio: float) -> DataFrame:
    """Pairs that match by IoU, or cover each other at like size; with their score."""
    both = (F.col("expected_coverage") >= coverage) & (F.col("predicted_coverage") >= coverage) & (F.col("area_ratio") <= max_ratio)
    score = F.col("iou") + 0.01 * F.least("expected_coverage", "predicted_coverage")
    return pairs.filter((F.col("iou") >= iou) | both).withColumn("score", score)


def greedy(pairs: DataFrame, case: list[str], order: list[Column]) -> DataFrame:
    """One-to-one matches of each case, in the order given; rows that come later lose."""
    left, right = pairs.columns.index("l_idx"), pairs.columns.index("r_idx")

    def take(rows: list[tuple]) -> list[tuple]:
        used_l, used_r, kept = set(), set(), []
        for row in rows:
            if row[left] not in used_l and row[right] not in used_r:
                used_l.add(row[left])
                used_r.add(row[right])
                kept.append(row)
        return kept

    return by_case(pairs, case, order, take, pairs.schema)


def match_strict(expected: DataFrame, predicted: DataFrame, case: list[str], iou: float = 0.5, coverage: float = 0.7, max_ratio: float = 3.0) -> DataFrame:
    """One-to-one matches by score, then coverages, then places, the greater first."""
    found = strict_candidates(box_pairs(expected, predicted, case), iou, coverage, max_ratio)
    slim = found.select(*case, "l_idx", "r_idx", "iou", "expected_coverage", "predicted_coverage", "area_ratio", "score")
    return greedy(slim, case, [F.col(c).desc() for c in ("score", "expected_coverage", "predicted_coverage", "l_idx", "r_idx")])


def match_overlap(expected: DataFrame, predicted: DataFrame, case: list[str], least: float = 0.3) -> DataFrame:
    """One-to-one matches by shared area over the smaller box, the greater first, then by place."""
    pairs = overlapping(expected, predicted, case, lambda a, b: boxes.overlap_of_smaller(a, b) >= least)
    scored = pairs.withColumn("score", boxes.overlap_of_smaller(F.col("l_box"), F.col("r_box")))
    return greedy(scored.select(*case, "l_idx", "r_idx", "score"), case, [F.col("score").desc(), F.col("l_idx"), F.col("r_idx")])


def cover_score() -> Column:
    return F.col("expected_coverage") + 0.01 * F.col("iou")


def match_coverage(expected: DataFrame, predicted: DataFrame, case: list[str], coverage: float = 0.7) -> DataFrame:
    """The best prediction of each expected box among those that cover it enough; a prediction may serve several."""
    found = box_pairs(expected, predicted, case).filter(F.col("expected_coverage") >= coverage).withColumn("score", cover_score())
    first = F.row_number().over(W.partitionBy(*case, "l_idx").orderBy(F.col("score").desc(), "r_idx"))
    return found.withColumn("_n", first).filter("_n = 1").drop("_n")


def extra_predictions(expected: DataFrame, predicted: DataFrame, case: list[str], coverage: float = 0.7) -> DataFrame:
    """Predictions that cover no expected box enough."""
    covering = box_pairs(expected, predicted, case).filter(F.col("expected_coverage") >= coverage).select(*case, F.col("r_idx").alias("idx"))
    return predicted.join(covering, [*case, "idx"], "left_anti")


def match_closed_loop(expected: DataFrame, predicted: DataFrame, case: list[str], text_coverage: float = 0.3, coverage: float = 0.7) -> DataFrame:
    """In order of the expected boxes, the best prediction not yet used; text (expected column kind) needs less coverage. Null in r_idx of an unmatched expected box is left out."""
    least = F.when(boxes.kind_class(F.col("l_kind")) == "text", text_coverage).otherwise(coverage)
    found = box_pairs(expected, predicted, case).filter(F.col("expected_coverage") >= least).withColumn("score", cover_score())

    slim = found.select(*case, "l_idx", "r_idx", "iou", "expected_coverage", "predicted_coverage", "area_ratio", "score")
    left, right = len(case), len(case) + 1

    def take(rows: list[tuple]) -> list[tuple]:
        served, used, kept = set(), set(), []
        for row in rows:
            if row[left] not in served and row[right] not in used:
                served.add(row[left])
                used.add(row[right])
                kept.append(row)
        return kept

    return by_case(slim, case, [F.col("l_idx"), F.col("score").desc(), F.col("r_idx")], take, slim.schema)


def missing(expected: DataFrame, matches: DataFrame, case: list[str]) -> DataFrame:
    return expected.join(matches.select(*case, F.col("l_idx").alias("idx")), [*case, "idx"], "left_anti")


def assign_least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost, by shortest augmenting paths with dual prices; rows or columns beyond the other side stay free."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign_least_cost(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        shortest, came_from, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, via = start, 0.0, -1
        while True:
            reach = base + cost[row] - row_price[row] - col_price
            better = ~done & (reach < shortest - 1e-15)
            shortest[better], came_from[better] = reach[better], via
            col = int(np.argmin(np.where(done, np.inf, shortest)))
            base, done[col], via = shortest[col], True, col
            if row_of[col] < 0:
                break
            row = row_of[col]
        row_price[start] += base
        for c in np.nonzero(done)[0]:
            if c != col:
                row_price[row_of[c]] += base - shortest[c]
            col_price[c] -= base - shortest[c]
        while col >= 0:
            before = came_from[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


REGION_WEIGHTS = {"centre": 0.35, "size": 0.25, "aspect": 0.20, "label": 0.20}


def region_cost(a: Column, b: Column, label_a: Column, label_b: Column, weights: dict[str, float] = REGION_WEIGHTS) -> Column:
    """Unlikeness of two regions in parts of their images: of middles, of areas, of shapes, and of labels; 0 for equal ones."""
    ma, mb = boxes.metrics(boxes.scaled(a, F.lit(1e6), F.lit(1e6))), boxes.metrics(boxes.scaled(b, F.lit(1e6), F.lit(1e6)))
    centre = F.least(F.sqrt(F.pow((ma["cx"] - mb["cx"]) / 1e6, 2) + F.pow((ma["cy"] - mb["cy"]) / 1e6, 2)) / F.sqrt(F.lit(2.0)), F.lit(1.0))
    part = lambda name: 1 - F.least(ma[name], mb[name]) / F.greatest(ma[name], mb[name])
    label = F.when(label_a.eqNullSafe(label_b), 0.0).otherwise(1.0)
    return weights["centre"] * centre + weights["size"] * part("area") + weights["aspect"] * part("aspect") + weights["label"] * label


def match_regions(left: DataFrame, right: DataFrame, case: list[str], most: float = 0.6) -> DataFrame:
    """The assignment of least total cost between regions (idx, box in parts of the image, label) of a case; pairs that cost ``most`` or more are dropped only afterwards."""
    pairs = overlapping(left, right, case, lambda a, b: F.lit(True)).withColumn("cost", region_cost(F.col("l_box"), F.col("r_box"), F.col("l_label"), F.col("r_label")))
    slim = pairs.select(*case, "l_idx", "r_idx", "cost")

    k = len(case)

    def take(rows: list[tuple]) -> list[tuple]:
        lefts, rights = sorted({r[k] for r in rows}), sorted({r[k + 1] for r in rows})
        place_l, place_r = {v: i for i, v in enumerate(lefts)}, {v: i for i, v in enumerate(rights)}
        cost = np.empty((len(lefts), len(rights)))
        for r in rows:
            cost[place_l[r[k]], place_r[r[k + 1]]] = r[k + 2]
        chosen = [(*rows[0][:k], lefts[i], rights[j], float(cost[i, j])) for i, j in assign_least_cost(cost)]
        return [c for c in chosen if c[-1] < most]

    return by_case(slim, case, [F.col("l_idx"), F.col("r_idx")], take, slim.schema)


def match_positions(left: DataFrame, right: DataFrame, case: list[str], most_cost: float = 0.16) -> DataFrame:
    """One-to-one matches of items (idx, cx, cy, w, h in parts of the image) by least distance, within gates that grow with the items; ties go by place."""
    side = lambda df, p: df.select(*case, *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "cx", "cy", "w", "h")])
    gap = lambda c: F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))
    most = lambda c, least, part: F.greatest(F.lit(least), F.greatest(f"l_{c}", f"r_{c}") * part)
    near = side(left, "l").join(side(right, "r"), case).filter((gap("cy") <= most("h", 0.035, 0.95)) & (gap("cx") <= most("w", 0.10, 0.90)))
    near = near.withColumn("cost", gap("cy") * 1.8 + gap("cx") + gap("w") * 0.35 + gap("h") * 0.25).filter(F.col("cost") <= most_cost)
    return greedy(near.select(*case, "l_idx", "r_idx", "cost"), case, [F.col("cost"), F.col("l_idx"), F.col("r_idx")])


def compare_sets(left: DataFrame, right: DataFrame, case: list[str], least: float = 0.5) -> DataFrame:
    """In order of the left boxes, the right box of greatest IoU not yet used, kept from ``least`` on; the earlier at a tie."""
    pairs = box_pairs(left, right, case).select(*case, "l_idx", "r_idx", "iou")
    k = len(case)

    def take(rows: list[tuple]) -> list[tuple]:
        used, served, kept = set(), set(), []
        for r in rows:
            if r[k] not in served and r[k + 1] not in used:
                served.add(r[k])
                if r[k + 2] >= least:
                    used.add(r[k + 1])
                    kept.append(r)
        return kept

    return by_case(pairs, case, [F.col("l_idx"), F.col("iou").desc(), F.col("r_idx")], take, pairs.schema)


def nearest_line(candidates: DataFrame, lines: DataFrame, case: list[str], overlap: float = 0.2, row_overlap: float = 0.5, most_gap: float = 80.0) -> DataFrame:
    """For each candidate (idx, box, cx, cy) the line (idx, box) it lies on: a line that holds its middle before one that overlaps it, before one of the same row nearby; the earlier line at a tie."""
    pairs = overlapping(candidates, lines, case, lambda a, b: F.lit(True))
    a, b = F.col("l_box"), F.col("r_box")
    cover = boxes.coverage(a, b)
    score = F.when(boxes.contains_point(b, F.col("l_cx"), F.col("l_cy")), 10 + cover).when(cover >= overlap, 1 + cover)
    score = score.when((boxes.vertical_overlap(a, b) >= row_overlap) & (boxes.horizontal_gap(a, b) <= most_gap), 1 - boxes.horizontal_gap(a, b) / (most_gap + 1))
    first = F.row_number().over(W.partitionBy(*case, "l_idx").orderBy(F.col("score").desc(), "r_idx"))
    return pairs.withColumn("score", score).filter("score IS NOT NULL").withColumn("_n", first).filter("_n = 1").drop("_n")


def smallest_container(inner: DataFrame, outer: DataFrame, case: list[str]) -> DataFrame:
    """For each inner box the smallest outer box that holds it wholly; the earlier at a tie."""
    holds = lambda a, b: (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"]) & (b["x2"] >= a["x2"]) & (b["y2"] >= a["y2"])
    pairs = overlapping(inner, outer, case, holds)
    return pairs.groupBy(*case, "l_idx").agg(F.min(F.struct(boxes.area(F.col("r_box")).alias("area"), "r_idx")).alias("_b")).select(*case, "l_idx", F.col("_b.r_idx").alias("r_idx"), F.col("_b.area").alias("area"))


def without_overlaps(rows: DataFrame, existing: DataFrame, case: list[str], iou: float = 0.15, coverage: float = 0.5) -> DataFrame:
    """rows (idx, box) that no existing box overlaps by IoU or covers."""
    hit = overlapping(rows, existing, case, lambda a, b: (boxes.iou(a, b) >= iou) | (boxes.coverage(a, b) >= coverage))
    return rows.join(hit.select(*case, F.col("l_idx").alias("idx")), [*case, "idx"], "left_anti")


def best_band(scored: DataFrame, by: list[str], score: str, least: float, band: float = 0.01) -> DataFrame:
    """Rows at or above ``least`` whose score is within ``band`` of the group's best; exact ones (score 1) alone where there are any."""
    top = F.max(score).over(W.partitionBy(*by))
    return scored.withColumn("_top", top).filter((F.col(score) >= least) & F.when(F.col("_top") >= 1, F.col(score) >= 1).otherwise(F.col(score) >= F.col("_top") - band)).drop("_top")


def set_ratios(left: DataFrame, right: DataFrame, matches: DataFrame, case: list[str]) -> DataFrame:
    """For each case of either set: the sizes of both, the matches, recall (of the left set) and precision (of the right); an empty set gives 0."""
    n = lambda df, name: df.groupBy(*case).agg(F.count(F.lit(1)).alias(name))
    out = n(left, "left_size").join(n(right, "right_size"), case, "full").join(n(matches, "matched"), case, "left").na.fill(0, ["left_size", "right_size", "matched"])
    part = lambda of: F.when(F.col(of) > 0, F.col("matched") / F.col(of)).otherwise(0.0)
    return out.withColumns({"recall": part("left_size"), "precision": part("right_size")})

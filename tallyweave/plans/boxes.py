"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes
from tallyweave.operators import evaluate, matching, merging

from .tables import BOXES_SQL, PAIRS_SQL, line_boxes, sides, table, taken_in_order

CASE = ["l_orderkey"]
_MEASURES = ["l_orderkey", "l_idx", "r_idx", "iou", "expected_coverage", "predicted_coverage", "area_ratio"]


def box_iou_pairs(spark, sf_dir) -> DataFrame:
    return matching.box_pairs(*sides(line_boxes(spark, sf_dir)), CASE).select(*_MEASURES)


def box_overlap_pairs(spark, sf_dir) -> DataFrame:
    """Items inside a region: more than one unit of area, 0.35 of it covered."""
    items, regions = sides(line_boxes(spark, sf_dir))
    found = matching.overlapping(items.filter("area > 1"), regions, CASE, lambda a, b: boxes.coverage(a, b) >= 0.35)
    return found.select("l_orderkey", "l_idx", "r_idx")


def best_cover_match(spark, sf_dir) -> DataFrame:
    found = matching.match_coverage(*sides(line_boxes(spark, sf_dir)), CASE, 0.5)
    return found.select("l_orderkey", "l_idx", "r_idx", "score")


def extra_predictions(spark, sf_dir) -> DataFrame:
    return matching.extra_predictions(*sides(line_boxes(spark, sf_dir)), CASE, 0.5).select("l_orderkey", "idx")


def strict_candidates(spark, sf_dir) -> DataFrame:
    pairs = matching.box_pairs(*sides(line_boxes(spark, sf_dir)), CASE)
    return matching.strict_candidates(pairs, 0.3, 0.5, 3.0).select("l_orderkey", "l_idx", "r_idx", "score")


def greedy_match(spark, sf_dir) -> DataFrame:
    return matching.match_strict(*sides(line_boxes(spark, sf_dir)), CASE, 0.3, 0.5, 3.0).select("l_orderkey", "l_idx", "r_idx", "score")


def overlap_match(spark, sf_dir) -> DataFrame:
    return matching.match_overlap(*sides(line_boxes(spark, sf_dir)), CASE).select("l_orderkey", "l_idx", "r_idx", "score")


def closed_loop_match(spark, sf_dir) -> DataFrame:
    return matching.match_closed_loop(*sides(line_boxes(spark, sf_dir)), CASE).select("l_orderkey", "l_idx", "r_idx", "score")


def missing_boxes(spark, sf_dir) -> DataFrame:
    """Expected boxes that no prediction covers by half."""
    e, p = sides(line_boxes(spark, sf_dir))
    return matching.missing(e, matching.match_coverage(e, p, CASE, 0.5), CASE).select("l_orderkey", "idx")


def _unit(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "idx", boxes.to_unit(F.col("box"), F.lit(60.0), F.lit(30.0)).alias("box"), F.col("kind").alias("label"))


def region_assignment(spark, sf_dir) -> DataFrame:
    e, p = sides(line_boxes(spark, sf_dir))
    return matching.match_regions(_unit(e), _unit(p), CASE).select("l_orderkey", "l_idx", "r_idx", "cost")


def region_costs(spark, sf_dir) -> DataFrame:
    """What an assignment weighs: unlikeness of all pairs of a case."""
    e, p = map(_unit, sides(line_boxes(spark, sf_dir)))
    pairs = matching.overlapping(e, p, CASE, lambda a, b: F.lit(True))
    cost = matching.region_cost(F.col("l_box"), F.col("r_box"), F.col("l_label"), F.col("r_label"))
    return pairs.select("l_orderkey", "l_idx", "r_idx", F.round(cost, 9).alias("cost"))


def position_match(spark, sf_dir) -> DataFrame:
    def items(rows: DataFrame) -> DataFrame:
        b = F.col("box")
        return _unit(rows).select("l_orderkey", "idx", ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))

    e, p = sides(line_boxes(spark, sf_dir))
    return matching.match_positions(items(e), items(p), CASE).select("l_orderkey", "l_idx", "r_idx", F.round("cost", 9).alias("cost"))


def region_sets(spark, sf_dir) -> DataFrame:
    """Two region sets of a case matched in order."""
    return matching.compare_sets(*sides(line_boxes(spark, sf_dir)), CASE, 0.2)


def region_set_ratios(spark, sf_dir) -> DataFrame:
    """Recall and precision of two region sets of a case."""
    e, p = sides(line_boxes(spark, sf_dir))
    out = matching.set_ratios(e, p, matching.compare_sets(e, p, CASE, 0.2), CASE)
    return out.select("l_orderkey", "left_size", "right_size", "matched", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def regions_split(spark, sf_dir) -> DataFrame:
    """Lines as regions: every fifth a barcode, every third of them mixed of a barcode and a rest."""
    b = F.col("box")
    half = lambda x1, x2, c: F.struct(boxes.box(x1, b["y1"], x2, b["y2"]).alias("box"), F.lit(c).alias("barcode"))
    mid = (b["x1"] + b["x2"]) / 2
    rows = line_boxes(spark, sf_dir).select("l_orderkey", F.col("idx").alias("original_idx"), "box", (F.col("idx") % 5 == 0).alias("bar"), F.when(F.col("idx") % 3 == 0, F.array(half(b["x1"], mid, True), half(mid, b["x2"], False))).alias("parts"))
    fine, skipped = evaluate.split_regions(rows, F.col("bar"), F.col("parts"))
    shown = lambda df, reason: df.select("l_orderkey", "original_idx", F.col("box.x1").alias("x1"), F.col("box.x2").alias("x2"), reason)
    return shown(fine, F.lit(None).cast("string").alias("reason")).unionByName(shown(skipped, F.col("reason")))


def barcode_clusters(spark, sf_dir) -> DataFrame:
    """Orders as parents, their lines as fragments of the box about them."""
    about = line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(boxes.union_all(F.col("box")).alias("p")).select("l_orderkey", (boxes.width(F.col("p")) / boxes.height(F.col("p"))).alias("parent_aspect"), boxes.height(F.col("p")).alias("parent_h"))
    b = F.col("box")
    rows = line_boxes(spark, sf_dir).select("l_orderkey", (boxes.width(b) / boxes.height(b)).alias("aspect"), boxes.height(b).alias("h"), F.lit(0.5).alias("dark")).join(about, "l_orderkey")
    return evaluate.barcode_cluster(rows, CASE)


def nearest_line(spark, sf_dir) -> DataFrame:
    e, p = sides(line_boxes(spark, sf_dir))
    found = matching.nearest_line(e, p.select("l_orderkey", "idx", "box"), CASE, most_gap=20.0)
    return found.select("l_orderkey", "l_idx", "r_idx", F.round("score", 9).alias("score"))


def smallest_container(spark, sf_dir) -> DataFrame:
    e, p = sides(line_boxes(spark, sf_dir))
    grown = p.withColumn("box", boxes.expand(F.col("box"), 10.0))
    return matching.smallest_container(e, grown, CASE).select("l_orderkey", "l_idx", "r_idx")


def duplicate_suppression(spark, sf_dir) -> DataFrame:
    e, p = sides(line_boxes(spark, sf_dir))
    return matching.without_overlaps(e, p, CASE).select("l_orderkey", "idx")


def box_components(spark, sf_dir) -> DataFrame:
    grouped = merging.component_of(line_boxes(spark, sf_dir), CASE, lambda a, b: merging.near(a, b, 6))
    return grouped.select("l_orderkey", "idx", F.col("component").cast("long").alias("component"))


def merged_boxes(spark, sf_dir) -> DataFrame:
    grouped = merging.component_of(line_boxes(spark, sf_dir), CASE, lambda a, b: merging.near(a, b, 6))
    r = lambda c, n: F.round(F.col(c) + 1e-9, 6).alias(n)  # noqa: E731  engines differ on halves
    out = merging.merged(grouped, CASE)
    return out.select("l_orderkey", F.col("component").cast("long").alias("component"), *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES], r("area", "area"), r("density", "density"), r("cx", "cx"), r("cy", "cy"), "child_count")


def representative_boxes(spark, sf_dir) -> DataFrame:
    """Groups of display boxes, each by its largest member."""
    grouped = merging.component_of(line_boxes(spark, sf_dir), CASE, merging.same_display)
    out = merging.representative(grouped, CASE, ["idx", "kind"])
    return out.select("l_orderkey", F.col("component").cast("long").alias("component"), F.col("idx").cast("long").alias("idx"), "kind", *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES])


def merged_parts(spark, sf_dir) -> DataFrame:
    """Fragments joined while what has grown touches another."""
    rows = line_boxes(spark, sf_dir).select("l_orderkey", *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES])
    return merging.merge_parts(rows, CASE, 60.0, 30.0)


def review_groups(spark, sf_dir) -> DataFrame:
    rows = line_boxes(spark, sf_dir).select("l_orderkey", "idx", *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES])
    return merging.review_groups(rows, CASE, 500.0, 100.0).select("l_orderkey", "idx", "review_group")


def line_runs(spark, sf_dir) -> DataFrame:
    """Runs of line numbers without a gap."""
    return merging.runs(table(spark, sf_dir, "lineitem"), CASE, "l_linenumber").select("l_orderkey", "first", "last", "length")


def box_clips(spark, sf_dir) -> DataFrame:
    """The four clip rules on one image, as areas (null where a rule drops the box)."""
    b, w, h = F.col("box"), F.lit(40.0), F.lit(8.0)
    rules = {"cut": boxes.clip_or_null(b, w, h), "least": boxes.clip_min_size(b, w, h, 3.0), "always": boxes.clip_always(b, w, h), "ordered": boxes.clip_ordered(b, w, h)}
    return line_boxes(spark, sf_dir).select("l_orderkey", "idx", *[F.round(boxes.area(r), 6).alias(n) for n, r in rules.items()])


def coordinate_modes(spark, sf_dir) -> DataFrame:
    b = boxes.scaled(F.col("box"), F.when(F.col("idx") % 3 == 0, 0.01).when(F.col("idx") % 3 == 1, 15.0).otherwise(1.0), F.when(F.col("idx") % 3 == 0, 0.01).when(F.col("idx") % 3 == 1, 15.0).otherwise(1.0))
    rows = line_boxes(spark, sf_dir).withColumn("sent", b)
    return rows.select("l_orderkey", "idx", boxes.coordinate_mode(F.col("sent"), F.lit(100.0), F.lit(100.0)).alias("mode"))


def fragment_classes(spark, sf_dir) -> DataFrame:
    return line_boxes(spark, sf_dir).select("l_orderkey", "idx", boxes.fragment_class(F.col("box"), 6.0, 2.0, 0.25).alias("reason"))


def box_shapes(spark, sf_dir) -> DataFrame:
    m = boxes.metrics(F.col("box"))
    return line_boxes(spark, sf_dir).select("l_orderkey", "idx", *[F.round(m[c], 9).alias(c) for c in ("w", "h", "area", "aspect", "cx", "cy")])


def largest_boxes(spark, sf_dir) -> DataFrame:
    """The two largest boxes of each case."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.col("area").desc(), "idx"))
    return line_boxes(spark, sf_dir).withColumn("rank", n).filter("rank <= 2").select("l_orderkey", "rank", "idx")


def region_offsets(spark, sf_dir) -> DataFrame:
    e, p = sides(line_boxes(spark, sf_dir))
    out = evaluate.region_offsets(matching.box_pairs(e, p, CASE), CASE)
    return out.select("l_orderkey", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("dx", "dy", "sx", "sy")])


_NEAR = "greatest(0, a.x1 - b.x2, b.x1 - a.x2) <= 6 AND greatest(0, a.y1 - b.y2, b.y1 - a.y2) <= 4"
_V = "(CASE WHEN least(a.y2 - a.y1, b.y2 - b.y1) > 0 THEN greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / least(a.y2 - a.y1, b.y2 - b.y1) ELSE 0 END)"
_S = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_DISPLAY = f"((CASE WHEN least(a.area, b.area) > 0 THEN {_S} / least(a.area, b.area) ELSE 0 END) >= 0.15 OR ({_V} >= 0.55 AND greatest(0, a.x1 - b.x2, b.x1 - a.x2) <= 18))"


def _components(test: str) -> str:
    return f"""{BOXES_SQL},
    links AS (SELECT a.l_orderkey, a.idx AS u, b.idx AS v FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND {test}),
    reach(l_orderkey, idx, other) AS (
        SELECT l_orderkey, idx, idx FROM b UNION
        SELECT r.l_orderkey, r.idx, l.v FROM reach r JOIN links l ON r.l_orderkey = l.l_orderkey AND r.other = l.u),
    comp AS (SELECT l_orderkey, idx, CAST(min(other) AS BIGINT) AS component FROM reach GROUP BY ALL)"""


_COST = """0.35 * least(sqrt(power(e.cx / 60 - p.cx / 60, 2) + power(e.cy / 30 - p.cy / 30, 2)) / sqrt(2), 1)
    + 0.25 * (1 - least(e.area, p.area) / greatest(e.area, p.area))
    + 0.20 * (1 - least((e.x2 - e.x1) / (e.y2 - e.y1), (p.x2 - p.x1) / (p.y2 - p.y1)) / greatest((e.x2 - e.x1) / (e.y2 - e.y1), (p.x2 - p.x1) / (p.y2 - p.y1)))
    + 0.20 * CASE WHEN e.kind = p.kind THEN 0 ELSE 1 END"""

QUERIES = {
    "box_iou_pairs": (box_iou_pairs, f"WITH {PAIRS_SQL} SELECT * FROM pairs"),
    "box_overlap_pairs": (box_overlap_pairs, f"WITH {BOXES_SQL} SELECT a.l_orderkey, a.idx AS l_idx, b.idx AS r_idx FROM e a JOIN p b USING (l_orderkey) WHERE a.area > 1 AND {_S} / a.area >= 0.35"),
    "best_cover_match": (best_cover_match, f"""WITH {PAIRS_SQL}, s AS (SELECT *, expected_coverage + 0.01 * iou AS score FROM pairs WHERE expected_coverage >= 0.5)
        SELECT l_orderkey, l_idx, r_idx, score FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_idx ORDER BY score DESC, r_idx) = 1"""),
    "extra_predictions": (extra_predictions, f"WITH {PAIRS_SQL} SELECT l_orderkey, idx FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs s WHERE s.l_orderkey = p.l_orderkey AND s.r_idx = p.idx AND expected_coverage >= 0.5)"),
    "strict_candidates": (strict_candidates, f"""WITH {PAIRS_SQL} SELECT l_orderkey, l_idx, r_idx, iou + 0.01 * least(expected_coverage, predicted_coverage) AS score FROM pairs
        WHERE iou >= 0.3 OR (expected_coverage >= 0.5 AND predicted_coverage >= 0.5 AND area_ratio <= 3)"""),
    "greedy_match": (greedy_match, f"WITH RECURSIVE {PAIRS_SQL}, " + taken_in_order("""SELECT *, iou + 0.01 * least(expected_coverage, predicted_coverage) AS score FROM pairs WHERE iou >= 0.3 OR (expected_coverage >= 0.5 AND predicted_coverage >= 0.5 AND area_ratio <= 3)""",
        "l_orderkey", "score DESC, expected_coverage DESC, predicted_coverage DESC, l_idx DESC, r_idx DESC", "l_orderkey, l_idx, r_idx, score")),
    "overlap_match": (overlap_match, f"WITH RECURSIVE {PAIRS_SQL}, " + taken_in_order("SELECT l_orderkey, l_idx, r_idx, shared / least(ea, pa) AS score FROM i WHERE shared > 0 AND shared / least(ea, pa) >= 0.3",
        "l_orderkey", "score DESC, l_idx, r_idx", "l_orderkey, l_idx, r_idx, score")),
    "closed_loop_match": (closed_loop_match, f"WITH RECURSIVE {PAIRS_SQL}, " + taken_in_order("""SELECT s.*, expected_coverage + 0.01 * iou AS score FROM pairs s JOIN e ON e.l_orderkey = s.l_orderkey AND e.idx = s.l_idx
        WHERE expected_coverage >= CASE WHEN kind = 'text' THEN 0.3 ELSE 0.7 END""", "l_orderkey", "l_idx, score DESC, r_idx", "l_orderkey, l_idx, r_idx, score")),
    "missing_boxes": (missing_boxes, f"WITH {PAIRS_SQL} SELECT l_orderkey, idx FROM e WHERE NOT EXISTS (SELECT 1 FROM pairs s WHERE s.l_orderkey = e.l_orderkey AND s.l_idx = e.idx AND expected_coverage >= 0.5)"),
    "region_assignment": (region_assignment, None),
    "region_costs": (region_costs, f"WITH {BOXES_SQL} SELECT l_orderkey, e.idx AS l_idx, p.idx AS r_idx, round({_COST}, 9) AS cost FROM e JOIN p USING (l_orderkey)"),
    "position_match": (position_match, f"WITH RECURSIVE {BOXES_SQL}, q AS (SELECT l_orderkey, idx, x1 * (1.0::DOUBLE / 60) AS x1, x2 * (1.0::DOUBLE / 60) AS x2, y1 * (1.0::DOUBLE / 30) AS y1, y2 * (1.0::DOUBLE / 30) AS y2 FROM b), " + taken_in_order("""SELECT * FROM (
        SELECT s.l_orderkey, s.idx AS l_idx, t.idx AS r_idx, abs((s.y1 + s.y2) / 2 - (t.y1 + t.y2) / 2) AS gy, abs((s.x1 + s.x2) / 2 - (t.x1 + t.x2) / 2) AS gx, greatest(s.y2 - s.y1, t.y2 - t.y1) AS h, greatest(s.x2 - s.x1, t.x2 - t.x1) AS w,
        gy * 1.8 + gx + abs((s.x2 - s.x1) - (t.x2 - t.x1)) * 0.35 + abs((s.y2 - s.y1) - (t.y2 - t.y1)) * 0.25 AS cost FROM q s JOIN q t USING (l_orderkey) WHERE s.idx % 2 = 1 AND t.idx % 2 = 0)
        WHERE gy <= greatest(0.035, h * 0.95) AND gx <= greatest(0.1, w * 0.9) AND cost <= 0.16""", "l_orderkey", "cost, l_idx, r_idx", "l_orderkey, l_idx, r_idx, round(cost, 9) AS cost")),
    "region_sets": (region_sets, f"WITH RECURSIVE {PAIRS_SQL}, " + taken_in_order("SELECT * FROM pairs", "l_orderkey", "l_idx, iou DESC, r_idx", "l_orderkey, l_idx, r_idx, iou", "r.iou >= 0.2", True)),
    "region_set_ratios": (region_set_ratios, f"""WITH RECURSIVE {PAIRS_SQL}, m AS (SELECT l_orderkey, count(*) AS matched FROM (WITH RECURSIVE {taken_in_order("SELECT * FROM pairs", "l_orderkey", "l_idx, iou DESC, r_idx", "l_orderkey", "r.iou >= 0.2", True)}) GROUP BY l_orderkey),
        n AS (SELECT l_orderkey, count(*) FILTER (idx % 2 = 1) AS left_size, count(*) FILTER (idx % 2 = 0) AS right_size FROM b GROUP BY l_orderkey)
        SELECT l_orderkey, left_size, right_size, coalesce(matched, 0) AS matched, round(CASE WHEN left_size > 0 THEN coalesce(matched, 0) / left_size ELSE 0 END, 9) AS recall,
            round(CASE WHEN right_size > 0 THEN coalesce(matched, 0) / right_size ELSE 0 END, 9) AS precision FROM n LEFT JOIN m USING (l_orderkey)"""),
    "regions_split": (regions_split, f"""WITH {BOXES_SQL} SELECT l_orderkey, idx AS original_idx, x1, x2, CASE WHEN idx % 5 = 0 THEN 'barcode' END AS reason FROM b WHERE idx % 3 <> 0
        UNION ALL SELECT l_orderkey, idx, x1, (x1 + x2) / 2, 'barcode' FROM b WHERE idx % 3 = 0 UNION ALL SELECT l_orderkey, idx, (x1 + x2) / 2, x2, NULL FROM b WHERE idx % 3 = 0"""),
    "barcode_clusters": (barcode_clusters, f"""WITH {BOXES_SQL}, u AS (SELECT l_orderkey, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM b GROUP BY l_orderkey)
        SELECT l_orderkey, count(*) >= 3 AND max(u.w / u.h) >= 2.8 AND count(*) FILTER ((x2 - x1) / (y2 - y1) < 0.7) * 2 >= count(*) AND count(*) FILTER (y2 - y1 >= u.h * 0.5) * 2 >= count(*) AS cluster FROM b JOIN u USING (l_orderkey) GROUP BY l_orderkey"""),
    "nearest_line": (nearest_line, f"""WITH {BOXES_SQL}, s AS (SELECT a.l_orderkey, a.idx AS l_idx, b.idx AS r_idx,
            CASE WHEN a.cx BETWEEN b.x1 AND b.x2 AND a.cy BETWEEN b.y1 AND b.y2 THEN 10 + {_S} / a.area
                 WHEN {_S} / a.area >= 0.2 THEN 1 + {_S} / a.area
                 WHEN {_V} >= 0.5 AND greatest(0, a.x1 - b.x2, b.x1 - a.x2) <= 20 THEN 1 - greatest(0, a.x1 - b.x2, b.x1 - a.x2) / 21 END AS score
            FROM e a JOIN p b USING (l_orderkey))
        SELECT l_orderkey, l_idx, r_idx, round(score, 9) AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_idx ORDER BY s.score DESC, r_idx) = 1"""),
    "smallest_container": (smallest_container, f"""WITH {BOXES_SQL}, g AS (SELECT l_orderkey, idx, x1 - 10 AS x1, y1 - 10 AS y1, x2 + 10 AS x2, y2 + 10 AS y2 FROM p)
        SELECT e.l_orderkey, e.idx AS l_idx, g.idx AS r_idx FROM e JOIN g ON e.l_orderkey = g.l_orderkey AND g.x1 <= e.x1 AND g.y1 <= e.y1 AND g.x2 >= e.x2 AND g.y2 >= e.y2
        QUALIFY row_number() OVER (PARTITION BY e.l_orderkey, e.idx ORDER BY (g.x2 - g.x1) * (g.y2 - g.y1), g.idx) = 1"""),
    "duplicate_suppression": (duplicate_suppression, f"""WITH {PAIRS_SQL} SELECT l_orderkey, idx FROM e WHERE NOT EXISTS (
        SELECT 1 FROM pairs s WHERE s.l_orderkey = e.l_orderkey AND s.l_idx = e.idx AND (iou >= 0.15 OR expected_coverage >= 0.5))"""),
    "box_components": (box_components, f"WITH RECURSIVE {_components(_NEAR)} SELECT * FROM comp"),
    "merged_boxes": (merged_boxes, f"""WITH RECURSIVE {_components(_NEAR)} SELECT l_orderkey, component, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
        round(sum(area) + 1e-9, 6) AS area, round(sum(area) / greatest((max(x2) - min(x1)) * (max(y2) - min(y1)), 1) + 1e-9, 6) AS density,
        round(CASE WHEN sum(area) > 0 THEN sum(cx * area) / sum(area) ELSE (min(x1) + max(x2)) / 2 END + 1e-9, 6) AS cx,
        round(CASE WHEN sum(area) > 0 THEN sum(cy * area) / sum(area) ELSE (min(y1) + max(y2)) / 2 END + 1e-9, 6) AS cy, count(*) AS child_count
        FROM comp JOIN b USING (l_orderkey, idx) GROUP BY l_orderkey, component"""),
    "representative_boxes": (representative_boxes, f"""WITH RECURSIVE {_components(_DISPLAY)}, m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, component ORDER BY area DESC, idx) AS n FROM comp JOIN b USING (l_orderkey, idx))
        SELECT l_orderkey, component, max(CASE WHEN n = 1 THEN idx END) AS idx, max(CASE WHEN n = 1 THEN kind END) AS kind, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM m GROUP BY l_orderkey, component"""),
    "merged_parts": (merged_parts, None),
    "review_groups": (review_groups, None),
    "line_runs": (line_runs, """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d)
        SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM g GROUP BY l_orderkey, g"""),
    "box_clips": (box_clips, f"""WITH {BOXES_SQL}, c AS (SELECT l_orderkey, idx, x1, y1, least(greatest(x1, 0), 40) AS a1, least(greatest(y1, 0), 8) AS b1, least(greatest(x2, 0), 40) AS a2, least(greatest(y2, 0), 8) AS b2, x2, y2 FROM b),
        g AS (SELECT *, CASE WHEN a2 - a1 < 3 THEN greatest(least((a1 + a2) / 2 - 1.5, 37), 0) ELSE a1 END AS g1, CASE WHEN b2 - b1 < 3 THEN greatest(least((b1 + b2) / 2 - 1.5, 5), 0) ELSE b1 END AS h1,
            least(greatest(x1, 0), 39) AS f1, least(greatest(y1, 0), 7) AS k1 FROM c),
        r AS (SELECT *, CASE WHEN a2 - a1 < 3 THEN least(g1 + 3, 40) ELSE a2 END AS g2, CASE WHEN b2 - b1 < 3 THEN least(h1 + 3, 8) ELSE b2 END AS h2 FROM g)
        SELECT l_orderkey, idx, CASE WHEN a2 > a1 AND b2 > b1 THEN round((a2 - a1) * (b2 - b1), 6) END AS cut,
            CASE WHEN g2 - g1 >= 3 AND h2 - h1 >= 3 THEN round((g2 - g1) * (h2 - h1), 6) END AS least,
            round((least(greatest(x2, f1 + 1), 40) - f1) * (least(greatest(y2, k1 + 1), 8) - k1), 6) AS always,
            CASE WHEN a2 > a1 AND b2 > b1 THEN round((a2 - a1) * (b2 - b1), 6) END AS ordered FROM r"""),
    "coordinate_modes": (coordinate_modes, f"""WITH {BOXES_SQL}, s AS (SELECT l_orderkey, idx, CASE idx % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 15.0 ELSE 1.0 END AS s, x2, y2 FROM b), t AS (SELECT *, x2 * s AS a, y2 * s AS c FROM s)
        SELECT l_orderkey, idx, CASE WHEN greatest(a, c) <= 1.5 THEN 'ratio' WHEN greatest(a, c) <= 1001 AND (a > 100 OR c > 100) THEN 'permille' ELSE 'pixel' END AS mode FROM t"""),
    "fragment_classes": (fragment_classes, f"""WITH {BOXES_SQL}, s AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b)
        SELECT l_orderkey, idx, CASE WHEN w * h < 6 THEN 'small_area' WHEN least(w, h) < 2 THEN 'small_side' WHEN least(w, h) < greatest(w, h) * 0.25 THEN 'thin_sliver' END AS reason FROM s"""),
    "box_shapes": (box_shapes, f"""WITH {BOXES_SQL}, s AS (SELECT *, greatest(x2 - x1, 1) AS w, greatest(y2 - y1, 1) AS h FROM b)
        SELECT l_orderkey, idx, round(w, 9) AS w, round(h, 9) AS h, round(w * h, 9) AS area, round(w / h, 9) AS aspect, round(cx, 9) AS cx, round(cy, 9) AS cy FROM s"""),
    "largest_boxes": (largest_boxes, f"WITH {BOXES_SQL}, r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, idx) AS INT) AS rank, idx FROM b) SELECT * FROM r WHERE rank <= 2"),
    "region_offsets": (region_offsets, f"""WITH {PAIRS_SQL}, m AS (SELECT l_orderkey, p.cx - e.cx AS dx, p.cy - e.cy AS dy, (p.x2 - p.x1) / (e.x2 - e.x1) AS sx, (p.y2 - p.y1) / (e.y2 - e.y1) AS sy
            FROM pairs s JOIN e USING (l_orderkey) JOIN p USING (l_orderkey) WHERE e.idx = s.l_idx AND p.idx = s.r_idx)
        SELECT l_orderkey, round(median(dx) + 1e-9, 6) AS dx, round(median(dy) + 1e-9, 6) AS dy, round(greatest(0.5, least(1.8, median(sx))) + 1e-9, 6) AS sx, round(greatest(0.5, least(1.8, median(sy))) + 1e-9, 6) AS sy FROM m GROUP BY l_orderkey"""),
}

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import boxes
from tallyweave.operators import evaluate, matching, merging

BOX = "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, kind string"


def some_boxes(seed, n, case=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(0, 30), rnd.randint(0, 12)
        out.append((case, i, (float(x), float(y), float(x + rnd.randint(1, 9)), float(y + rnd.randint(1, 6))), rnd.choice(["text", "svg"])))
    return out


def measures(a, b):
    s = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda t: (t[2] - t[0]) * (t[3] - t[1])
    return s / (area(a) + area(b) - s), s / area(a), s / area(b), area(b) / area(a)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*v):
    return boxes.box(*[F.lit(float(x)) for x in v])


def test_iou_edges(spark):
    assert value(spark, boxes.iou(lit(0, 0, 2, 2), lit(0, 0, 2, 2))) == 1.0
    assert value(spark, boxes.iou(lit(0, 0, 2, 2), lit(2, 0, 4, 2))) == 0.0
    assert value(spark, boxes.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0.0
    assert value(spark, boxes.normalise(lit(3, 4, 1, 2))).asDict() == {"x1": 1, "y1": 2, "x2": 3, "y2": 4}
    assert value(spark, boxes.normalise(lit(1, 2, 1, 4))) is None and value(spark, boxes.normalise_int(lit(0.4, 0, 0.45, 9))) is None


def test_coordinates(spark):
    mode = lambda *v: value(spark, boxes.coordinate_mode(lit(*v), F.lit(800.0), F.lit(600.0)))
    assert mode(0.1, 0.1, 0.5, 1.0) == "ratio" and mode(10, 10, 900, 990) == "permille" and mode(10, 10, 790, 590) == "pixel"
    got = value(spark, boxes.to_pixels(lit(0.5, 0.5, 1, 1), F.lit(800.0), F.lit(600.0), F.lit("ratio"))).asDict()
    assert got == {"x1": 400, "y1": 300, "x2": 800, "y2": 600}
    poly = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((1.0, 5.0), (4.0, 2.0), (3.0, 9.0))])
    assert value(spark, boxes.polygon_bounds(poly)).asDict() == {"x1": 1, "y1": 2, "x2": 4, "y2": 9}
    assert value(spark, boxes.from_array(F.array(F.lit(1.0), F.lit(2.0)))) is None


def test_clips(spark):
    b, w, h = lit(-5, 2, 1, 4), F.lit(10.0), F.lit(10.0)
    assert tuple(value(spark, boxes.clip_or_null(b, w, h))) == (0, 2, 1, 4)
    assert value(spark, boxes.clip_or_null(lit(-5, 2, -1, 4), w, h)) is None
    assert tuple(value(spark, boxes.clip_min_size(b, w, h, 4.0))) == (0, 1, 4, 5)
    assert tuple(value(spark, boxes.clip_always(lit(20, 20, 30, 30), w, h))) == (9, 9, 10, 10)


def greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for *_, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.add((i, j))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_brute_force(spark, seed):
    e, p = [], []
    for case in range(5):
        e += some_boxes(seed * 10 + case, 7, case)
        p += some_boxes(seed * 10 + case + 500, 9, case)
    left, right = spark.createDataFrame(e, BOX), spark.createDataFrame(p, BOX).repartition(3)
    pairs = lambda df: {(r["case_id"], r["l_idx"], r["r_idx"]) for r in df.collect()}
    strict, closed, cover = set(), set(), set()
    for case in range(5):
        mine = [(a[1], b[1], measures(a[2], b[2]), a[3]) for a in e for b in p if a[0] == b[0] == case]
        found = [(m[0] + 0.01 * min(m[1], m[2]), m[1], m[2], i, j) for i, j, m, _ in mine if m[0] >= 0.2 or (m[1] >= 0.4 and m[2] >= 0.4 and m[3] <= 3)]
        strict |= {(case, i, j) for i, j in greedy(sorted(found, reverse=True))}
        used = set()
        for i in range(7):
            ok = [(-(m[1] + 0.01 * m[0]), j) for a, j, m, kind in mine if a == i and m[0] > 0 and m[1] >= (0.3 if kind == "text" else 0.7)]
            free = sorted(t for t in ok if t[1] not in used)
            if free:
                used.add(free[0][1])
                closed.add((case, i, free[0][1]))
            best = sorted((-(m[1] + 0.01 * m[0]), j) for a, j, m, _ in mine if a == i and m[1] >= 0.5)
            if best:
                cover.add((case, i, best[0][1]))
    assert pairs(matching.match_strict(left, right, ["case_id"], 0.2, 0.4, 3.0)) == strict
    assert pairs(matching.match_closed_loop(left, right, ["case_id"])) == closed
    assert pairs(matching.match_coverage(left, right, ["case_id"], 0.5)) == cover
    matched = matching.match_coverage(left, right, ["case_id"], 0.5)
    assert matched.count() + matching.missing(left, matched, ["case_id"]).count() == len(e)


@pytest.mark.parametrize("seed", range(25))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2).tolist()
    cost = rng.random((n, m)).round(1 if seed % 2 else 6)
    rows = matching.assign_least_cost(cost)
    k = min(n, m)
    best = min(sum(cost[r, c] for r, c in zip(rs, cs)) for rs in itertools.permutations(range(n), k) for cs in itertools.combinations(range(m), k)) if k else 0
    assert len(rows) == k == len({r for r, _ in rows}) == len({c for _, c in rows})
    assert abs(sum(cost[r, c] for r, c in rows) - best) < 1e-9


def test_regions(spark):
    unit = "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, label string"
    left = spark.createDataFrame([(1, 0, (0.0, 0.0, 0.2, 0.2), "a"), (1, 1, (0.5, 0.5, 0.9, 0.9), "b")], unit)
    same = matching.match_regions(left, left, ["case_id"]).collect()
    assert {(r["l_idx"], r["r_idx"]) for r in same} == {(0, 0), (1, 1)} and all(r["cost"] == 0 for r in same)
    far = spark.createDataFrame([(1, 0, (0.95, 0.95, 1.0, 0.96), "z")], unit)
    assert matching.match_regions(left, far, ["case_id"]).count() <= 1
    assert matching.match_regions(left.filter("idx = 0"), far, ["case_id"]).count() == 0


def test_components(spark):
    rows = spark.createDataFrame([r for c in range(6) for r in some_boxes(c, 14, c)], BOX)
    got = {(r["case_id"], r["idx"]): r["component"] for r in merging.component_of(rows, ["case_id"], lambda a, b: merging.near(a, b, 2)).collect()}
    for c in range(6):
        items = some_boxes(c, 14, c)
        group = {i: i for _, i, _, _ in items}
        for _, i, a, _ in items:
            for _, j, b, _ in items:
                if max(0, a[0] - b[2], b[0] - a[2]) <= 2 and max(0, a[1] - b[3], b[1] - a[3]) <= 4:
                    x, y = sorted((group[i], group[j]))
                    group = {k: x if g == y else g for k, g in group.items()}
        assert {i: got[c, i] for i in group} == group


def test_merged_boxes(spark):
    rows = spark.createDataFrame([(1, 0, (0.0, 0.0, 2.0, 2.0), 4.0, 1.0, 1.0), (1, 1, (3.0, 0.0, 5.0, 2.0), 12.0, 4.0, 1.0), (2, 0, (0.0, 0.0, 2.0, 4.0), 0.0, 9.0, 9.0)], "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, area double, cx double, cy double")
    out = {r["case_id"]: r for r in merging.merged(merging.component_of(rows, ["case_id"], lambda a, b: merging.near(a, b, 2)), ["case_id"]).collect()}
    assert tuple(out[1]["box"]) == (0, 0, 5, 2) and out[1]["area"] == 16 and out[1]["cx"] == 3.25 and out[1]["child_count"] == 2 and out[1]["density"] == 1.6
    assert (out[2]["cx"], out[2]["cy"]) == (1, 2)


def test_passes_that_depend_on_order():
    near = lambda a, b: max(0, a[0] - b[2], b[0] - a[2]) <= 1 and max(0, a[1] - b[3], b[1] - a[3]) <= 1
    parts = [(0, 0, 1, 1), (2, 0, 3, 1), (8, 8, 9, 9), (4, 0, 5, 1)]
    assert merging.grow_until_stable(parts, near) == [(0, 0, 5, 1), (8, 8, 9, 9)]
    assert merging.grow_until_stable(merging.grow_until_stable(parts, near), near) == [(0, 0, 5, 1), (8, 8, 9, 9)]
    hosts, homes = merging.absorb([(0, 0, 1, 1), (10, 0, 11, 1)], [(2, 0, 3, 1), (4, 0, 5, 1), (20, 20, 21, 21)], near)
    assert homes == [0, 0, -1] and hosts[0] == (0, 0, 5, 1)
    groups = merging.group_rows([(0, (0, 0, 10, 10)), (1, (20, 1, 30, 9)), (2, (0, 300, 10, 310)), (3, (900, 0, 910, 10))], 1000, 1000)
    assert groups[0] == groups[1] != groups[2] and groups[3] not in (groups[0], groups[2])
    items = [((0, 0, 2, 2), True, False), ((1, 0, 3, 2), True, False), ((9, 9, 10, 10), False, False), ((9, 9, 10, 10), False, True)]
    assert merging.accept_in_order(items) == ["kept", "overlap", "no_evidence", "kept"]


def test_siblings(spark):
    b = "struct<x1:double,y1:double,x2:double,y2:double>"
    parent = (0.0, 0.0, 100.0, 100.0)
    rows = [(1, (10.0, 0.0, 30.0, 30.0), parent), (1, (10.0, 34.0, 30.0, 38.0), parent), (1, (70.0, 0.0, 90.0, 30.0), parent), (1, (5.0, 5.0, 6.0, 6.0), None)]
    df = spark.createDataFrame(rows, f"case_id int, box {b}, parent_box {b}")
    got = {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in merging.merge_siblings(df, ["case_id"]).collect()}
    assert got == {(10, 0, 30, 38), (70, 0, 90, 30)}
    why = [r["w"] for r in df.select(boxes.child_class(F.col("box"), F.col("parent_box"), 0.01, 5.0, 4.0, 0.2).alias("w")).collect()]
    assert why == [None, "small_child_area", None, None]


def test_band(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.895), (1, 2, 0.88), (2, 0, 1.0), (2, 1, 0.995), (3, 0, 0.5)], "case_id int, idx int, score double")
    got = {(r["case_id"], r["idx"]) for r in matching.best_band(rows, ["case_id"], "score", 0.88).collect()}
    assert got == {(1, 0), (1, 1), (2, 0)}


def test_offsets(spark):
    pairs = spark.createDataFrame([(1, (0.0, 0.0, 2.0, 2.0), (10.0, 5.0, 12.0, 11.0))], "case_id int, l_box struct<x1:double,y1:double,x2:double,y2:double>, r_box struct<x1:double,y1:double,x2:double,y2:double>")
    off = evaluate.region_offsets(pairs, ["case_id"])
    assert tuple(off.first()) == (1, 10, 7, 1, 1.8)
    lone = spark.createDataFrame([(2, (1.0, 1.0, 3.0, 3.0))], "case_id int, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert tuple(evaluate.inferred(lone, off, ["case_id"]).first()["inferred"]) == (1, 1, 3, 3)


def test_cases_stay_whole_behind_a_join(spark):
    """Adaptive execution may turn the join before a per-case pass into a broadcast one and read its input in pieces."""
    from tallyweave.operators.cases import by_case

    left = spark.range(40_000).select((F.col("id") % 2_000).alias("case_id"), F.col("id").alias("v")).repartition(8)
    right = spark.range(2_000).select(F.col("id").alias("case_id")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    both = left.join(right, "case_id").unionByName(left.withColumn("n", F.lit(0).cast("long")))
    out = by_case(both, ["case_id"], [F.col("v")], lambda rows: [(rows[0][0], len(rows))], "case_id long, n long")
    assert {tuple(r) for r in out.collect()} == {(i, 40) for i in range(2_000)}

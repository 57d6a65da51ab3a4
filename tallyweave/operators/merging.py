"""Merging boxes of one case: connected components, and the passes whose result depends on order.

``near`` and ``same_display`` relate members, so their groups are connected components and don't depend on order. The
other passes test the box that has grown so far; they run per case over rows in order of ``idx``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes

from .cases import by_case

Box = tuple[float, float, float, float]


def near(a: Column, b: Column, gap: float) -> Column:
    """Apart by at most ``gap`` sideways and half of it (4 at least) up and down."""
    return (boxes.horizontal_gap(a, b) <= gap) & (boxes.vertical_gap(a, b) <= max(4, round(gap / 2)))


def same_display(a: Column, b: Column) -> Column:
    """Overlapping by 0.15 of the smaller, or side by side on one row."""
    return (boxes.overlap_of_smaller(a, b) >= 0.15) | ((boxes.vertical_overlap(a, b) >= 0.55) & (boxes.horizontal_gap(a, b) <= 18))


def least_reachable(nodes: list[int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    """node -> the least node that pairs reach."""
    root = {n: n for n in nodes}

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def component_of(rows: DataFrame, case: list[str], related: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with ``component``: the least idx that relations of the case's boxes reach.

    The relation is a join on the case; what runs per case is the union of its pairs.
    """
    a, b = (rows.select(*case, F.col("idx").alias(f"{p}_idx"), F.col("box").alias(f"{p}_box")) for p in "ab")
    pairs = a.join(b, case).filter("a_idx < b_idx").filter(related(F.col("a_box"), F.col("b_box"))).select(*case, "a_idx", "b_idx")
    ends = pairs.unionByName(rows.select(*case, F.col("idx").alias("a_idx"), F.col("idx").alias("b_idx")))

    k = len(case)

    def run(rows: list[tuple]) -> list[tuple]:
        found = least_reachable([r[k] for r in rows if r[k] == r[k + 1]], [r[k:] for r in rows if r[k] != r[k + 1]])
        return [(*rows[0][:k], n, c) for n, c in found.items()]

    fields = rows.select(*case, "idx", F.col("idx").alias("component")).schema
    return rows.join(by_case(ends, case, [], run, fields), [*case, "idx"])


def merged(grouped: DataFrame, case: list[str]) -> DataFrame:
    """One row for each component of rows (box, area, cx, cy): union, summed area, density, area-weighted middle, child count.

    Without area the middle is that of the box.
    """
    a, b = F.col("area"), F.col("_u")
    out = grouped.groupBy(*case, "component").agg(
        boxes.union_all(F.col("box")).alias("_u"), F.sum(a).alias("area"), F.sum(F.col("cx") * a).alias("_x"), F.sum(F.col("cy") * a).alias("_y"), F.count(F.lit(1)).alias("child_count")
    )
    part = lambda s, lo, hi: F.when(F.col("area") > 0, F.try_divide(F.col(s), F.col("area"))).otherwise((b[lo] + b[hi]) / 2)
    density = F.col("area") / F.greatest(boxes.area(b), F.lit(1.0))
    return out.select(*case, "component", F.col("_u").alias("box"), "area", density.alias("density"), part("_x", "x1", "x2").alias("cx"), part("_y", "y1", "y2").alias("cy"), "child_count")


def representative(grouped: DataFrame, case: list[str], keep: list[str]) -> DataFrame:
    """One row for each component: the columns of its largest member (the first at a tie), with the union of its boxes."""
    first = F.min_by(F.struct(*keep), F.struct((-F.col("area")).alias("area"), "idx"))
    return grouped.groupBy(*case, "component").agg(first.alias("_r"), boxes.union_all(F.col("box")).alias("box")).select(*case, "component", *[F.col(f"_r.{c}").alias(c) for c in keep], "box")


# ---- plain boxes inside a case


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _share(lo1: float, hi1: float, lo2: float, hi2: float) -> float:
    """Shared length over the smaller length."""
    least = min(hi1 - lo1, hi2 - lo2)
    return max(0.0, min(hi1, hi2) - max(lo1, lo2)) / least if least > 0 else 0.0


def _apart(lo1: float, hi1: float, lo2: float, hi2: float) -> float:
    return max(0.0, lo1 - hi2, lo2 - hi1)


def related_parts(a: Box, b: Box, crop_w: float, crop_h: float) -> bool:
    """Fragments of one sign: beside each other on a row at like heights, or stacked in a column."""
    alike = lambda s, t: min(max(1, s), max(1, t)) / max(1, s, t)
    beside = _apart(a[0], a[2], b[0], b[2]) <= max(4, min(round(crop_w * 0.03), 14)) and _share(a[1], a[3], b[1], b[3]) >= 0.5 and alike(a[3] - a[1], b[3] - b[1]) >= 0.4
    stacked = _apart(a[1], a[3], b[1], b[3]) <= max(6, min(round(crop_h * 0.12), 18)) and _share(a[0], a[2], b[0], b[2]) >= 0.45 and alike(a[2] - a[0], b[2] - b[0]) >= 0.18
    return beside or stacked


def grow_until_stable(parts: list[Box], joins: Callable[[Box, Box], bool]) -> list[Box]:
    """Boxes joined while any two of what they have grown to should be: from the left, each takes in all it touches, again and again."""
    parts = sorted(parts)
    while True:
        left, out = list(parts), []
        while left:
            box = left.pop(0)
            while (i := next((i for i, other in enumerate(left) if joins(box, other)), -1)) >= 0:
                box = union(box, left.pop(i))
            out.append(box)
        out.sort()
        if len(out) == len(parts):
            return out
        parts = out


def group_rows(items: list[tuple[int, Box]], image_w: float, image_h: float, most_gap: float = 140) -> dict[int, int]:
    """idx -> group: items from the top, each to the group nearest on its row that stays within a request's size, else to a new one."""
    most_w, most_h, most_dy = max(120, int(image_w * 0.28)), max(48, int(image_h * 0.16)), max(18, int(image_h * 0.05))
    groups: list[Box] = []
    out: dict[int, int] = {}
    for idx, b in sorted(items, key=lambda it: ((it[1][1] + it[1][3]) / 2, it[1][0])):
        fits = []
        for g, box in enumerate(groups):
            u = union(box, b)
            off_row = abs((b[1] + b[3]) - (box[1] + box[3])) / 2 > most_dy and _share(b[1], b[3], box[1], box[3]) < 0.2
            gap = _apart(b[0], b[2], box[0], box[2])
            if u[2] - u[0] <= most_w and u[3] - u[1] <= most_h and not off_row and gap <= most_gap:
                fits.append((gap, g))
        if fits:
            out[idx] = min(fits)[1]
            groups[out[idx]] = union(groups[out[idx]], b)
        else:
            out[idx] = len(groups)
            groups.append(b)
    return out


def absorb(hosts: list[Box], guests: list[Box], joins: Callable[[Box, Box], bool]) -> tuple[list[Box], list[int]]:
    """(hosts as they have grown, host of each guest or -1): each guest goes to the first host that, as grown so far, takes it in."""
    hosts, homes = list(hosts), []
    for g in guests:
        home = next((i for i, h in enumerate(hosts) if joins(h, g)), -1)
        if home >= 0:
            hosts[home] = union(hosts[home], g)
        homes.append(home)
    return hosts, homes


def accept_in_order(items: list[tuple[Box, bool, bool]], iou: float = 0.15, coverage: float = 0.5) -> list[str]:
    """'kept', 'overlap' or 'no_evidence' for (box, has evidence, forced) in order: a box that overlaps one kept before is dropped, then one without evidence unless forced."""
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    kept: list[Box] = []
    out = []
    for b, evidence, forced in items:
        shared = [max(0.0, min(b[2], k[2]) - max(b[0], k[0])) * max(0.0, min(b[3], k[3]) - max(b[1], k[1])) for k in kept]
        if any(s / (area(b) + area(k) - s) >= iou or s / area(b) >= coverage for s, k in zip(shared, kept, strict=True) if s > 0):
            out.append("overlap")
        elif not (evidence or forced):
            out.append("no_evidence")
        else:
            kept.append(b)
            out.append("kept")
    return out


def merge_parts(rows: DataFrame, case: list[str], crop_w: float, crop_h: float) -> DataFrame:
    """The boxes (x1, y1, x2, y2) of each case joined by ``related_parts`` until stable."""
    slim, k = rows.select(*case, *[F.col(s).cast("double").alias(s) for s in boxes.SIDES]), len(case)

    def run(held: list[tuple]) -> list[tuple]:
        grown = grow_until_stable([r[k:] for r in held], lambda a, b: related_parts(a, b, crop_w, crop_h))
        return [(*held[0][:k], *b) for b in grown]

    return by_case(slim, case, [], run, slim.schema)


def same_sign(parent: Box, a: Box, b: Box) -> bool:
    """Fragments of one sign of a split region: one above the other in a column, a small one close by, or two alike and narrow with a wider gap."""
    size = lambda t: (max(t[2] - t[0], 1.0), max(t[3] - t[1], 1.0))
    (wa, ha), (wb, hb), (wp, hp) = size(a), size(b), size(parent)
    column, gap = _share(a[0], a[2], b[0], b[2]), _apart(a[1], a[3], b[1], b[3])
    alike = min(wa * ha, wb * hb) / max(wa * ha, wb * hb)
    close = column >= 0.6 and gap <= max(14.0, hp * 0.14) and alike <= 0.7
    stacked = column >= 0.55 and gap <= max(14.0, hp * 0.65) and alike >= 0.4 and max(wa, wb) <= wp * 0.45
    return close or stacked


def merge_siblings(regions: DataFrame, case: list[str]) -> DataFrame:
    """(parent corners, box) of the fragments of each parent (regions with box and parent_box) joined by ``same_sign`` until stable; regions without a parent are passed over."""
    sides = [F.col(f"parent_box.{s}").alias(f"p_{s}") for s in boxes.SIDES]
    slim = regions.filter("parent_box IS NOT NULL").select(*case, *sides, *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES])
    k = len(case)

    def run(held: list[tuple]) -> list[tuple]:
        parent = held[0][k : k + 4]
        grown = grow_until_stable([r[k + 4 :] for r in held], lambda a, b: same_sign(parent, a, b))
        return [(*held[0][: k + 4], *b) for b in grown]

    return by_case(slim, [*case, *(f"p_{s}" for s in boxes.SIDES)], [], run, slim.schema)


def review_groups(rows: DataFrame, case: list[str], image_w: float, image_h: float) -> DataFrame:
    """rows (idx, x1, y1, x2, y2) with ``review_group``."""
    slim, k = rows.select(*case, "idx", *[F.col(s).cast("double").alias(s) for s in boxes.SIDES]), len(case)
    fields = rows.select(*case, "idx", F.lit(0).alias("review_group")).schema

    def run(held: list[tuple]) -> list[tuple]:
        got = group_rows([(r[k], r[k + 1 :]) for r in held], image_w, image_h)
        return [(*held[0][:k], i, g) for i, g in got.items()]

    return rows.join(by_case(slim, case, [F.col("idx")], run, fields), [*case, "idx"])


def runs(rows: DataFrame, case: list[str], at: str) -> DataFrame:
    """Contiguous runs of whole numbers ``at`` of each case: first, last, length. Repeats count once."""
    place = F.dense_rank().over(W.partitionBy(*case).orderBy(at))
    return rows.select(*case, at).distinct().withColumn("_g", F.col(at) - place).groupBy(*case, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")

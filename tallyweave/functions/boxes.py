"""Boxes as Column expressions: a box is struct<x1,y1,x2,y2: double>.

All are built-in expressions, so they stay inside generated code and can stand in join conditions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), SIDES, strict=True)])


def none() -> Column:
    return F.lit(None).cast(BOX)


def from_array(a: Column) -> Column:
    """The box of an array of four numbers; null for any other length or where one is null."""
    whole = (F.size(a) == 4) & F.forall(a, lambda v: v.isNotNull())
    return F.when(whole, box(*[F.get(a, F.lit(i)) for i in range(4)]))


def _ordered(b: Column) -> Column:
    return box(F.least(b["x1"], b["x2"]), F.least(b["y1"], b["y2"]), F.greatest(b["x1"], b["x2"]), F.greatest(b["y1"], b["y2"]))


def _solid(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def normalise(b: Column) -> Column:
    """Corners in order; null where the box has no area."""
    o = _ordered(b)
    return F.when(_solid(o), o)


def normalise_int(b: Column) -> Column:
    """Corners rounded half to even, then in order; null where nothing is left."""
    return normalise(box(*[F.bround(b[s]) for s in SIDES]))


def compacted(b: Column) -> Column:
    """Whole numbers where a corner is within 1e-6 of one, else three decimals."""
    return box(*[F.when(F.abs(b[s] - F.bround(b[s])) < 1e-6, F.bround(b[s])).otherwise(F.bround(b[s], 3)) for s in SIDES])


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def area(b: Column) -> Column:
    """Null where there is no box."""
    return F.when(b["x1"].isNotNull(), width(b) * height(b))


def metrics(b: Column) -> Column:
    """struct<w,h,area,aspect,cx,cy>, sides at least 1."""
    w, h = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
    return F.struct(w.alias("w"), h.alias("h"), (w * h).alias("area"), (w / h).alias("aspect"), ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _over(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return _over(i, area(a) + area(b) - i)


def coverage(a: Column, b: Column) -> Column:
    """The part of a that b covers."""
    return _over(intersection(a, b), area(a))


def area_ratio(a: Column, b: Column) -> Column:
    """Area of b over that of a."""
    return _over(area(b), area(a))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _over(intersection(a, b), F.least(area(a), area(b)))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the smaller height."""
    return _over(F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0)), F.least(height(a), height(b)))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return _over(F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)), F.least(width(a), width(b)))


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - b["x2"], b["x1"] - a["x2"])


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), a["y1"] - b["y2"], b["y1"] - a["y2"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x1"]) & (x <= b["x2"]) & (y >= b["y1"]) & (y <= b["y2"])


def union_of(columns: dict[str, Column]) -> dict[str, Column]:
    """Aggregates that give the union of boxes: minima of the near corners, maxima of the far ones."""
    return {"x1": F.min(columns["x1"]), "y1": F.min(columns["y1"]), "x2": F.max(columns["x2"]), "y2": F.max(columns["y2"])}


def union_all(b: Column) -> Column:
    """Aggregate: the union of boxes of a group."""
    return F.struct(F.min(b["x1"]).alias("x1"), F.min(b["y1"]).alias("y1"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2"))


# ---- clipping: four rules that differ in what becomes of small boxes


def _clamped(b: Column, w: Column, h: Column) -> Column:
    into = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), hi)
    return box(into(b["x1"], w), into(b["y1"], h), into(b["x2"], w), into(b["y2"], h))


def clip_or_null(b: Column, w: Column, h: Column) -> Column:
    """Cut to the image; null where nothing is left."""
    c = _clamped(b, w, h)
    return F.when(_solid(c), c)


def clip_min_size(b: Column, w: Column, h: Column, least: float) -> Column:
    """Cut to the image, then widened to ``least`` on each side where smaller; null where the image is smaller than that."""
    c = _clamped(_ordered(b), w, h)

    def grown(lo: Column, hi: Column, end: Column) -> tuple[Column, Column]:
        middle = (lo + hi) / 2
        start = F.greatest(F.least(middle - least / 2, end - least), F.lit(0.0))
        small = hi - lo < least
        return F.when(small, start).otherwise(lo), F.when(small, F.least(start + least, end)).otherwise(hi)

    x1, x2 = grown(c["x1"], c["x2"], w)
    y1, y2 = grown(c["y1"], c["y2"], h)
    out = box(x1, y1, x2, y2)
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), out)


def clip_always(b: Column, w: Column, h: Column) -> Column:
    """Always a box of at least one unit inside the image."""
    x1 = F.least(F.greatest(b["x1"], F.lit(0.0)), w - 1)
    y1 = F.least(F.greatest(b["y1"], F.lit(0.0)), h - 1)
    return box(x1, y1, F.least(F.greatest(b["x2"], x1 + 1), w), F.least(F.greatest(b["y2"], y1 + 1), h))


def clip_ordered(b: Column, w: Column, h: Column) -> Column:
    """Corners in order, cut, null where no area is left."""
    return clip_or_null(_ordered(b), w, h)


def expand(b: Column, pad: Column | float, least_w: float = 0.0, least_h: float = 0.0) -> Column:
    """Widened by ``pad`` on each side, and to the least sizes about the middle."""
    pad = pad if isinstance(pad, Column) else F.lit(float(pad))
    x = F.greatest(pad, (F.lit(least_w) - (b["x2"] - b["x1"])) / 2)
    y = F.greatest(pad, (F.lit(least_h) - (b["y2"] - b["y1"])) / 2)
    return box(b["x1"] - x, b["y1"] - y, b["x2"] + x, b["y2"] + y)


# ---- coordinate maps


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def to_unit(b: Column, w: Column, h: Column) -> Column:
    """Pixels to parts of the image."""
    return scaled(b, _over(F.lit(1.0), w), _over(F.lit(1.0), h))


def between(b: Column, w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """From an image of one size to that of another."""
    return scaled(b, _over(w2, w1), _over(h2, h1))


def points_to_pixels(b: Column, dpi: Column) -> Column:
    """From 1/72 inch to pixels."""
    return scaled(b, dpi / 72.0, dpi / 72.0)


def coordinate_mode(b: Column, w: Column, h: Column, hint: Column | None = None) -> Column:
    """'ratio' up to 1.5, 'permille' up to 1001 where the image is smaller than the box, else 'pixel'; a hint wins."""
    top = F.greatest(*[F.abs(b[s]) for s in SIDES])
    beyond = (F.greatest(b["x1"], b["x2"]) > w) | (F.greatest(b["y1"], b["y2"]) > h)
    found = F.when(top <= 1.5, "ratio").when((top <= 1001) & beyond, "permille").otherwise("pixel")
    return F.coalesce(hint, found) if hint is not None else found


def to_pixels(b: Column, w: Column, h: Column, mode: Column) -> Column:
    sx = F.when(mode == "ratio", w).when(mode == "permille", w / 1000.0).otherwise(1.0)
    sy = F.when(mode == "ratio", h).when(mode == "permille", h / 1000.0).otherwise(1.0)
    return clip_ordered(scaled(b, sx, sy), w, h)


def polygon_bounds(points: Column) -> Column:
    """The box about an array of [x, y] points; points that are short or null are passed over, and none gives null."""
    ok = F.filter(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    xs, ys = F.transform(ok, lambda p: F.get(p, F.lit(0))), F.transform(ok, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(ok) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


# ---- classes


def fragment_class(b: Column, min_area: float, min_side: float, min_ratio: float) -> Column:
    """Why a fragment is passed over, first reason first; null where it is kept."""
    w, h = width(b), height(b)
    return F.when(w * h < min_area, "small_area").when(F.least(w, h) < min_side, "small_side").when(F.least(w, h) < F.greatest(w, h) * min_ratio, "thin_sliver")


def child_class(child: Column, parent: Column, area_part: float, min_side: float, sliver_aspect: float, sliver_part: float) -> Column:
    """Why a fragment of a split region is passed over, by its own and its parent's measures; null where it is kept or has no parent."""
    c, p = metrics(child), metrics(parent)
    sliver = (c["aspect"] >= sliver_aspect) & (c["h"] < p["h"] * sliver_part)
    return F.when(parent.isNull(), None).when(c["area"] < p["area"] * area_part, "small_child_area").when(F.least(c["w"], c["h"]) < min_side, "small_child_side").when(sliver, "thin_sliver")


def brightness_class(mean: Column, p95: Column) -> Column:
    return F.when((mean < 85) | (p95 < 115), "too_dark").when((mean < 115) | (p95 < 145), "dim").otherwise("ok")


def kind_class(kind: Column) -> Column:
    return F.when(kind == "svg", "graphic").when(F.coalesce(kind, F.lit("")) == "", "unknown").otherwise(kind)

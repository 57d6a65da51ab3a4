"""Read items of a case (idx, box, text, score): what belongs to a value, a caption, a region or a place."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes, similarity, text

from .cases import by_case
from .matching import best_band, overlapping


def matching_items(values: DataFrame, items: DataFrame, case: list[str], least: float = similarity.LEAST_RATIO) -> DataFrame:
    """The items that give each value (field, value): all of equal key where there are any, else those within 0.01 of the best score.

    Equal keys are an equi-join; only fields without one are scored. Both go by the texts of a case, each once however many items have it, and the items of a text come last.
    """
    v = values.withColumn("_k", text.match_key(F.col("value"))).filter(F.length("_k") >= 2)
    t = items.select(*case, "text").distinct().withColumn("_k", text.match_key(F.col("text"))).filter(F.length("_k") >= 2)
    exact = v.join(t, [*case, "_k"]).select(*case, "field", "text", F.lit(1.0).alias("score"))
    rest = v.join(exact.select(*case, "field").distinct(), [*case, "field"], "left_anti").drop("_k")
    scored = rest.join(t.drop("_k"), case).withColumn("score", similarity.value_score(F.col("value"), F.col("text"), F.col("field")))
    found = exact.unionByName(best_band(scored.select(*case, "field", "text", "score"), [*case, "field"], "score", least))
    return found.join(items.select(*case, "idx", "text"), [*case, "text"]).select(*case, "field", "idx", "score")


def region_items(regions: DataFrame, items: DataFrame, case: list[str]) -> DataFrame:
    """Items inside each region: not blank, more than a unit of area, at least 0.35 of it covered."""
    some = items.filter((F.btrim("text") != "") & (boxes.area(F.col("box")) > 1))
    return overlapping(some, regions, case, lambda a, b: boxes.coverage(a, b) >= 0.35)


def masked(score: Column, text_: Column) -> Column:
    """Whether an item hides what is under it: a single character of low score may be a sign misread."""
    return (F.coalesce(score, F.lit(1.0)) >= 0.55) | (F.length(F.btrim(F.coalesce(text_, F.lit("")))) >= 2)


def joined_text(rows: DataFrame, by: list[str], order: str, text_: str = "text") -> DataFrame:
    """The texts of each group in order, blank between, blank ones left out."""
    some = F.when(F.btrim(F.coalesce(text_, F.lit(""))) != "", F.struct(order, F.btrim(text_).alias("t")))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(some)).alias("_l")).select(*by, F.array_join(F.transform("_l", lambda x: x["t"]), " ").alias("text"))


def about_anchor(anchors: DataFrame, items: DataFrame, case: list[str]) -> DataFrame:
    """Items about each anchor (idx, box), ranked: the middle within the anchor grown by 10 and 8, or a good part of either covered, and on its row."""
    near = lambda a, b: boxes.contains_point(boxes.box(a["x1"] - 10, a["y1"] - 8, a["x2"] + 10, a["y2"] + 8), (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    pairs = overlapping(anchors, items, case, lambda a, b: (near(a, b) | (boxes.coverage(b, a) >= 0.35) | (boxes.coverage(a, b) >= 0.2)) & (boxes.vertical_overlap(a, b) >= 0.35))
    a, b = F.col("l_box"), F.col("r_box")
    away = F.abs((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2) + F.abs(a["y1"] + a["y2"] - b["y1"] - b["y2"])
    rank = F.row_number().over(W.partitionBy(*case, "l_idx").orderBy(F.col("score").desc(), "r_idx"))
    return pairs.withColumn("score", F.greatest(boxes.coverage(a, b), boxes.coverage(b, a)) - away / 10000).withColumn("rank", rank)


def value_beside(captions: DataFrame, items: DataFrame, case: list[str], image_w: float, image_h: float) -> DataFrame:
    """For each caption (idx, field, box) the nearest item right of it on its row that has the shape of the field's value, and the box of both."""
    row = lambda a, b: (boxes.vertical_overlap(a, b) >= 0.25) | (F.abs(a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2 <= F.greatest(a["y2"] - a["y1"], b["y2"] - b["y1"], F.lit(1.0)) * 0.7)
    pairs = overlapping(captions, items, case, lambda a, b: ((b["x1"] + b["x2"]) / 2 > a["x2"]) & row(a, b)).filter("l_idx != r_idx")
    pairs = pairs.filter(similarity.looks_like_value(F.col("l_field"), F.col("r_text")))
    a, b = F.col("l_box"), F.col("r_box")
    far = F.abs(a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2 / image_h + F.greatest(b["x1"] - a["x2"], F.lit(0.0)) / image_w
    both = F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))
    first = F.row_number().over(W.partitionBy(*case, "l_idx").orderBy("_far", "r_idx"))
    return pairs.withColumns({"_far": far, "box": both}).withColumn("_n", first).filter("_n = 1").select(*case, "l_idx", "l_field", "r_idx", F.col("r_text").alias("value"), "box")


def widened_caption(b: Column, image_w: Column, image_h: Column) -> Column:
    """A caption's box with the room to its right where a value may stand."""
    w, h = boxes.width(b), boxes.height(b)
    pad = F.greatest(F.lit(4.0), F.bround(h * 0.12))
    right = F.least(image_w, b["x2"] + F.greatest(F.bround(w * 1.35), F.bround(image_w * 0.22)))
    return boxes.clip_or_null(boxes.box(b["x1"], b["y1"] - pad, right, b["y2"] + pad), image_w, image_h)


def value_part(b: Column, read: Column, value: Column) -> Column:
    """The part of an item's box where the value's characters stand, a little wider; null where the text is hardly longer than the value, or hasn't it, or the part is narrow."""
    t, v = F.btrim(F.coalesce(read, F.lit(""))), F.btrim(F.coalesce(value, F.lit("")))
    at = F.instr(F.lower(t), F.lower(v)) - 1
    unit = boxes.width(b) / F.greatest(F.length(t), F.lit(1))
    left, right = b["x1"] + unit * at, b["x1"] + unit * F.least(F.length(t), at + F.length(v))
    return F.when((v != "") & (F.length(t) > F.length(v) + 4) & (at >= 0) & (right - left >= 8), boxes.box(left - 6, b["y1"] - 3, right + 6, b["y2"] + 3))


def place_features(items: DataFrame, image_w: float, image_h: float) -> DataFrame:
    """Items with their middle and size as parts of the image; blank ones and long numbers without a letter are left out."""
    b, t = F.col("box"), F.col("text")
    digits, letters = F.length(F.regexp_replace(t, "[^0-9]", "")), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    some = items.filter((text.compare_key(t) != "") & ~((digits >= 10) & (letters == 0)))
    return some.withColumns({"cx": (b["x1"] + b["x2"]) / 2 / image_w, "cy": (b["y1"] + b["y2"]) / 2 / image_h, "w": F.greatest(boxes.width(b), F.lit(1.0)) / image_w, "h": F.greatest(boxes.height(b), F.lit(1.0)) / image_h})


def address_line(items: DataFrame, case: list[str], image_w: float, image_h: float) -> DataFrame:
    """The item of each case that is likeliest the address: it starts at the left, and says so or is a long line at the bottom."""
    b, t = F.col("box"), text.compare_key(F.col("text"))
    wide, low = boxes.width(b) / image_w, b["y2"] / image_h
    says = F.contains(t, F.lit("add"))
    likely = (says | F.contains(t, F.lit("west")) | ((low >= 0.92) & (wide >= 0.35))) & (b["x1"] <= max(20, round(image_w * 0.08)))
    score = wide + low + F.when(says, 0.5).otherwise(0.0)
    first = F.row_number().over(W.partitionBy(*case).orderBy(F.col("score").desc(), F.col("idx").desc()))
    return items.filter(likely).withColumn("score", score).withColumn("_n", first).filter("_n = 1").drop("_n")


def off_lower_lines(candidates: DataFrame, items: DataFrame, case: list[str], image_h: float) -> DataFrame:
    """Candidates (idx, box) that are not fragments of a text line in the lower part of the image."""
    middle = lambda b: (b["y1"] + b["y2"]) / 2 / image_h
    on = lambda a, b: (middle(a) >= 0.78) & (middle(b) >= 0.72) & (boxes.vertical_overlap(a, b) >= 0.25) & (boxes.horizontal_gap(a, b) <= F.greatest(F.lit(30.0), boxes.width(a) * 0.45, boxes.width(b) * 0.08))
    hit = overlapping(candidates, items.filter(F.length(F.btrim("text")) >= 2), case, on)
    return candidates.join(hit.select(*case, F.col("l_idx").alias("idx")), [*case, "idx"], "left_anti")


#: The runs of more items than this are looked up, not walked for.
WALKED = 256


def chains(items: list[tuple[int, tuple[float, float, float, float]]], longest: int = 4) -> list[tuple[int, ...]]:
    """Runs of items that may be the words of one caption: each alone, and from each one rightwards on its row while gaps are small.

    An item with a side that is no finite number stands alone.
    """
    line = sorted((it for it in items if all(map(math.isfinite, it[1]))), key=lambda it: (it[1][0], it[1][1] + it[1][3]))
    runs = _walked(line, longest) if len(line) <= WALKED else _looked_up(line, longest)
    return list(dict.fromkeys([(i,) for i, _ in items] + runs))


def _walked(line: list[tuple], longest: int) -> list[tuple[int, ...]]:
    """The runs of two items or more, by a walk along the line from each item."""
    h = lambda b: max(b[3] - b[1], 1.0)

    def same_row(a, b) -> bool:
        shared = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return shared >= 0.45 * min(h(a), h(b)) and abs(a[1] + a[3] - b[1] - b[3]) / 2 <= 0.55 * max(h(a), h(b))

    out = []
    for k, (i, start) in enumerate(line):
        run, last = [i], start
        for j, b in line[k + 1 :]:
            if len(run) >= longest:
                break
            if not same_row(start, b):
                continue
            tall, gap = max(h(last), h(b)), b[0] - last[2]
            if same_row(last, b) and -0.6 * tall <= gap <= max(48.0, 1.25 * tall):
                run.append(j)
                out.append(tuple(run))
                last = b
            elif gap >= 0:  # nothing further right can be nearer
                break
    return out


class _Places:
    """Places in a line by the middles of their items, as a wavelet matrix: for many ranges of middles at once, the least place that is not before a given one.

    A look-up reads each bit of a place twice, however many items lie in the range.
    """

    def __init__(self, middles: np.ndarray, places: np.ndarray):
        order = np.lexsort((places, middles))
        self.middles, v = middles[order], places[order]
        self.levels = []
        for bit in range(int(v.max()).bit_length(), -1, -1):
            one = (v >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(1 - one)))))
            v = np.concatenate((v[one == 0], v[one == 1]))

    def first(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """The first place from ``least`` on whose middle is from ``low`` to ``high``, else ``none``."""
        left = np.searchsorted(self.middles, low, "left")
        right = np.maximum(np.searchsorted(self.middles, high, "right"), left)
        least = np.minimum(least, (1 << len(self.levels)) - 1)
        before, a, z = np.zeros(len(low), np.int64), left, right
        for bit, zeros in self.levels:
            a0, z0, one = zeros[a], zeros[z], (least >> bit) & 1 == 1
            before += np.where(one, z0 - a0, 0)
            a, z = np.where(one, zeros[-1] + a - a0, a0), np.where(one, zeros[-1] + z - z0, z0)
        rank, out, a, z = before, np.zeros(len(low), np.int64), left, right
        for bit, zeros in self.levels:
            a0, z0 = zeros[a], zeros[z]
            one = rank >= z0 - a0
            rank, out = np.where(one, rank - (z0 - a0), rank), out | one.astype(np.int64) << bit
            a, z = np.where(one, zeros[-1] + a - a0, a0), np.where(one, zeros[-1] + z - z0, z0)
        return np.where(before < right - left, out, none)


def _looked_up(line: list[tuple], longest: int) -> list[tuple[int, ...]]:
    """What ``_walked`` gives, in the same order, without passing the items between: all runs take each step at once.

    A step leads to the first item on the start's row that goes on from the last one or lies wholly right of it. Items of similar height share an index, asked for a range
    of middles that holds all that can be on the row; what it finds is tested as in a walk and, where it fails, asked again from the place after.
    """
    n, ids = len(line), [i for i, _ in line]
    x1, y1, x2, y2 = np.array([b for _, b in line], np.float64).T
    h, middle = np.maximum(y2 - y1, 1.0), (y1 + y2) / 2
    slack_x, slack_y = 1e-9 * max(np.abs(x1).max(), np.abs(x2).max()), 1e-9 * max(np.abs(y1).max(), np.abs(y2).max())
    kind = np.floor(np.log2(h) * 4)
    groups = [(h[own].max(), _Places(middle[own], own)) for own in (np.flatnonzero(kind == k) for k in np.unique(kind))]

    def same_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
        return (shared >= 0.45 * np.minimum(h[a], h[b])) & (np.abs(y1[a] + y2[a] - y1[b] - y2[b]) / 2 <= 0.55 * np.maximum(h[a], h[b]))

    def follows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tall, gap = np.maximum(h[a], h[b]), x1[b] - x2[a]
        return same_row(a, b) & (-0.6 * tall <= gap) & (gap <= np.maximum(48.0, 1.25 * tall))

    def first(start: np.ndarray, last: np.ndarray, back: bool, end: np.ndarray) -> np.ndarray:
        """The first place before ``end`` on the start's row: with ``back``, of those that overlap the last item a little and go on from it, else of those right of it."""
        best = end.copy()
        for tallest, places in groups:
            # two that share 0.45 of the lower one's height have middles no further apart than this
            far = lambda a: np.maximum(h[a], tallest) / 2 + 0.05 * np.minimum(h[a], tallest) + slack_y  # noqa: B023, E731
            low, high = middle[start] - far(start), middle[start] + far(start)
            at = x2[last]
            if back:
                low, high = np.maximum(low, middle[last] - far(last)), np.minimum(high, middle[last] + far(last))
                at = at - 0.6 * np.maximum(h[last], tallest) - slack_x
            at, run = np.maximum(np.searchsorted(x1, at, "left"), last + 1), np.arange(len(start))
            while len(run):
                q = places.first(low[run], high[run], at[run], n)
                nearer = q < best[run]
                run, q = run[nearer], q[nearer]
                ok = same_row(start[run], q)
                if back:
                    ok &= follows(last[run], q)
                best[run[ok]] = q[ok]
                run, q = run[~ok], q[~ok]
                at[run] = q + 1
        return best

    steps, firsts, out = [np.arange(n)], [], []
    while len(steps[0]) and len(steps) < longest:
        start, last = steps[0], steps[-1]
        right = np.maximum(np.searchsorted(x1, x2[last], "left"), last + 1)
        q = first(start, last, True, right)
        rest = np.flatnonzero(q == right)
        q[rest] = first(start[rest], last[rest], False, np.full(len(rest), n))
        on = q < n
        on[on] = follows(last[on], q[on])
        steps = [*(s[on] for s in steps), q[on]]
        firsts.append(steps[0])
        out += zip(*([ids[p] for p in s.tolist()] for s in steps), strict=True)
    order = np.argsort(np.concatenate(firsts), kind="stable") if firsts else ()
    return [out[o] for o in order]


def captions(items: DataFrame, case: list[str], fields: tuple[str, ...] = tuple(similarity.CAPTION_PATTERNS)) -> DataFrame:
    """(field, caption, idxs) of each case: of all runs of items the best caption of each field, by pattern before likeness, then the longer caption with less about it, then the surer."""
    slim = items.select(*case, "idx", "text", "score", *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES])
    k = len(case)

    def run(rows: list[tuple]) -> list[tuple]:
        held = {r[k]: r for r in rows if (r[k + 1] or "").strip() and r[k + 3] is not None}
        words = {i: r[k + 1].strip() for i, r in held.items()}
        sure = {i: s if (s := r[k + 2]) and s == s else 0.0 for i, r in held.items()}
        # runs of the same words differ in how sure they are alone: the surest stands for all, the first of equals
        surest: dict[tuple, tuple] = {}
        for n, chain in enumerate(chains([(i, r[k + 3 :]) for i, r in held.items()])):
            said, least = tuple([words[i] for i in chain]), min([sure[i] for i in chain])
            if said not in surest or least > surest[said][0]:
                surest[said] = (least, -n, chain)
        best: dict[str, tuple] = {}
        for said, (least, place, chain) in surest.items():
            raw = " ".join(said)
            size = len("".join(c for c in raw if c.isascii() and c.isalnum()))
            for field in fields:
                found = similarity.find_caption(field, raw)
                if found is None:
                    continue
                own = len("".join(c for c in found[0] if c.isascii() and c.isalnum()))
                rank = (found[1], found[2], own, -max(size - own, 0), least, place)
                if own and (field not in best or rank > best[field][0]):
                    best[field] = (rank, found[0], list(chain))
        return [(*rows[0][:k], field, caption, idxs) for field, (_, caption, idxs) in best.items()]

    fields_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*case).schema)
    return by_case(slim, case, [F.col("idx")], run, f"{fields_of}, field string, caption string, idxs array<bigint>")


def annotate(proposals: DataFrame, case: list[str]) -> DataFrame:
    """Proposed annotations (idx, box, evidence, forced) in order, each 'kept', 'overlap' or 'no_evidence'."""
    from .merging import accept_in_order

    slim = proposals.select(*case, "idx", *[F.col(f"box.{s}").alias(s) for s in boxes.SIDES], "evidence", "forced")
    k = len(case)

    def run(rows: list[tuple]) -> list[tuple]:
        said = accept_in_order([(r[k + 1 : k + 5], bool(r[k + 5]), bool(r[k + 6])) for r in rows])
        return [(*r[: k + 1], s) for r, s in zip(rows, said, strict=True)]

    fields = proposals.select(*case, "idx", F.lit("").alias("outcome")).schema
    return proposals.join(by_case(slim, case, [F.col("idx")], run, fields), [*case, "idx"])


def text_proposals(values: DataFrame, found: DataFrame, items: DataFrame, case: list[str], most: int = 2) -> DataFrame:
    """Differing values (field, expected) whose items don't give them: the first items found for each field whose text isn't the expected one, as proposals."""
    first = F.row_number().over(W.partitionBy(*case, "field").orderBy("idx"))
    hits = found.withColumn("_n", first).filter(F.col("_n") <= most).join(items.select(*case, "idx", "text", "box"), [*case, "idx"])
    return hits.join(values.select(*case, "field", "expected"), [*case, "field"]).filter(~similarity.lenient_match(F.col("field"), F.col("expected"), F.col("text"))).select(*case, "idx", "field", "box")


def position_differences(pairs: DataFrame, template: DataFrame, target: DataFrame, case: list[str]) -> DataFrame:
    """Matched places with different text, and template items without a partner; target items without one are passed over."""
    t = template.select(*case, F.col("idx").alias("l_idx"), F.col("text").alias("expected"))
    g = target.select(*case, F.col("idx").alias("r_idx"), F.col("text").alias("read"))
    both = pairs.select(*case, "l_idx", "r_idx").join(t, [*case, "l_idx"]).join(g, [*case, "r_idx"])
    differ = both.filter(~text.values_match(F.col("expected"), F.col("read"))).select(*case, "l_idx", "r_idx", "expected", "read")
    alone = t.join(pairs.select(*case, "l_idx"), [*case, "l_idx"], "left_anti").select(*case, "l_idx", F.lit(None).cast("int").alias("r_idx"), "expected", F.lit(None).cast("string").alias("read"))
    return differ.unionByName(alone.withColumn("r_idx", F.col("r_idx").cast(differ.schema["r_idx"].dataType)))

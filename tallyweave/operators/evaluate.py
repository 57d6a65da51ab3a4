"""Summaries: field comparison, verdicts, evaluation roll-ups, review metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole; ``empty`` where there is no whole (pass rates give 0, precision and recall null)."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def compare_fields(rows: DataFrame, key: list[str], fields: str, left: str, right: str, match=text.values_match) -> DataFrame:
    """One row for each field listed of each case: both maps' values, and whether they match. A field that a map lacks is null, and null matches blank."""
    each = rows.select(*key, F.posexplode(fields).alias("place", "field"), left, right)
    pick = lambda m: F.try_element_at(F.col(m), F.col("field"))
    return each.select(*key, "place", "field", pick(left).alias("left_value"), pick(right).alias("right_value")).withColumn("is_match", match(F.col("left_value"), F.col("right_value")))


def align_union(rows: DataFrame, key: list[str], left: str, right: str, match=text.values_match) -> DataFrame:
    """As compare_fields, over the keys of either map, in order."""
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    return compare_fields(rows.withColumn("_fields", keys), key, "_fields", left, right, match)


def text_summary(compared: DataFrame, key: list[str]) -> DataFrame:
    """Matches, fields, and the differing fields in order."""
    differing = F.array_sort(F.collect_list(F.when(~F.col("is_match"), F.struct("place", "field"))))
    out = compared.groupBy(*key).agg(F.count_if("is_match").alias("matches"), F.count(F.lit(1)).alias("fields"), differing.alias("_d"))
    return out.withColumn("differing", F.transform("_d", lambda d: d["field"])).drop("_d")


def comparison_sheet(compared: DataFrame, key: list[str]) -> DataFrame:
    """What a reader sees: field, both values ('-' where blank), and a tick or cross."""
    shown = lambda c: F.when(text.present(F.col(c)), F.col(c)).otherwise("-")
    return compared.select(*key, "place", "field", shown("left_value").alias("template"), shown("right_value").alias("target"), F.when(F.col("is_match"), "✓").otherwise("✗").alias("result"))


def graphic_counts(decision: Column, needs_review: Column) -> dict[str, Column]:
    """Aggregates of region comparisons by the report's rule: a mismatch that needs review is a review, not a mismatch."""
    review = F.coalesce(needs_review, F.lit(False))
    return {
        "matched": F.count_if((decision == "match") & ~review),
        "mismatched": F.count_if((decision == "mismatch") & ~review),
        "to_review": F.count_if((decision == "unknown") | review),
        "matched_though_flagged": F.count_if((decision == "match") & review),
    }


def desktop_counts(decision: Column) -> dict[str, Column]:
    """Aggregates by the desktop's rule: every mismatch counts, and only unknown is a review."""
    return {"matched": F.count_if(decision == "match"), "mismatched": F.count_if(decision == "mismatch"), "to_review": F.count_if(decision == "unknown")}


def filter_counts(decision: Column) -> dict[str, Column]:
    known = decision.isin("keep", "discard")
    return {"kept": F.count_if(decision == "keep"), "discarded": F.count_if(decision == "discard"), "undecided": F.count_if(~F.coalesce(known, F.lit(False)))}


def verdict(matches: Column, fields: Column, graphic_pass: Column, reviews: Column, mismatches: Column, unresolved: Column) -> Column:
    """The verdict of a case from its counts, as a code."""
    text_ok = fields <= matches
    return (
        F.when(text_ok & graphic_pass & (reviews == 0), "consistent")
        .when(text_ok & graphic_pass, "consistent_review")
        .when(graphic_pass & (reviews > 0), "text_differs_review")
        .when(graphic_pass, "text_differs")
        .when(text_ok & (unresolved > 0) & (mismatches == 0), "graphic_unresolved")
        .when(text_ok, "graphic_differs")
        .otherwise("differs")
    )


def verdict_colour(text_: Column) -> Column:
    """Of a verdict's text, the first mark that occurs: red, orange, green."""
    has = lambda s: F.contains(text_, F.lit(s))
    return F.when(has("❌") | has("差异"), "red").when(has("⚠"), "orange").when(has("✅"), "green")


def fused_score(shape: Column, structure: Column, colour: Column) -> Column:
    return 0.5 * shape + 0.3 * structure + 0.2 * colour


def fused_decision(score: Column, model_decision: Column, model_sure: Column, same: float = 0.85, differs: float = 0.5) -> Column:
    """struct<decision, needs_review, source> of shape and model together: where they contradict each other the model's match stands, but needs review."""
    shape = F.when(score >= same, "match").when(score < differs, "mismatch").otherwise("unknown")
    clash = (shape != "unknown") & (model_decision != "unknown") & (shape != model_decision)
    decided = F.when(model_decision == "unknown", shape).otherwise(model_decision)
    return F.struct(decided.alias("decision"), ((decided == "unknown") | clash | (model_sure < 0.5)).alias("needs_review"), F.when(model_decision == "unknown", "shape").when(clash, "conflict").otherwise("model").alias("source"))


def recovery_outcome(reason: Column, side: Column, found_uncovered: Column) -> Column:
    """struct<decision, confidence, needs_review, source, unresolved> of a region whose partner had to be inferred.

    Too little there is a mismatch, and so is a graphic found beside the layout on the target that has no counterpart; any other failure is left to review.
    """
    empty, extra = reason == "low_foreground", (reason == "inference_failed") & (side == "target") & found_uncovered
    sure = empty | extra
    return F.struct(
        F.when(sure, "mismatch").otherwise("unknown").alias("decision"),
        F.when(empty, 0.95).when(extra, 0.90).otherwise(0.0).alias("confidence"),
        (~sure).alias("needs_review"),
        F.when(empty, "recovery_low_foreground").when(extra, "recovery_uncovered_target_graphic").otherwise("recovery_failed").alias("source"),
        (~sure).alias("unresolved"),
    )


def expected_flags(kinds: Column, source: Column, mutations: Column, graphic_name: Column) -> Column:
    """struct<text_diff, graphic_diff> that a sample should show, by its regions' kinds, its source of defects, or its counters."""
    has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
    src = F.coalesce(source, F.lit(""))
    return F.struct((has("text") | src.isin("text_only", "mixed") | (F.coalesce(mutations, F.lit(0)) > 0)).alias("text_diff"), (has("svg") | src.isin("svg_only", "mixed") | (F.coalesce(graphic_name, F.lit("")) != "")).alias("graphic_diff"))


def weak_evidence(evidence: Column, diff: float, target: float, template: float, component: float) -> Column:
    """Whether local evidence (valid, diff_ratio, unmatched_target_ratio, unmatched_template_ratio, largest_component_ratio) is too weak to show; missing parts count as 1."""
    part = lambda n: F.coalesce(evidence[n], F.lit(1.0))
    low = (part("diff_ratio") <= diff) & (part("unmatched_target_ratio") <= target) & (part("unmatched_template_ratio") <= template) & (part("largest_component_ratio") <= component)
    return F.coalesce(evidence["valid"], F.lit(False)) & low


def weak_graphic(evidence: Column) -> Column:
    return weak_evidence(evidence, 0.08, 0.08, 0.10, 0.04)


def weak_text(evidence: Column, field: Column) -> Column:
    """As above for text; the caption of the air volume, whose raised figure is small, is shown from 0.009 on."""
    top = F.greatest(*[F.coalesce(evidence[n], F.lit(0.0)) for n in ("diff_ratio", "unmatched_template_ratio", "unmatched_target_ratio")])
    return weak_evidence(evidence, 0.05, 0.05, 0.07, 0.045) & ~((field == "label:air_volume") & (top >= 0.009))


def strong_value_evidence(evidence: Column, raw_diff: Column) -> Column:
    """Whether a value that reads the same still differs to the eye."""
    part = lambda n: F.coalesce(evidence[n], F.lit(0.0))
    unmatched = F.greatest(part("unmatched_template_ratio"), part("unmatched_target_ratio"))
    return F.coalesce(evidence["valid"], F.lit(False)) & (raw_diff >= 0.025) & (part("diff_ratio") >= 0.12) & (part("largest_component_ratio") >= 0.045) & (unmatched >= 0.12)


def reviewed(predicted: Column, manual: Column) -> Column:
    """Whether a person has judged anything in an annotation."""
    return F.exists(predicted, lambda b: b["decision"].isin("true_positive", "false_positive")) | (F.size(manual) > 0)


def roll_up(evaluations: DataFrame) -> DataFrame:
    """One row over evaluations (passed, durations and box counts): totals, pass rate, means and medians, box sums."""
    boxes = [F.sum(c).alias(c) for c in ("expected_count", "predicted_count", "matched_count", "missing_count", "extra_count")]
    times = [f(c).alias(f"{n}_{c}") for c in ("duration_seconds", "detection_duration_seconds") for n, f in (("avg", F.avg), ("median", F.median))]
    out = evaluations.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), *boxes, *times)
    return out.withColumn("pass_rate", ratio(F.col("passed"), F.col("total")))


def by_category(evaluations: DataFrame, category: str) -> DataFrame:
    named = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unknown"))
    return evaluations.groupBy(named.alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def by_value(rows: DataFrame, many: str) -> DataFrame:
    """How often each value of an array column occurs."""
    return rows.select(F.explode(many).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def passed(missing_count: Column) -> Column:
    """An evaluation passes where no expected box is missing; extra boxes only warn."""
    return missing_count == 0


def review_metrics(annotations: DataFrame) -> DataFrame:
    """One row over review documents (predicted_boxes with decision, manual_gt_boxes): precision TP/(TP+FP) and recall proxy TP/(TP+manual)."""
    is_ = lambda d: F.size(F.filter("predicted_boxes", lambda b: b["decision"] == d))
    rows = annotations.select(is_("true_positive").alias("tp"), is_("false_positive").alias("fp"), F.size("manual_gt_boxes").alias("manual"))
    reviewed = (F.col("tp") + F.col("fp") + F.greatest("manual", F.lit(0))) > 0
    out = rows.agg(
        F.count_if(reviewed).alias("reviewed"), F.count_if(~reviewed).alias("skipped_unreviewed"), *[F.coalesce(F.sum(F.when(reviewed, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "manual")]
    )
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), None), "recall_proxy": ratio(F.col("tp"), F.col("tp") + F.col("manual"), None)})


def region_offsets(pairs: DataFrame, case: list[str]) -> DataFrame:
    """Median shift and scale of matched pairs (l_box, r_box) of each case, the scale within 0.5 and 1.8."""
    a, b = F.col("l_box"), F.col("r_box")
    mid = lambda x, lo, hi: (x[lo] + x[hi]) / 2
    scale = lambda lo, hi: F.greatest(F.lit(0.5), F.least(F.lit(1.8), F.median((b[hi] - b[lo]) / (a[hi] - a[lo]))))
    return pairs.groupBy(*case).agg(F.median(mid(b, "x1", "x2") - mid(a, "x1", "x2")).alias("dx"), F.median(mid(b, "y1", "y2") - mid(a, "y1", "y2")).alias("dy"), scale("x1", "x2").alias("sx"), scale("y1", "y2").alias("sy"))


def inferred(regions: DataFrame, offsets: DataFrame, case: list[str]) -> DataFrame:
    """Where each region (box) should lie on the other side; cases without a pair keep the place and size."""
    r = regions.join(offsets, case, "left")
    b, or_ = F.col("box"), lambda c, v: F.coalesce(F.col(c), F.lit(v))
    side = lambda lo, hi, d, s: ((b[lo] + b[hi]) / 2 + or_(d, 0.0), (b[hi] - b[lo]) / 2 * or_(s, 1.0))
    (cx, hw), (cy, hh) = side("x1", "x2", "dx", "sx"), side("y1", "y2", "dy", "sy")
    return r.withColumn("inferred", F.struct((cx - hw).alias("x1"), (cy - hh).alias("y1"), (cx + hw).alias("x2"), (cy + hh).alias("y2"))).drop("dx", "dy", "sx", "sy")


def verdict_distribution(results: DataFrame, first: str, second: str) -> DataFrame:
    """How often each verdict occurs: that of the first column, or where it is blank the second's, or 'unknown'."""
    filled = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    return results.groupBy(F.coalesce(filled(first), filled(second), F.lit("unknown")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def result_buckets(compared: Column, boxes: Column) -> Column:
    """struct<mismatches, reviews> of compared regions (array<struct<decision, needs_review>>); without any, each predicted box counts as a mismatch."""
    review = lambda c: F.coalesce(c["needs_review"], F.lit(False))
    some = F.size(F.coalesce(compared, F.array().cast("array<struct<decision:string,needs_review:boolean>>"))) > 0
    mismatches = F.size(F.filter(compared, lambda c: (c["decision"] == "mismatch") & ~review(c)))
    reviews = F.size(F.filter(compared, lambda c: (c["decision"] == "unknown") | review(c)))
    return F.struct(F.when(some, mismatches).otherwise(F.greatest(F.size(F.coalesce(boxes, F.array().cast("array<string>"))), F.lit(0))).alias("mismatches"), F.when(some, reviews).otherwise(0).alias("reviews"))


def split_regions(regions: DataFrame, barcode: Column, parts: Column) -> tuple[DataFrame, DataFrame]:
    """(comparable regions, skipped ones with ``reason``) of regions (original_idx, box).

    parts: array<struct<box, barcode>> of the children of a mixed region, else null or empty. Children of both sorts stand for their region on either
    side; any other region goes whole, by whether it is a barcode.
    """
    both = F.exists(parts, lambda p: p["barcode"]) & F.exists(parts, lambda p: ~p["barcode"])
    whole = F.array(F.struct(F.col("box").alias("box"), barcode.alias("barcode")))
    each = regions.withColumn("_p", F.explode(F.when(F.coalesce(both, F.lit(False)), parts).otherwise(whole)))
    each = each.withColumn("box", F.col("_p.box")).withColumn("_b", F.col("_p.barcode")).drop("_p")
    return each.filter(~F.col("_b")).drop("_b"), each.filter("_b").withColumn("reason", F.lit("barcode")).drop("_b")


def barcode_cluster(children: DataFrame, by: list[str]) -> DataFrame:
    """For each parent (by) of fragments (aspect, h, dark, parent_aspect, parent_h): whether they look like the bars of a barcode: a long parent, three fragments or more, most of them narrow, and as tall as half the parent."""
    n = F.count(F.lit(1))
    narrow, tall = F.count_if(F.col("aspect") < 0.7), F.count_if(F.col("h") >= F.col("parent_h") * 0.5)
    return children.groupBy(*by).agg((n >= 3).alias("_several"), (F.max("parent_aspect") >= 2.8).alias("_long"), (narrow * 2 >= n).alias("_narrow"), (tall * 2 >= n).alias("_tall")).select(*by, (F.col("_several") & F.col("_long") & F.col("_narrow") & F.col("_tall")).alias("cluster"))


def picked(rows: DataFrame, order: list[Column], index: int, *conditions: Column | None) -> DataFrame:
    """The row at ``index`` of those that pass every condition given; none where the index is beyond them."""
    for c in conditions:
        rows = rows if c is None else rows.filter(c)
    return rows.orderBy(*order).offset(index).limit(1) if index >= 0 else rows.limit(0)


def any_failed(checks: DataFrame) -> DataFrame:
    """One row over checks (name, ok): how many there are, and whether any failed; a null counts as failed."""
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.coalesce(F.bool_or(~F.coalesce(F.col("ok"), F.lit(False))), F.lit(False)).alias("failed"))

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import boxes, similarity
from tallyweave.operators import evaluate, items, matching

ITEM = "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, text string, score double"


def some(spark, *rows):
    return spark.createDataFrame([(1, i, tuple(map(float, b)), t, s) for i, (b, t, s) in enumerate(rows)], ITEM)


@pytest.mark.parametrize(
    ("field", "value", "texts", "want"),
    [
        ("frequency", "50Hz", ["50", "Hz", "220-240V~", "50Hz"], [3]),
        ("mfg_date", "2025.12", ["37dB(A)2025.12", "2025.12"], [1]),
        ("air_volume", "590m³/h", ["590m3/h", "590"], [0]),
        ("air_volume", "590m³/h", ["590m/$", "590"], [0]),
        ("net_weight", "14kg", ["N.W.:14kg", "114kg"], [0]),
        ("refrigerant", "R32", ["Refrigerant:R32", "R32X"], [0]),
        ("voltage", "220-240V~", ["220-240V~50Hz"], []),
        ("x", "a", ["a"], []),
    ],
)
def test_matching_items(spark, field, value, texts, want):
    held = some(spark, *[((0, 0, 9, 9), t, 1.0) for t in texts])
    values = spark.createDataFrame([(1, field, value)], "case_id int, field string, value string")
    got = items.matching_items(values, held, ["case_id"]).collect()
    assert sorted(r["idx"] for r in got) == want


@pytest.mark.parametrize(
    ("field", "a", "b", "want"),
    [
        ("x", "A, INC.OF", "A, INC. OF", True),
        ("weight", "13.5kg", "135kg", False),
        ("label:weight", "Weight", "weiGht", False),
        ("label:barcode", "SerialNo.", "Serial No.", True),
        ("label:barcode", "SerialNo.", "Serial No..", False),
        ("label:voltage", "Rated Voltage", "dVoltage", False),
        ("label:mfg_date", "Manufactured Date", "Date", True),
        ("label:voltage", "Rated Voltage", "Voltage Rated", True),
        ("label:other", "abc def", "abc dex", False),
        ("label:voltage", None, "none", True),
    ],
)
def test_fields_match(spark, field, a, b, want):
    df = spark.createDataFrame([(field, a, b)], "f string, a string, b string")
    assert df.select(similarity.fields_match(F.col("f"), F.col("a"), F.col("b")).alias("v")).first()["v"] is want


def test_scores():
    assert similarity.key_score("590m3h", "590m3h") == 1.0 and similarity.key_score("a", "a") == 0.0
    assert similarity.key_score("135kg", "13kg") == 0.0  # digits differ
    assert 0.88 <= similarity.key_score("conditioner", "conditionr") < 1
    assert similarity.find_caption("voltage", "the Rated  Voltage: 220") == ("Rated  Voltage", 1, 1.0)
    assert similarity.find_caption("refrigerant", "Refrigerent")[1] == 0
    assert similarity.find_caption("weight", "Weights") is None or similarity.find_caption("weight", "Weights")[1] == 0
    assert similarity.find_caption("color", "xyz") is None
    assert similarity.harvest({"keep": [3, "7 and 9"], "5": True, "6": False, "n": {"a": 3}}, {3, 5, 7, 6}) == [3, 7, 5]


def test_chains_and_captions(spark):
    word = lambda x, t, y=0: ((x, y, x + 30, y + 10), t, 0.9)
    held = some(spark, word(0, "Rated"), word(40, "Voltage"), word(300, "Weight"), word(0, "Serial", 50), word(35, "No.", 50), word(0, "qqq", 90))
    runs = items.chains([(0, (0, 0, 30, 10)), (1, (40, 0, 70, 10)), (2, (300, 0, 330, 10))])
    assert (0, 1) in runs and (1, 2) not in runs and (0, 2) not in runs
    got = {r["field"]: (r["caption"], r["idxs"]) for r in items.captions(held, ["case_id"]).collect()}
    assert got["voltage"] == ("Rated Voltage", [0, 1]) and got["weight"] == ("Weight", [2]) and got["barcode"] == ("Serial No.", [3, 4])


def test_anchors_and_values(spark):
    held = some(spark, ((0, 0, 50, 10), "Weight", 1.0), ((60, 1, 90, 11), "9 kg", 1.0), ((100, 0, 130, 10), "50 Hz", 1.0), ((60, 80, 90, 90), "8 kg", 1.0))
    caption = held.filter("idx = 0").withColumn("field", F.lit("weight")).select("case_id", "idx", "field", "box")
    got = items.value_beside(caption, held, ["case_id"], 400.0, 400.0).collect()
    assert [(r["r_idx"], r["value"], tuple(r["box"])) for r in got] == [(1, "9 kg", (0, 0, 90, 11))]
    about = items.about_anchor(held.filter("idx = 1").select("case_id", "idx", "box"), held, ["case_id"]).orderBy("rank").collect()
    assert [r["r_idx"] for r in about] == [1]
    assert items.joined_text(held, ["case_id"], "idx").first()["text"] == "Weight 9 kg 50 Hz 8 kg"


def test_places(spark):
    left = items.place_features(some(spark, ((0, 0, 50, 10), "Weight", 1.0), ((0, 50, 50, 60), "1234567890", 1.0), ((200, 0, 240, 10), "9 kg", 1.0), ((0, 90, 10, 99), " ", 1.0), ((300, 300, 350, 310), "gone", 1.0)), 400.0, 400.0)
    right = items.place_features(some(spark, ((2, 0, 52, 10), "Weight", 1.0), ((200, 2, 240, 12), "8 kg", 1.0)), 400.0, 400.0)
    assert {r["idx"] for r in left.collect()} == {0, 2, 4}
    pairs = matching.match_positions(left, right, ["case_id"])
    assert {(r["l_idx"], r["r_idx"]) for r in pairs.collect()} == {(0, 0), (2, 1)}
    got = {(r["l_idx"], r["r_idx"], r["read"]) for r in items.position_differences(pairs, left, right, ["case_id"]).collect()}
    assert got == {(2, 1, "8 kg"), (4, None, None)}


def test_boxes_of_values(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    b = boxes.box(*[F.lit(v) for v in (0.0, 0.0, 200.0, 10.0)])
    got = one(items.value_part(b, F.lit("Refrigerant: R32 ok."), F.lit("r32")))
    assert tuple(got) == (124, -3, 166, 13)
    assert one(items.value_part(b, F.lit("R32"), F.lit("R32"))) is None
    assert tuple(one(items.widened_caption(boxes.box(*[F.lit(v) for v in (0.0, 10.0, 20.0, 20.0)]), F.lit(100.0), F.lit(100.0)))) == (0, 6, 47, 24)
    assert one(items.masked(F.lit(0.4), F.lit("x"))) is False and one(items.masked(F.lit(0.4), F.lit("xy"))) is True


def test_annotations(spark):
    rows = spark.createDataFrame([(1, 0, (0.0, 0.0, 9.0, 9.0), True, False), (1, 1, (1.0, 0.0, 9.0, 9.0), True, True), (1, 2, (50.0, 0.0, 60.0, 9.0), False, False), (2, 0, (0.0, 0.0, 9.0, 9.0), False, True)], "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, evidence boolean, forced boolean")
    got = {(r["case_id"], r["idx"]): r["outcome"] for r in items.annotate(rows, ["case_id"]).collect()}
    assert got == {(1, 0): "kept", (1, 1): "overlap", (1, 2): "no_evidence", (2, 0): "kept"}
    held = some(spark, ((0, 0, 9, 9), "50HHz", 1.0), ((20, 0, 29, 9), "50Hz", 1.0))
    values = spark.createDataFrame([(1, "frequency", "50Hz")], "case_id int, field string, expected string")
    found = held.select("case_id", F.lit("frequency").alias("field"), "idx")
    assert [r["idx"] for r in items.text_proposals(values, found, held, ["case_id"]).collect()] == [0]


def test_lower_lines_and_address(spark):
    held = some(spark, ((0, 900, 400, 920), "Add: West street", 1.0), ((0, 10, 50, 20), "additive", 1.0))
    assert [r["idx"] for r in items.address_line(held, ["case_id"], 1000.0, 1000.0).collect()] == [0]
    parts = held.select("case_id", "idx", "box").limit(0).unionByName(spark.createDataFrame([(1, 7, (410.0, 905.0, 420.0, 915.0)), (1, 8, (410.0, 5.0, 420.0, 15.0))], "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>"))
    assert [r["idx"] for r in items.off_lower_lines(parts, held, ["case_id"], 1000.0).collect()] == [8]
    regions = spark.createDataFrame([(1, 0, (0.0, 890.0, 500.0, 930.0))], "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert items.region_items(regions, held, ["case_id"]).count() == 1


def test_decisions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(similarity.settled(F.lit("keep"), F.lit("The ICON moved"), F.lit(True))) == "discard"
    assert one(similarity.settled(F.lit("keep"), F.lit("icon and digit"), F.lit(True))) == "keep"
    assert one(similarity.settled(F.lit("keep"), F.lit("icon"), F.lit(False))) == "keep"
    r = lambda *a: tuple(one(evaluate.recovery_outcome(*[F.lit(v) for v in a])))
    assert r("low_foreground", "template", False)[:3] == ("mismatch", 0.95, False)
    assert r("inference_failed", "target", True)[0] == "mismatch" and r("inference_failed", "template", True)[0] == "unknown" and r("error", "target", True)[4] is True
    e = F.struct(F.lit(True).alias("valid"), *[F.lit(v).alias(n) for n, v in (("diff_ratio", 0.02), ("unmatched_target_ratio", 0.02), ("unmatched_template_ratio", 0.02), ("largest_component_ratio", 0.01))])
    assert one(evaluate.weak_graphic(e)) and one(evaluate.weak_text(e, F.lit("weight"))) and not one(evaluate.weak_text(e, F.lit("label:air_volume"))) and not one(evaluate.strong_value_evidence(e, F.lit(0.5)))
    f = one(evaluate.expected_flags(F.array(F.lit("svg")), F.lit("text_only"), F.lit(0), F.lit(None).cast("string")))
    assert (f["text_diff"], f["graphic_diff"]) == (True, True)
    assert [one(similarity.looks_like_value(F.lit(f), F.lit(t))) for f, t in (("weight", "9 kg"), ("weight", "9 g"), ("frequency", "50H"), ("model_number", "AB1234"), ("mfg_date", "202"), ("other", "x"))] == [True, False, True, True, False, False]

from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import extract, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ACME CO., INC.OF X", "ACME CO., INC. OF X", True),
        ("13.5kg", "135kg", False),
        ("13.5 kg", "13.5KG", True),
        ("220 - 240V~", "220-240V~", True),
        ("１２ｋｇ", "12kg", True),
        ("STRASSE", "straße", True),
        (None, " none ", True),
        (None, "", True),
        ("590m³/h", "590 m3/h", True),
        ("a b", "ab", False),
        ("1 2", "12", True),
    ],
)
def test_values_match(spark, a, b, same):
    assert one(spark, text.values_match(F.col("a"), F.col("b")), a=a, b=b) is same


def test_match_key(spark):
    assert one(spark, text.match_key(F.col("a")), a="590m³/h") == "590m3h"
    assert one(spark, text.match_key(F.col("a")), a=None) == ""


def test_captions(spark):
    key = lambda t: one(spark, text.caption_key(F.col("a")), a=t)
    assert key("Weight") != key("weiGht") and key("Rated  Voltage:") == key("RatedVoltage") and key("NONE") == ""
    code = lambda t: one(spark, text.barcode_caption_key(F.col("a")), a=t)
    assert code("SerialNo.") == code("Serial No.") != code("Serial No..")
    tokens = lambda t: one(spark, text.caption_tokens(F.col("a")), a=t)
    assert tokens("Rated Voltag e 12") == ["rated", "voltage", "12"]
    match = text.token_sets_match(text.caption_tokens(F.col("a")), text.caption_tokens(F.col("b")))
    assert one(spark, match, a="Rated Voltage", b="voltage rated") is True
    assert one(spark, match, a="Voltage", b="voltage") is False


def plain_compare(t):
    """The rule again, step by step in plain Python."""
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip()
    t = re.sub(r" ?([,.:;/~()\-]) ?", r"\1", t)
    t = re.sub(r"(?<=[0-9]) (?=[0-9A-Za-z])|(?<=[A-Za-z]) (?=[0-9])", "", t).casefold()
    return "" if t == "none" else t


def test_compare_key_against_the_rule(spark):
    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet=" \t　aZ09,.:~()-é²ｋßNone", max_size=14), min_size=150, max_size=300))
    def check(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        for r in df.select("t", text.compare_key(F.col("t")).alias("k")).collect():
            assert r["k"] == plain_compare(r["t"]), r["t"]

    check()


@pytest.mark.parametrize(("name", "code"), [("prefix_63249929995_1", "63249929995"), ("template", None), ("12345", None)])
def test_codes(spark, name, code):
    assert one(spark, text.code_of(F.col("a")), a=name) == code


def test_names(spark):
    assert one(spark, text.safe_name(F.col("a")), a="  a b/ç.pdf_ ") == "a_b_.pdf"
    assert one(spark, text.safe_name(F.col("a")), a="///") == "unnamed"
    assert one(spark, text.case_id(F.col("a"), F.col("b")), a="600004075219", b="600004075219_1") == "600004075219__vs__600004075219_1"
    assert one(spark, text.variant_of(F.col("a"), F.col("b")), a="123456-01", b="123456") == "01"
    scanned = text.scan_code(F.col("a"), ("ID:",), ("#",), 6)
    assert one(spark, scanned, a="\x02ID:A1234567#\r\n") == "1234567"
    assert one(spark, text.scan_code(F.col("a")), a=" x\x00y ") == "xy"
    assert re.fullmatch("([0-9A-F]{8}-){3}[0-9A-F]{8}", one(spark, text.fingerprint(F.col("a")), a="x"))


def test_truthiness(spark):
    c = text.coalesce_filled(F.col("a"), F.col("b"))
    assert one(spark, c, a="", b="x") == "x" and one(spark, c, a="0", b="x") == "x" and one(spark, c, a="y", b="x") == "y" and one(spark, c, a=None, b=None) is None
    assert [one(spark, text.present(F.col("a")), a=v) for v in ("x", "", "None", "none", None)] == [True, False, False, True, False]


LABEL = "Model: ABC123DEF45-X/Y N.W.: 13.5 kg\nG.W: 16kg COLOR: White\nCONNECTION PIPES: 1/4\"/3/8\" REFRIGERANT: R32 Serial 6901234567890"


def test_compact_fields(spark):
    got = one(spark, extract.compact_fields(F.col("a")), a=LABEL).asDict()
    assert got == {"model_number": "ABC123DEF45-X/Y", "net_weight": "13.5 kg", "gross_weight": "16kg", "color": "White", "connection_pipes": "1/4\"/3/8\"", "refrigerant": "R32", "barcode": "6901234567890"}
    assert one(spark, extract.label_kind(F.col("a")), a=LABEL) == "compact"
    assert all(v is None for v in one(spark, extract.compact_fields(F.col("a")), a=None).asDict().values())


def test_standard_fields(spark):
    t = "XYZ INDOOR UNIT\nModel AB12-34567/XQ Rated Voltage 220 - 240 V~\nRated Frequency: 5OHz Heating Capacity 3.65 kW Cooling Capacity W 3500W\nAir Flow Volume 590 m3/h Weight: 9,5 kg Net Weight 8kg Noise Level 37 dB(A) Manufactured Date 2025.12 1234567890123"
    got = one(spark, extract.standard_fields(F.col("a"), {"product": r"\b(INDOOR UNIT)\b"}), a=t).asDict()
    assert got == {"model_number": "AB12-34567/XQ", "voltage": "220-240V~", "frequency": "5OHz", "heating_capacity": "3.65kW", "cooling_capacity": "3500W", "air_volume": "590m3/h", "weight": "9,5kg", "noise": "37dB(A)", "mfg_date": "2025.12", "product": "INDOOR UNIT", "barcode": "1234567890123"}
    assert one(spark, extract.label_kind(F.col("a")), a=t) == "standard"


@pytest.mark.parametrize(
    ("field", "value", "odd"),
    [("refrigerant", "R31", True), ("refrigerant", "r 32", False), ("connection_pipes", '1/5"/1/2"', True), ("connection_pipes", '1/4"/3/8"', False), ("net_weight", "13.5 kg", False), ("net_weight", "kg", True), ("barcode", "12345", True), ("color", "Wh1te", True), ("model_number", "SHORT", True), ("other", "x", False), ("other", None, True)],
)
def test_suspicious(spark, field, value, odd):
    assert one(spark, extract.suspicious(field, F.col("a")), a=value) is odd


def test_merging_sources(spark):
    m = lambda f, a, b: one(spark, extract.merge_compact(f, F.col("a"), F.col("b")), a=a, b=b)
    assert m("refrigerant", "R31", "R32") == "R32" and m("refrigerant", "R32", "R3Z") == "R32" and m("refrigerant", None, "R3Z") == "R3Z"
    assert m("barcode", "1234567890", "9999999999") == "1234567890" and m("barcode", "123", "9999999999") == "9999999999" and m("barcode", "123", None) == "123"
    s = lambda f, a, b: one(spark, extract.merge_standard(f, F.col("a"), F.col("b")), a=a, b=b)
    assert s("voltage", "220-240V", "220-240V~") == "220-240V~" and s("frequency", "50HHz", "50Hz") == "50HHz"
    assert s("air_volume", "590m3", "590m3/h") == "590m3" and s("brand", "x", None) == "x" and s("brand", "x", "y") == "y"


@pytest.mark.parametrize(
    ("raw", "decision", "error", "tentative"),
    [
        ('{"decision": "match", "confidence": 0.9}', "match", None, None),
        ('noise {"is_match": false} tail', "mismatch", None, None),
        ('```json\n{"decision": "mismatch"}\n```', "mismatch", None, None),
        ('<think>{x}</think> {"decision": "match"}', "match", None, None),
        ('{"decision": "maybe"}', "unknown", None, None),
        ("<think> are they the same", "unknown", "parse_error", None),
        ("they are different, not the same", "unknown", None, "mismatch"),
        ("两图一致", "unknown", None, "match"),
        ("两图不一致", "unknown", None, "mismatch"),
        ("", "unknown", "parse_error", None),
        (None, "unknown", "parse_error", None),
        ("qwerty {", "unknown", "parse_error", None),
    ],
)
def test_replies(spark, raw, decision, error, tentative):
    got = one(spark, extract.decision(F.col("a")), a=raw)
    assert (got["decision"], got["error_type"], got["tentative"]) == (decision, error, tentative)
    assert got["needs_review"] is (decision == "unknown")


def test_detections_and_filter(spark):
    got = one(spark, extract.detections(F.col("a")), a='{"objects": [{"name": "logo", "bbox_2d": [1, 2, 3, 4]}, {"label": "t", "box": [5, 6, 7, 8]}]}')
    assert [(d["label"], d["box"]) for d in got] == [("logo", [1, 2, 3, 4]), ("t", [5, 6, 7, 8])]
    f = lambda a: tuple(one(spark, extract.filter_decision(F.col("a")), a=a))
    assert f('{"decision": " KEEP ", "confidence": 3}') == ("keep", 1.0, "") and f('{"decision": "x", "confidence": "high", "reason": "r"}') == ("unknown", 0.0, "r")

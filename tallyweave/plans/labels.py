"""Queries over functions of labels, captions, replies and boxes, on known cases.

The test tables hold no labels. Each part takes one of an operator's cases, by its key; the SQL knows what each case has to give, as worked out by hand
from the rules, so that the two sides share nothing but the cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import boxes, extract, similarity, text
from tallyweave.operators import evaluate, items

from .tables import table


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"


class Cases:
    """An operator on known cases: (inputs..., outputs...) rows, with the types of the inputs and the names of the outputs."""

    def __init__(self, inputs: str, outputs: str, of: Callable[..., dict[str, Column]], rows: list[tuple]):
        self.inputs, self.outputs, self.of, self.rows = inputs.split(), outputs.split(), of, rows

    def __call__(self, spark, sf_dir) -> DataFrame:
        at = (F.col("p_partkey") % len(self.rows)).cast("int")
        given = [F.get(F.array(*[F.lit(r[i]).cast(kind) for r in self.rows]), at).alias(f"v{i}") for i, kind in enumerate(self.inputs)]
        rows = table(spark, sf_dir, "part").select("p_partkey", *given)
        made = self.of(*[F.col(f"v{i}") for i in range(len(self.inputs))])
        return rows.select("p_partkey", *[made[n].alias(n) for n in self.outputs])

    @property
    def sql(self) -> str:
        n, names = len(self.inputs), ", ".join(self.outputs)
        rows = ", ".join(f"({i}, {', '.join(map(_literal, r[n:]))})" for i, r in enumerate(self.rows))
        return f"SELECT p_partkey, {names} FROM part JOIN (VALUES {rows}) v(i, {names}) ON p_partkey % {len(self.rows)} = v.i"


def _one(name: str, of: Callable[..., Column]) -> Callable[..., dict[str, Column]]:
    return lambda *c: {name: of(*c)}


def _parts(names: str, of: Callable[..., Column]) -> Callable[..., dict[str, Column]]:
    def made(*c: Column) -> dict[str, Column]:
        s = of(*c)
        return {n: s[n] for n in names.split()}

    return made


def _by_field(fields: tuple[str, ...], of: Callable[..., Column]) -> Callable[..., Column]:
    """of(field name, columns...) of the field that a row has."""
    return lambda field, *c: F.coalesce(*[F.when(field == f, of(f, *c)) for f in fields])


def _box(a: Column) -> Column:
    return boxes.from_array(F.from_json(a, "array<double>"))


def _shown(b: Column) -> Column:
    return F.when(b["x1"].isNotNull(), F.array_join(F.transform(F.array(*[b[s] for s in boxes.SIDES]), lambda v: F.format_number(v, 3).cast("string")), " "))


def _listed(found: Column) -> Column:
    one = lambda d: F.concat(F.coalesce(d["label"], F.lit("-")), F.lit(":"), F.array_join(F.transform(d["box"], lambda v: v.cast("string")), ","))
    return F.coalesce(F.array_join(F.transform(found, one), "|"), F.lit(""))


_STANDARD = "model_number voltage frequency heating_capacity cooling_capacity air_volume weight noise mfg_date barcode"
_COMPACT = "model_number net_weight gross_weight color connection_pipes refrigerant barcode"
_EVIDENCE = "struct<valid:boolean,diff_ratio:double,unmatched_target_ratio:double,unmatched_template_ratio:double,largest_component_ratio:double>"
_DECISION = "decision confidence needs_review error_type tentative"


def _reviews(evidence: Column, field: Column, raw: Column) -> dict[str, Column]:
    e = F.from_json(evidence, _EVIDENCE)
    return {"graphic": evaluate.weak_graphic(e), "words": evaluate.weak_text(e, field), "strong": evaluate.strong_value_evidence(e, raw)}


def _batch(answer: Column) -> dict[str, Column]:
    b = extract.batch_decision(answer, F.array(*[F.lit(i).cast("long") for i in range(1, 10)]))
    return {"decision": b["decision"], "confidence": b["confidence"], "reason": b["reason"], "kept": F.array_join(b["kept"].cast("array<string>"), ",")}


CASES = {
    "standard_spec": Cases("string", _STANDARD, _parts(_STANDARD, extract.standard_fields), [
        ("Rated Voltage: 220-240V~ Rated Frequency: 50Hz Heating Capacity 3.5 kW Cooling Capacity: 2600W Air Flow Volume: 550 m3/h Net Weight 9kg Noise Level dB(A) 38 dB(A) Manufactured Date 2024.05 GWH09ABC-K6DNA1A 1234567890123",
         "GWH09ABC-K6DNA1A", "220-240V~", "50Hz", "3.5kW", "2600W", "550m3/h", None, "38dB(A)", "2024.05", "1234567890123"),
        ("supply 220-240VAC 50Hzx", *[None] * 10),
        ("power 220-240V~ 50Hz. ok", None, "220-240V", "50Hz", *[None] * 7),
        ("Air Volume 600 m3 / h", *[None] * 5, "600m3/h", *[None] * 4),
        ("Air Volume m3/h 600 m", *[None] * 5, "600m", *[None] * 4),
        ("", *[None] * 10),
        (None, *[None] * 10),
        ("Weight 12,5 kg Sound Pressure Level (H) 41 dB A 9876543210", *[None] * 6, "12,5kg", "41dBA", None, "9876543210"),
        ("Heating Capacity H L: 3,2kW\nCooling\nCapacity 1O00 W", *[None] * 3, "3,2kW", "1O00W", *[None] * 5),
        ("Ｖｏｌｔａｇｅ： ２２０－２４０Ｖ", None, "220-240V", *[None] * 8),
    ]),
    "compact_spec": Cases("string", _COMPACT, _parts(_COMPACT, extract.compact_fields), [
        ("GWC12-ABC/D1(X) N.W: 9.5 KG G.W.: 11KG Color: White Connection Pipes: 1/4 3/8 Refrigerant: R32 6901234567890", "GWC12-ABC/D1(X)", "9.5 KG", "11KG", "White", "1/4 3/8", "R32", "6901234567890"),
        ("n w 7kg COLOR GREY", None, "7kg", None, "GREY", None, None, None),
        ("Ｎ．Ｗ：９ＫＧ", None, "9KG", None, None, None, None, None),
        ("", *[None] * 7),
        (None, *[None] * 7),
        ("0123456789 and 012345678901", "012345678901", *[None] * 5, "012345678901"),
    ]),
    "plausible_values": Cases("string string", "suspicious", _one("suspicious", _by_field(("model_number", "net_weight", "color", "barcode", "refrigerant", "connection_pipes", "other"), extract.suspicious)), [
        ("model_number", "ABC", True), ("model_number", "ABCDEFGHIJ", False), ("net_weight", "12 KG", False), ("net_weight", "12", True), ("net_weight", "１２ＫＧ", False),
        ("color", "WHITE", False), ("color", "W1", True), ("barcode", "123-456-7890", False), ("barcode", "123", True), ("refrigerant", "r32", False), ("refrigerant", "R99", True),
        ("connection_pipes", '1/4" 3 / 8"', False), ("connection_pipes", "1/4", True), ("connection_pipes", "1/4 9/9", True), ("other", "x", False), ("other", " ", True), ("color", None, True),
    ]),
    "compact_merge": Cases("string string string", "value", _one("value", _by_field(("barcode", "color", "model_number"), extract.merge_compact)), [
        ("barcode", "1234567890", "99", "1234567890"), ("barcode", "12", "99", "99"), ("barcode", "12", None, "12"), ("color", "W1", "WHITE", "WHITE"), ("color", "WHITE", "W1", "WHITE"),
        ("color", "W2", "W1", "W1"), ("color", None, "", None), ("model_number", "SHORT", "", "SHORT"), ("model_number", None, "x", "x"), ("color", "None", "None", "None"), ("color", "RED", None, "RED"),
    ]),
    "standard_merge": Cases("string string string", "value", _one("value", _by_field(("voltage", "air_volume", "weight", "brand"), extract.merge_standard)), [
        ("voltage", "220V", "220V~", "220V~"), ("voltage", "220V", "110V", "220V"), ("voltage", "220V", "220V and more", "220V"), ("air_volume", "550m", "550m3/h", "550m"), ("brand", "X", "Y", "Y"), ("brand", "X", None, "X"), ("weight", None, "9kg", "9kg"), ("weight", "", "", ""),
    ]),
    "label_schema": Cases("string", "kind", _one("kind", extract.label_kind), [("N.W 9KG COLOR RED", "compact"), ("color", "standard"), ("refrigerant gw", "compact"), (None, "standard")]),
    "reply_objects": Cases("string", "a", _one("a", lambda c: F.get_json_object(extract.salvaged(c), "$.a")), [
        ('{"a": 1}', "1"), ('x ```json\n{"a": 2}\n``` y', "2"), ('noise {bad} then {"a": "3"} {"a": 4}', "3"), ("no json", None), ("", None), (None, None), ('{"a":{"a":', None), ("[1, 2]", None), ('{"a": "\\ud800"}', "�"),
        ('{"a":' * 3000, None), ('[{"a": 5}]', "5"), ("{" * 5000, None), ('```\n{"a": 6}\n```', "6"),
    ]),
    "reply_decisions": Cases("string", _DECISION, _parts(_DECISION, extract.decision), [
        ('{"decision": "match", "confidence": 0.9}', "match", 0.9, False, None, None),
        ('{"decision": "maybe"}', "unknown", 0.0, True, None, None),
        ('{"is_match": false, "confidence": 0.4}', "mismatch", 0.4, False, None, None),
        ("they are 不一致", "unknown", 0.0, True, None, "mismatch"),
        ("identical pictures", "unknown", 0.0, True, None, "match"),
        ("<think>they match", "unknown", 0.0, True, "parse_error", None),
        ("", "unknown", 0.0, True, "parse_error", None),
        (None, "unknown", 0.0, True, "parse_error", None),
        ('so {"decision": "mismatch"} it is', "mismatch", 0.0, False, None, None),
    ]),
    "filter_answers": Cases("string", "decision confidence reason kept", _batch, [
        ('{"decision":"KEEP ","confidence":2}', "keep", 1.0, "", ""),
        ('{"decision":"discard","kept_candidate_ids":[1,"2 and 3",99]}', "keep", 0.0, "", "1,2,3"),
        ('{"decision":"discard","reason":"r","confidence":-1}', "discard", 0.0, "r", ""),
        ('{"decision":"?","changed_ids":{"4":true,"5":false,"x":7}}', "unknown", 0.0, "", "4,7"),
        ('{"decision":"keep","confidence":"0.25","candidate_ids":"8","kept_ids":[1]}', "keep", 0.25, "", "8"),
        ('{"confidence":"sure"}', "unknown", 0.0, "", ""),
        (None, "unknown", 0.0, "", ""),
    ]),
    "detections_found": Cases("string", "boxes", _one("boxes", lambda c: _listed(extract.detections(c))), [
        ('{"objects":[{"label":"a","bbox":[1,2,3,4]},{"name":"b","box":[5,6,7,8]}]}', "a:1.0,2.0,3.0,4.0|b:5.0,6.0,7.0,8.0"),
        ('{"detections":[],"regions":[{"label":"c","coordinate":[0,0,1,1]}]}', ""), ('{"detections":"none","regions":[{"label":"c","coordinate":[0,0,1,1]}]}', "c:0.0,0.0,1.0,1.0"), ('{"x":1}', ""), (None, ""),
        ('{"items":[{"bbox_2d":[1,1,2,2]}]}', "-:1.0,1.0,2.0,2.0"),
    ]),
    "caption_equality": Cases("string string string", "equal lenient", lambda f, a, b: {"equal": similarity.fields_match(f, a, b), "lenient": similarity.lenient_match(f, a, b)}, [
        ("label:voltage", "Rated Voltage", "Voltage", True, True), ("label:voltage", "Voltage", "voltage", False, True), ("label:barcode", "Serial No.", "Serial No", False, True),
        ("label:model_number", "Model", "Model", True, True), ("label:weight", "Weight kg", "kg Weight", True, True), ("voltage", "220 V", "220V", True, True), ("label:color", "Color", "Colour", False, False),
        ("voltage", "220V", "about 220V~", False, True), ("brand", "GREE!", "gree", False, True), ("voltage", None, "none", True, True), ("label:voltage", "Rated Voltage", "Ratod Voltage", False, False),
    ]),
    "caption_words": Cases("string", "words", _one("words", lambda c: F.array_join(text.caption_tokens(c), "|")), [
        ("Rated Voltage V 220", "rated|voltagev|220"), ("A B", "ab"), ("m 3 h", "m|3|h"), ("", ""), (None, ""), ("Net Weight(kg)", "net|weight|kg"), ("Ｎｏｉｓｅ", "noise"),
    ]),
    "volume_numbers": Cases("string", "digits", _one("digits", similarity.volume_number), [("550 m³/h", "550"), ("1,050m3/h", "1050"), ("550", None), ("5 mm", None), ("6OO m3/h", None), (None, None), ("550m h", "550")]),
    "captioned_values": Cases("string string string", "holds", _one("holds", similarity.holds_value), [
        ("220V", "Voltage: 220V", "voltage", True), ("220V", "220V", "voltage", False), ("9kg", "Net Weight 9kg max", "weight", False), ("9kg", "about 9kg!", "weight", True), ("9kg", "12 34 ab 9kg", "weight", False), ("9", "Weight 9", "weight", False), (None, "Weight", "weight", False),
    ]),
    "value_likeness": Cases("string string string", "score", _one("score", lambda v, r, f: F.round(similarity.value_score(v, r, f), 6)), [
        ("220-240V", "220 - 240 v", "voltage", 1.0), ("ABCDEFGHIJ", "ABCDEFGHIK", "model_number", 0.9), ("ABCDEFGHIJ", "ABCD", "model_number", 0.0), ("GWH09ABCDE", "GWH19ABCDE", "model_number", 0.0), ("550m3/h", "550 m³ / h", "air_volume", 1.0),
        ("550 m3/h", "550m h", "air_volume", 0.909091), ("220V", "Voltage: 220V", "voltage", 0.9), ("x", "x", "brand", 0.0), (None, "a", "brand", 0.0),
    ]),
    "value_shapes": Cases("string string", "shape", _one("shape", similarity.looks_like_value), [
        ("voltage", "220-240V~", True), ("frequency", "50H", True), ("frequency", "50", False), ("mfg_date", "2024.05", True), ("mfg_date", "5", False), ("model_number", "AB12345", True), ("weight", "kg", False), ("weight", "9 KG", True), ("air_volume", "550m3/h", True), ("other", "x1", True), ("other", "x", False),
    ]),
    "value_spans": Cases("string string string", "span", _one("span", lambda b, r, v: _shown(items.value_part(_box(b), r, v))), [
        ("[0,0,100,10]", "Voltage 220V", "220v", "60.667 -3.000 106.000 13.000"), ("[0,0,100,10]", "220V", "220V", None), ("[0,0,100,10]", "Voltage 220V", "110V", None), ("[0,0,12,10]", "Voltage 220V", "220V", None), ("[0,0,100,10]", None, "x", None),
    ]),
    "caption_rooms": Cases("string", "box", _one("box", lambda b: _shown(items.widened_caption(_box(b), F.lit(1000.0), F.lit(500.0)))), [
        ("[10,20,110,40]", "10.000 16.000 330.000 44.000"), ("[10,20,410,120]", "10.000 8.000 950.000 132.000"), ("[900,0,990,10]", "900.000 0.000 1,000.000 14.000"),
    ]),
    "masks": Cases("double string", "masked", _one("masked", items.masked), [(0.9, "a", True), (0.5, "a", False), (0.5, "ab", True), (None, "", True), (0.54, None, False), (0.55, " ", True)]),
    "scan_codes": Cases("string", "code", _one("code", lambda c: text.scan_code(c, ("QR:",), ("#",), 6)), [(" QR:12345678# ", "12345678"), ("QR:AB123456X", "123456"), ("QR:xx", "xx"), (None, ""), ("\x02QR:QR:1\r", "QR:1"), ("12#", "12")]),
    "instants": Cases("string", "instant", _one("instant", lambda c: F.unix_seconds(text.utc_time(c))), [
        ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05", 1704164645), ("2024-01-02T03:04:05+01:00", 1704161045), ("2024-01-02", 1704153600), ("2024-13-02", None), ("soon", None), (None, None), ("2024-01-02 03:04:05.5Z", 1704164645),
    ]),
    "expected_differences": Cases("string string long string", "words graphics", lambda k, s, n, g: (lambda f: {"words": f["text_diff"], "graphics": f["graphic_diff"]})(evaluate.expected_flags(F.split(k, ","), s, n, g)), [
        ("text", "", 0, "", True, False), ("svg", None, 0, "", False, True), (None, "mixed", 0, None, True, True), ("", "text_only", None, "", True, False), ("", "svg_only", None, "", False, True), ("", "", 2, "", True, False), ("", "", 0, "logo", False, True), ("other", "", 0, "", False, False),
    ]),
    "evidence_rules": Cases("string string double", "graphic words strong", _reviews, [
        ('{"valid":true,"diff_ratio":0.01,"unmatched_target_ratio":0.01,"unmatched_template_ratio":0.01,"largest_component_ratio":0.01}', "label:air_volume", 0.0, True, False, False),
        ('{"valid":true,"diff_ratio":0.01,"unmatched_target_ratio":0.01,"unmatched_template_ratio":0.01,"largest_component_ratio":0.01}', "voltage", 0.0, True, True, False),
        ('{"valid":true,"diff_ratio":0.2,"unmatched_target_ratio":0.2,"unmatched_template_ratio":0.1,"largest_component_ratio":0.05}', "voltage", 0.03, False, False, True),
        ('{"valid":true,"diff_ratio":0.06,"unmatched_target_ratio":0.06,"unmatched_template_ratio":0.1,"largest_component_ratio":0.04}', "voltage", 0.03, True, False, False),
        ('{"valid":false}', "voltage", 1.0, False, False, False), (None, "voltage", 1.0, False, False, False),
    ]),
    "fused_decisions": Cases("double double double string double", "score decision needs_review source", lambda a, b, c, d, e: {"score": F.round(evaluate.fused_score(a, b, c), 9)} | _parts("decision needs_review source", lambda: evaluate.fused_decision(evaluate.fused_score(a, b, c), d, e))(), [
        (1.0, 1.0, 0.5, "match", 0.9, 0.9, "match", False, "model"), (1.0, 1.0, 1.0, "mismatch", 0.9, 1.0, "mismatch", True, "conflict"), (0.2, 0.2, 0.2, "unknown", 0.9, 0.2, "mismatch", False, "shape"),
        (0.6, 0.6, 0.6, "unknown", 0.9, 0.6, "unknown", True, "shape"), (0.6, 0.6, 0.6, "match", 0.4, 0.6, "match", True, "model"),
    ]),
    "recoveries": Cases("string string boolean", "decision confidence needs_review source unresolved", _parts("decision confidence needs_review source unresolved", evaluate.recovery_outcome), [
        ("low_foreground", "template", False, "mismatch", 0.95, False, "recovery_low_foreground", False), ("inference_failed", "target", True, "mismatch", 0.9, False, "recovery_uncovered_target_graphic", False),
        ("inference_failed", "template", True, "unknown", 0.0, True, "recovery_failed", True), ("inference_failed", "target", False, "unknown", 0.0, True, "recovery_failed", True), ("other", "target", True, "unknown", 0.0, True, "recovery_failed", True),
    ]),
    "verdict_colours": Cases("string", "colour", _one("colour", evaluate.verdict_colour), [("❌ no", "red"), ("✅ 差异", "red"), ("⚠ look ✅", "orange"), ("✅ fine", "green"), ("plain", None), (None, None)]),
    "kinds": Cases("string", "kind", _one("kind", boxes.kind_class), [("svg", "graphic"), ("", "unknown"), (None, "unknown"), ("text", "text")]),
    "box_forms": Cases("string", "normal whole compact", lambda c: {"normal": _shown(boxes.normalise(_box(c))), "whole": _shown(boxes.normalise_int(_box(c))), "compact": _shown(boxes.compacted(_box(c)))}, [
        ("[3,4,1,2]", "1.000 2.000 3.000 4.000", "1.000 2.000 3.000 4.000", "3.000 4.000 1.000 2.000"), ("[0.5,0,2.5,1]", "0.500 0.000 2.500 1.000", "0.000 0.000 2.000 1.000", "0.500 0.000 2.500 1.000"),
        ("[1,1,1,5]", None, None, "1.000 1.000 1.000 5.000"), ("[0.9999999,0,2.34567,1]", "1.000 0.000 2.346 1.000", "1.000 0.000 2.000 1.000", "1.000 0.000 2.346 1.000"), ("[1,2,3]", None, None, None), (None, None, None, None),
    ]),
    "polygons": Cases("string", "box", _one("box", lambda c: _shown(boxes.polygon_bounds(F.from_json(c, "array<array<double>>")))), [
        ("[[0,1],[4,0],[2,7]]", "0.000 0.000 4.000 7.000"), ("[[1],[2,3]]", "2.000 3.000 2.000 3.000"), ("[]", None), (None, None), ("[[null,1],[5,6],[7,8]]", "5.000 6.000 7.000 8.000"),
    ]),
    "wide_keys": Cases("string string", "match_key compare_key equal", lambda a, b: {"match_key": text.match_key(a), "compare_key": text.compare_key(a), "equal": text.values_match(a, b)}, [
        ("２２０ Ｖ～", "220V~", "220v", "220v~", True), ("Straße 5", "STRASSE5", "strae5", "strasse5", True), ("ﬁne", "fine", "fine", "fine", True), ("None", None, "none", "", True), (" a , b ", "A,B", "ab", "a,b", True), ("50 kg", "50kgs", "50kg", "50kg", False), (None, "x", "", "", False),
    ]),
}


def scan_fingerprints(spark, sf_dir) -> DataFrame:
    """The fingerprint of each part's key and name."""
    return table(spark, sf_dir, "part").select("p_partkey", text.fingerprint(F.col("p_partkey"), F.col("p_name")).alias("fingerprint"))


QUERIES: dict[str, tuple[Callable, str | None]] = {name: (c, c.sql) for name, c in CASES.items()} | {
    "scan_fingerprints": (scan_fingerprints, """WITH h AS (SELECT p_partkey, upper(sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}')) AS h FROM part)
        SELECT p_partkey, h[1:8] || '-' || h[9:16] || '-' || h[17:24] || '-' || h[25:32] AS fingerprint FROM h"""),
}

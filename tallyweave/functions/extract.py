"""Fields out of label text, and objects out of model replies."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import similarity, text

# Fields of compact labels, their patterns, and the sizes and refrigerants that are plausible.
COMPACT_PATTERNS = {
    "net_weight": r"(?i)N\s*\.?\s*W\s*\.?\s*:?\s*([0-9]+(?:\.[0-9]+)?\s*KG)",
    "gross_weight": r"(?i)G\s*\.?\s*W\s*\.?\s*:?\s*([0-9]+(?:\.[0-9]+)?\s*KG)",
    "color": r"(?i)COLOR\s*:?\s*([A-Z]+)",
    "connection_pipes": r"""(?i)CONNECTION\s*PIPES?\s*:?\s*([0-9/.\s"']+)""",
    "refrigerant": r"(?i)REFRIGERANT\s*:?\s*([A-Z0-9]+)",
}
PIPE_SIZES = ("1/4", "3/8", "1/2", "5/8", "3/4", "7/8", "1", "1-1/8", "1-3/8")
REFRIGERANTS = ("R22", "R32", "R134A", "R290", "R410A", "R407C", "R417A", "R454B", "R600A")
#: Captions and value patterns of standard labels. Digits may be read as the letters O, I and l.
STANDARD_PATTERNS = {
    "voltage": (r"(?:Rated\s+)?Voltage", r"[0-9OIl]{2,3}\s*[-–]\s*[0-9OIl]{2,3}\s*V\s*~?"),
    "frequency": (r"(?:Rated\s+)?Frequency", r"[0-9OIl]{2,3}\s*H+\s*z\.?"),
    "heating_capacity": (r"Heating\s+Capacity(?:\s+[A-Za-z]){0,2}", r"[0-9OIl]+(?:[.,][0-9OIl]+)?\s*k?\s*W"),
    "cooling_capacity": (r"Cooling\s+Capacity(?:\s+[A-Za-z]){0,2}", r"[0-9OIl]+(?:[.,][0-9OIl]+)?\s*k?\s*W"),
    "air_volume": (r"Air\s*(?:Flow\s*)?Volume(?:\s+m\s*(?:3|\^3)?\s*/\s*h)?", r"[0-9OIl]+(?:[.,][0-9OIl]+)?\s*m\s*(?:(?:3|\^3)?\s*/\s*h?|(?:3|\^3))?"),
    "weight": (r"(?<!Net\s)(?<!Gross\s)Weight(?:\s+kg)?", r"[0-9OIl]+(?:[.,-][0-9OIl]+)?\s*kg"),
    "noise": (r"(?:Sound\s+Pressure\s+Level\s*\(?H\)?|Noise(?:\s+Level)?)(?:\s+dB\s*\(?A\)?)?", r"[0-9OIl]+(?:[.,][0-9OIl]+)?\s*dB\s*\(?A\)?"),
    "mfg_date": (r"(?:Manufactured|Mfg\.?)\s+Date", r"[A-Z0-9]{4}(?:[.\-/]?[A-Z0-9]{1,4})?"),
}
#: Tried before the pattern above: the whole unit.
STRICT_PATTERNS = {"air_volume": r"[0-9OIl]+(?:[.,][0-9OIl]+)?\s*m\s*(?:3|\^3)?\s*/\s*h"}
#: Found without their caption as well, as whole words.
BARE = ("voltage", "frequency")
# Words and keys that decide.
COMPACT_KEYWORDS = ("NW", "N.W", "GW", "G.W", "COLOR", "REFRIGERANT", "CONNECTION PIPE")
#: Fields of standard labels where the printed text stands against the model's.
STANDARD_ANCHORS = ("model_number", "voltage", "frequency", "heating_capacity", "cooling_capacity", "air_volume", "weight", "noise", "mfg_date", "barcode")
COMPACT_ANCHORS = ("model_number", "barcode")
# Words in a reply that speak of a difference, and of likeness; the first are looked for first.
DIFFERENT = ("不一致", "不同", "缺失", "缺少", "多余", "不匹配", "different", "missing", "mismatch", "not match", "inconsistent", "差异", "不相同", "有差别")
ALIKE = ("一致", "相同", "匹配", "完全相同", "same", "match", "identical", "consistent")


def _one_line(c: Column, wide: bool) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.regexp_replace(text.nfkc(t) if wide else t, "[ \t]+", " ")


def _group(c: Column, pattern: str) -> Column:
    """The first group, blanks squeezed; null where there is none."""
    return F.nullif(text.squeeze(F.regexp_extract(c, pattern, 1)), F.lit(""))


def longest(found: Column) -> Column:
    """The longest of an array of texts, the first at a tie."""
    return F.try_element_at(F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), F.lit(1))


def compact_fields(c: Column, wide: bool = True) -> Column:
    """struct of the seven fields of a compact label."""
    t = _one_line(c, wide)
    models = F.regexp_extract_all(F.upper(t), F.lit(r"[A-Z0-9][A-Z0-9\-/()]{8,}"), F.lit(0))
    codes = F.regexp_extract_all(t, F.lit("[0-9]{10,13}"), F.lit(0))
    found = {n: _group(t, p) for n, p in COMPACT_PATTERNS.items()}
    return F.struct(longest(models).alias("model_number"), *[v.alias(n) for n, v in found.items()], longest(codes).alias("barcode"))


def standard_fields(c: Column, phrases: dict[str, str] | None = None, model_pattern: str = r"(?i)[A-Z]{2,4}[0-9][A-Z0-9\-/]{6,}", wide: bool = True) -> Column:
    """struct of the captioned fields of a standard label, with the model, the barcode, and any literal phrases (field -> pattern with one group)."""
    t = _one_line(c, wide)
    out = []
    for name, (caption, value) in STANDARD_PATTERNS.items():
        captioned = [_group(t, rf"(?is){caption}\s*[:：]?\s*[\r\n ]*({v})") for v in (STRICT_PATTERNS.get(name), value) if v]
        found = F.coalesce(*captioned, *([_group(t, rf"(?i)\b({value})\b")] if name in BARE else []))
        out.append(F.regexp_replace(found, text._BLANKS, "").alias(name))
    line = F.regexp_replace(t, text._BLANKS, " ")
    out += [_group(line, p).alias(n) for n, p in (phrases or {}).items()]
    models = F.regexp_extract_all(t, F.lit(model_pattern), F.lit(0))
    codes = F.regexp_extract_all(t, F.lit(r"\b[0-9]{10,13}\b"), F.lit(0))
    return F.struct(F.upper(longest(models)).alias("model_number"), *out, longest(codes).alias("barcode"))


def label_kind(c: Column) -> Column:
    """'compact' where at least two of its keywords occur, else 'standard'."""
    t = F.upper(F.coalesce(c, F.lit("")))
    return F.when(sum(F.contains(t, F.lit(k)).cast("int") for k in COMPACT_KEYWORDS) >= 2, "compact").otherwise("standard")


def suspicious(field: str, c: Column, wide: bool = True) -> Column:
    """Whether a compact label's value is implausible; blank ones are."""
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(text.nfkc(t) if wide else t, r"(?U)^\s+|\s+$", "")
    packed = F.regexp_replace(t, text._BLANKS, "")
    if field == "model_number":
        bad = F.length(packed) < 10
    elif field in ("net_weight", "gross_weight"):
        bad = ~F.lower(packed).rlike(r"^[0-9]+(\.[0-9]+)?kg$")
    elif field == "color":
        bad = ~t.rlike("^[A-Za-z]+$")
    elif field == "barcode":
        bad = F.length(F.regexp_replace(t, "[^0-9]+", "")) < 10
    elif field == "refrigerant":
        bad = ~F.upper(packed).isin(*REFRIGERANTS)
    elif field == "connection_pipes":
        parts = F.transform(F.regexp_extract_all(t, F.lit(r"[0-9]+\s*/\s*[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, r"\s", ""))
        bad = (F.size(parts) < 2) | F.exists(parts, lambda p: ~p.isin(*PIPE_SIZES))
    else:
        bad = F.lit(False)
    return (t == "") | bad


def merge_compact(field: str, rule: Column, model: Column, wide: bool = True) -> Column:
    """Rule against model: of anchors the rule's value stands where it is plausible or the model has none; of other fields the first plausible value, the model's before the rule's, and where neither is, whatever is there in that order."""
    plausible = lambda c: F.when(text.present(c) & ~suspicious(field, c, wide), c)
    there = lambda c: F.when(text.present(c), c)
    if field in COMPACT_ANCHORS:
        return F.coalesce(plausible(rule), there(model), there(rule))
    return F.coalesce(plausible(model), plausible(rule), F.nullif(model, F.lit("")), rule)


def completes(rule: Column, model: Column) -> Column:
    """Whether the model's value is the rule's and one to four characters more."""
    pack = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), text._BLANKS, ""))
    more = F.length(pack(model)) - F.length(pack(rule))
    return (pack(rule) != "") & F.startswith(pack(model), pack(rule)) & more.between(1, 4)


def merge_standard(field: str, rule: Column, model: Column) -> Column:
    """Printed anchors stand, unless the model only completes them (never for air_volume)."""
    if field in STANDARD_ANCHORS:
        fuller = F.lit(False) if field == "air_volume" else completes(rule, model)
        return F.when(fuller, model).when(text.present(rule), rule).otherwise(model)
    return F.when(~text.present(model) & text.present(rule), rule).otherwise(model)


# ---- model replies


#: Braces from which an object is sought, and levels of nesting that one may have.
BRACES, DEPTH = 1_000, 200


def _too_deep(body: str) -> bool:
    """Whether brackets nest beyond DEPTH anywhere; those inside strings count too, which can only make an answer null."""
    depth = 0
    for c in _BRACKET.findall(body):
        depth = depth + 1 if c in "{[" else max(0, depth - 1)
        if depth > DEPTH:
            return True
    return False


_BRACKET = re.compile(r"[{}\[\]]")
_SURROGATE = re.compile("[\ud800-\udfff]")


def salvage(raw: str | None) -> dict | None:
    """The first JSON object of a reply: all of it, the inside of a code fence, or the first brace from which an object can be read.

    The first BRACES braces are tried, so that a long broken reply takes no more than so many readings; a reply whose brackets nest beyond DEPTH gives none.
    """
    if not raw or _too_deep(raw):
        return None
    body = raw.strip()
    inside = [part.partition("\n")[2] if not part.lstrip().startswith("{") else part for part in body.split("```")[1::2]]
    for whole in (body, *inside):
        try:
            found = json.loads(whole.strip())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    read, at = json.JSONDecoder().raw_decode, body.find("{")
    for _ in range(BRACES):
        if at < 0:
            return None
        try:
            return read(body, at)[0]
        except ValueError:
            at = body.find("{", at + 1)
    return None


@F.arrow_udf(T.StringType())
def salvaged(raw: pa.Array) -> pa.Array:
    """The object as JSON text, to be read by ``from_json``; null where there is none. Halves of characters that a reply escapes alone become the replacement sign."""
    found = (salvage(r) for r in raw.to_pylist())
    return pa.array([None if o is None else _SURROGATE.sub("\ufffd", json.dumps(o, ensure_ascii=False)) for o in found], pa.string())


REPLY = "struct<decision:string,is_match:boolean,confidence:double,differences:array<string>,summary:string>"


def decision(raw: Column) -> Column:
    """struct<decision, confidence, needs_review, error_type, tentative> of a reply about two regions.

    A decision in JSON counts, then the older is_match; a reply without either never is a mismatch: words of difference or
    likeness only make it tentative, and a reply that is thinking alone, or nothing, is a parse error.
    """
    r = F.from_json(salvaged(raw), REPLY)
    t = F.lower(F.coalesce(raw, F.lit("")))
    said = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    known = F.when(r["decision"].isin("match", "mismatch", "unknown"), r["decision"]).when(r["decision"].isNotNull(), "unknown")
    known = F.coalesce(known, F.when(r["is_match"].isNotNull(), F.when(r["is_match"], "match").otherwise("mismatch")))
    thinks = F.contains(t, F.lit("<think")) | F.contains(t, F.lit("thinking process"))
    guess = F.when(thinks, None).when(said(DIFFERENT), "mismatch").when(said(ALIKE), "match")
    return F.struct(
        F.coalesce(known, F.lit("unknown")).alias("decision"),
        F.when(known.isNotNull(), F.coalesce(r["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
        (F.coalesce(known, F.lit("unknown")) == "unknown").alias("needs_review"),
        F.when(known.isNull() & guess.isNull(), "parse_error").alias("error_type"),
        F.when(known.isNull(), guess).alias("tentative"),
    )


def batch_decision(object_json: Column, valid: Column) -> Column:
    """As ``filter_decision``, of an answer about several candidates (ids ``valid``), with ``kept``: the valid ids under the first of its keys that holds any. Where there are some, discard becomes keep."""
    one = filter_decision(object_json)
    found = [similarity.harvested(F.get_json_object(object_json, f"$.{k}"), valid) for k in KEPT_KEYS]
    kept = F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<bigint>"))
    decided = F.when((one["decision"] == "discard") & (F.size(kept) > 0), "keep").otherwise(one["decision"])
    return F.struct(decided.alias("decision"), one["confidence"].alias("confidence"), one["reason"].alias("reason"), kept.alias("kept"))


def domain(c: Column, allowed: tuple[str, ...], other: str) -> Column:
    """The trimmed lower-case value where it is allowed, else ``other``."""
    t = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*allowed), t).otherwise(other)


def filter_decision(object_json: Column) -> Column:
    """struct<decision, confidence, reason> of one answer of the candidate filter: out of domain is unknown, confidence within 0 and 1."""
    r = F.from_json(object_json, "struct<decision:string,confidence:string,reason:string>")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0))))
    return F.struct(domain(r["decision"], ("keep", "discard"), "unknown").alias("decision"), sure.alias("confidence"), F.coalesce(r["reason"], F.lit("")).alias("reason"))


# Keys under which a reply may list its detections, and a detection its box.
KEPT_KEYS = ("kept_candidate_ids", "keep_candidate_ids", "changed_candidate_ids", "candidate_ids", "kept_ids", "changed_ids")
LIST_KEYS = ("detections", "objects", "regions", "boxes", "results", "items")
BOX_KEYS = ("bbox", "bbox_2d", "box", "coordinate")


def detections(object_json: Column) -> Column:
    """array<struct<label, box>> of a reply: the first of the known keys that holds a list."""
    one = "struct<label:string,name:string," + ",".join(f"{k}:array<double>" for k in BOX_KEYS) + ">"
    lists = [F.from_json(F.get_json_object(object_json, f"$.{k}"), f"array<{one}>") for k in LIST_KEYS]
    return F.transform(F.coalesce(*lists), lambda d: F.struct(F.coalesce(d["label"], d["name"]).alias("label"), F.coalesce(*[d[k] for k in BOX_KEYS]).alias("box")))

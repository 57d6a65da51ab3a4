"""Text normalisation and equality.

The regex steps are built-in expressions. NFKC and case folding have no built-in, so a plan runs one Arrow
function for them over a whole column, and only over texts that are not ASCII: others are folded
in place.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def _wide(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def nfkc(c: Column) -> Column:
    """Unicode NFKC; ASCII texts never reach Python as anything but null."""
    return F.coalesce(_nfkc(F.when(_wide(c), c)), c)


def casefold(c: Column) -> Column:
    return F.coalesce(_casefold(F.when(_wide(c), c)), F.lower(c))


#: White space as Unicode has it; the (?U) makes the engine read \s so.
_BLANKS = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _BLANKS, " "), "^ | $", "")


def match_key(c: Column, wide: bool = True) -> Column:
    """For matching: compatibility forms, lower case, and only 0-9 and a-z; null gives an empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(c) if wide else c), "[^0-9a-z]+", "")


def compare_key(c: Column, wide: bool = True) -> Column:
    """For equality: blanks and blanks about punctuation don't count, nor do gaps next to digits; an absent value, a blank and 'none' are one."""
    c = F.coalesce(c, F.lit(""))
    t = squeeze(nfkc(c) if wide else c)
    t = F.regexp_replace(t, r" ?([,.:;/~()\-]) ?", "$1")
    t = F.regexp_replace(t, r"(?<=[0-9]) (?=[0-9A-Za-z])|(?<=[A-Za-z]) (?=[0-9])", "")
    t = casefold(t) if wide else F.lower(t)
    return F.when(t == "none", "").otherwise(t)


def values_match(a: Column, b: Column, wide: bool = True) -> Column:
    return compare_key(a, wide) == compare_key(b, wide)


def caption_key(c: Column, wide: bool = True) -> Column:
    """For captions: case counts, only letters and digits of ASCII do."""
    c = F.coalesce(c, F.lit(""))
    t = squeeze(nfkc(c) if wide else c)
    return F.when(F.lower(t) == "none", "").otherwise(F.regexp_replace(t, "[^0-9A-Za-z]+", ""))


def barcode_caption_key(c: Column, wide: bool = True) -> Column:
    """For barcode captions: punctuation counts, blanks don't."""
    c = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(nfkc(c) if wide else c, _BLANKS, "")
    return F.when(F.lower(t) == "none", "").otherwise(t)


def caption_tokens(c: Column, wide: bool = True) -> Column:
    """Words and numbers of a caption in small letters; a single letter is joined to the word before it."""
    t = nfkc(F.coalesce(c, F.lit(""))) if wide else F.coalesce(c, F.lit(""))
    raw = F.regexp_extract_all(t, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    word = lambda s: s.rlike("^[A-Za-z]+$")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.length(s) == 1) & word(s) & F.coalesce(word(last), F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.transform(F.aggregate(raw, F.array().cast("array<string>"), step), F.lower)


def token_sets_match(a: Column, b: Column) -> Column:
    """Equal sets of at least two tokens a side."""
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def present(c: Column) -> Column:
    """Not null, not empty, and not the word None as it is written there."""
    return c.isNotNull() & ~c.isin("", "None")


def coalesce_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty (nor 0 nor false), else the last."""

    def filled(c: Column) -> Column:
        return F.when(~F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), c)

    return F.coalesce(*[filled(c) for c in columns[:-1]], columns[-1])


# ---- names and codes


def code_of(name: Column, least: int = 6) -> Column:
    """The first run of at least ``least`` digits, or null."""
    return F.nullif(F.regexp_extract(name, f"([0-9]{{{least},}})", 1), F.lit(""))


def safe_name(name: Column) -> Column:
    """A file name: runs of other signs become one underscore, none at the ends; 'unnamed' where nothing is left."""
    t = F.btrim(F.regexp_replace(F.btrim(name), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.when(t == "", "unnamed").otherwise(t)


def case_id(template_stem: Column, target_stem: Column) -> Column:
    return safe_name(F.concat(template_stem, F.lit("__vs__"), target_stem))


def variant_of(stem: Column, code: Column) -> Column:
    """What follows the code in a file's stem, without separators; empty for the plain file."""
    return F.btrim(F.when(F.startswith(stem, code), F.substr(stem, F.length(code) + 1)).otherwise(stem), F.lit("-_ "))


def scan_code(c: Column, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), least: int | None = None) -> Column:
    """What a scanner sent: control signs out, blanks off, each prefix then each suffix off once, and the code alone if asked for."""
    t = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", ""))
    for p in prefixes:
        t = F.when(F.startswith(t, F.lit(p)), F.substr(t, F.lit(len(p) + 1))).otherwise(t)
    for s in suffixes:
        t = F.when(F.endswith(t, F.lit(s)), F.substr(t, F.lit(1), F.length(t) - len(s))).otherwise(t)
    t = F.btrim(t)
    return F.coalesce(code_of(t, least), t) if least else t


def fingerprint(*columns: Column) -> Column:
    """Four groups of eight hex digits of the SHA-256 of the columns as JSON."""
    h = F.upper(F.sha2(F.to_json(F.struct(*columns)), 256))
    return F.concat_ws("-", *[F.substring(h, 8 * i + 1, 8) for i in range(4)])


def utc_time(c: Column) -> Column:
    """The instant of a text as ISO 8601 has it: a trailing Z or no offset is UTC; null where it is none."""
    t = F.btrim(F.coalesce(c, F.lit("")))
    offset = t.rlike(r"[0-9]{2}:[0-9]{2}.*([Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$"), F.try_to_timestamp(F.when(offset, t).when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))))

"""Model-output clean-up and strict JSON checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import py_regex, ustrip

# ---------------------------------------------------------------------------
# The two fence dialects.
# ---------------------------------------------------------------------------
# (a) first fenced JSON array of objects
FENCED_ARRAY = r"```(?:json)?\s*(\[\s*\{.*?\}\s*\])\s*```"
# (b) every fence opener is deleted
FENCE_OPENER = r"```(?:json)?\s*"
# ---------------------------------------------------------------------------


def unfence_array(raw: Column) -> Column:
    """Dialect (a): the fenced array if there is one, else the stripped text."""
    p = "(?s)" + py_regex(FENCED_ARRAY)
    return F.when(raw.rlike(p), F.regexp_extract(raw, p, 1)).otherwise(ustrip(raw))


def unfence(raw: Column) -> Column:
    """Dialect (b): delete every fence opener, then strip."""
    return ustrip(F.regexp_replace(raw, py_regex(FENCE_OPENER), ""))


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else (``json.loads``).

    Spark's JSON functions stop after the first value, so the text is read as
    the first of two array elements: it is one value exactly when the array
    then has two elements and the second is ours (the text's own digest, which
    it cannot contain).  Repeated keys are valid.
    Spark also accepts quotes ``'`` and raw control characters in strings;
    what is left without the string literals shows those.  Null is not JSON.
    Deviation: ``NaN`` and ``Infinity`` are rejected.
    """
    end = F.md5(text.cast("binary"))
    pair = F.concat(F.lit("["), text, F.lit(', "'), end, F.lit('"]'))
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", "x"), r'"[^"\x00-\x1f]*"', "")
    return F.coalesce((F.json_array_length(pair) == 2) & (F.get_json_object(pair, "$[1]") == end)
                      & ~rest.rlike(r"""["'\x00-\x08\x0b\x0c\x0e-\x1f]"""), F.lit(False))


def json_kind(text: Column) -> Column:
    """'array' / 'object' / 'scalar' for valid JSON, null when it is not."""
    first = F.substring(F.trim(text, F.lit(" \t\n\r")), 1, 1)  # of a valid text: its type
    return F.when(is_json(text), F.when(first == "[", "array").when(first == "{", "object").otherwise("scalar"))


def object_field(text: Column, key: str) -> Column:
    """The value of ``key`` as VARIANT; of a repeated key the last (null: none, or no object)."""
    return F.from_json(text, f"`{key}` variant")[key]


def _is_int(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def required_int_key_rules(text: Column, kind: Column, key: str) -> Column:
    """Q5: rule violations (array<string>) for one model answer: it must be
    valid JSON, an object with an integer ``key`` or a non-empty array of such
    objects.  ``kind`` is the text's ``json_kind``; pass both as columns of an
    earlier projection."""
    elems = F.from_json(text, "array<string>")
    return F.filter(F.array(
        F.when(kind.isNull(), F.lit("invalid_json")),
        F.when(kind == "scalar", F.lit("not_object_or_array")),
        F.when((kind == "object") & ~_is_int(object_field(text, key)), F.lit(f"{key}_not_integer")),
        F.when((kind == "array") & (F.size(elems) == 0), F.lit("empty_array")),
        F.when((kind == "array") & F.exists(elems, lambda e: ~_is_int(object_field(e, key))),
               F.lit(f"element_{key}_not_integer"))), lambda r: r.isNotNull())

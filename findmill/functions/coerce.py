"""Coercion of untrusted JSON values (VARIANT) into finding columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findmill import vocab
from findmill.functions.text import strip

_INT_TEXT = r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"


def json_type(v: Column) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, ARRAY<..>, OBJECT<..>; NULL if absent."""
    return F.schema_of_variant(v)


def field(v: Column, name: str) -> Column:
    """Value at a key, or at a dotted path of keys; NULL where a step is no object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def array_of(v: Column) -> Column:
    """Elements of an array, NULL for anything else; does not look into the elements."""
    return F.try_variant_get(v, "$", "array<variant>")


def elements(v: Column) -> Column:
    """Elements of an array; a lone object counts as one; anything else has none."""
    return F.coalesce(array_of(v), F.when(is_object(v), F.array(v)))


def is_object(v: Column) -> Column:
    return F.coalesce(json_type(v).startswith("OBJECT"), F.lit(False))


def as_text(v: Column, fallback: str | Column | None = None) -> Column:
    """Text form, trimmed; absent and null take the fallback, '' does not."""
    kind = json_type(v)
    text = (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .otherwise(F.to_json(v))
    )
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("string")
    return F.coalesce(strip(text), fallback)


def as_optional_text(v: Column) -> Column:
    return F.nullif(as_text(v), F.lit(""))


def as_number(v: Column) -> Column:
    """Whole number (truncated toward 0) as a double; NULL for anything not a number.

    A string counts only when it spells an integer; true is 1 and false 0.
    """
    kind = json_type(v)
    text = F.try_variant_get(v, "$", "string")
    number = (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind == "STRING", F.when(
            text.rlike(_INT_TEXT), F.regexp_replace(strip(text), "_", "").try_cast("double")))
        .when(
            (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"),
            F.try_variant_get(v, "$", "double"),
        )
    )
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")


def overflows(v: Column) -> Column:
    """A number beyond the double range: it invalidates the whole record."""
    return F.coalesce(
        F.abs(F.try_variant_get(v, "$", "double")) == float("inf"), F.lit(False)
    ) & (json_type(v) == "DOUBLE")


def as_severity(v: Column) -> Column:
    """Upper-cased without trimming; unknown or non-text is MEDIUM."""
    text = F.when(json_type(v) == "STRING", F.upper(F.try_variant_get(v, "$", "string")))
    return F.when(text.isin(vocab.SEVERITIES), text).otherwise("MEDIUM")


def as_confidence(v: Column) -> Column:
    """0..100; 60 when the key is absent, 50 when its value is no number."""
    number = as_number(v)
    number = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)))
    return (
        F.when(v.isNull(), F.lit(vocab.CONFIDENCE_ABSENT))
        .otherwise(F.coalesce(number, F.lit(vocab.CONFIDENCE_INVALID)))
        .cast("bigint")
    )


def as_line(v: Column) -> Column:
    """Positive whole number, else NULL: a line is never made up."""
    number = as_number(v)
    return F.when((number > 0) & (number < 9.2e18), number.cast("bigint"))

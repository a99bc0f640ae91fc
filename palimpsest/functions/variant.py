"""Typed reads of JSON values of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_BLOCKS = ["text", "input_text", "output_text"]


def get(v: Column, path: str) -> Column:
    """The value at a path; NULL when absent.  A JSON null is a value."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string(v: Column, path: str = "$") -> Column:
    """A string at a path; NULL when absent or of another type."""
    return F.when(kind(get(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def count(v: Column, path: str) -> Column:
    """A nonnegative integer at a path; NULL when absent or anything else."""
    n = F.when(kind(get(v, path)) == "BIGINT", F.try_variant_get(v, path, "long"))
    return F.when(n >= 0, n)


def items(v: Column, path: str = "$") -> Column:
    """An array of values at a path; NULL when absent or of another type."""
    return F.when(
        F.startswith(kind(get(v, path)), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>")
    )


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def json(v: Column) -> Column:
    """Compact JSON text with sorted keys; ``null`` when absent."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def _blocks(v: Column) -> Column:
    empty = F.expr("cast(array() as array<variant>)")
    return F.filter(F.coalesce(items(v), empty), lambda b: string(b, "$.type").isin(TEXT_BLOCKS))


def payload_text(v: Column) -> Column:
    """Text of a string or of an array's text blocks."""
    joined = F.concat_ws("", F.transform(_blocks(v), lambda b: F.coalesce(string(b, "$.text"), F.lit(""))))
    return F.coalesce(string(v), joined)


def supported_content(v: Column) -> Column:
    """A string, or a nonempty array of nothing but text blocks."""
    def plain(b: Column) -> Column:
        keys = F.json_object_keys(F.to_json(b))
        return (
            string(b, "$.type").isin(TEXT_BLOCKS)
            & string(b, "$.text").isNotNull()
            & (F.size(F.array_except(keys, F.array(F.lit("type"), F.lit("text")))) == 0)
        )

    array = items(v)
    whole = (F.size(array) > 0) & F.forall(array, lambda b: F.coalesce(plain(b), F.lit(False)))
    return F.coalesce(string(v).isNotNull() | F.coalesce(whole, F.lit(False)), F.lit(False))


def eligible_bytes(v: Column, least: int = 256) -> Column:
    """Text bytes of supported content over the minimum; else 0."""
    size = F.octet_length(payload_text(v)).cast("long")
    return F.when(supported_content(v) & (size > least), size).otherwise(F.lit(0)).cast("long")


def link_id(v: Column, path: str) -> Column:
    """A nonempty string of at most 256 bytes without control characters."""
    text = string(v, path)
    ok = (text != "") & (F.octet_length(text) <= 256) & ~text.rlike(r"[\x00-\x1f\x7f-\x9f]")
    return F.when(ok, text)

"""Bounded, repeatable samples for fitting, and the bits that several fitted operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def balanced(rows: DataFrame, label: str, per_label: int, key: str) -> DataFrame:
    """At most ``per_label`` rows of each label, chosen by a hash of the key; no text is moved.

    ``rows`` holds key and label only. Spark keeps ``per_label`` rows per label and map task before the shuffle.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_label).drop("__place")


def has_letter(text: Column) -> Column:
    """Whether a text holds a letter of any script; null has none."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def collect_features(frame: DataFrame, compute: Callable, schema: str) -> list:
    """Compact feature rows of a bounded sample, computed where the texts are."""
    return frame.mapInArrow(compute, schema).collect()

"""Per-session totals over items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.tokens import elidable_tokens
from palimpsest.plans.policy import KEYS


def session_totals(items: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """One row per session: context, elidable tokens, extent, and the texts a card quotes.

    ``usage`` gives ``reported_context`` per session; where it is NULL the context is the
    sum of the item estimates.
    """
    marker = F.lit(fixed.CARD_MARKER)
    said = F.col("summary")
    goal_row = (
        (F.col("kind") == "user")
        & said.isNotNull()
        & ~F.startswith(said, F.lit("<"))
        & ~F.startswith(said, marker)
    )
    line = F.col("line_index")
    out = items.groupBy(*KEYS).agg(
        F.count("*").alias("items"),
        F.sum("est_tokens").alias("estimated_context"),
        F.sum(elidable_tokens()).alias("elidable_tokens"),
        F.max("line_index").alias("max_line"),
        F.max_by("summary", F.when(goal_row, line)).alias("goal"),
        F.max_by(F.struct("summary"), F.when(F.col("kind") == "assistant", line)).alias("_work"),
    )
    out = out.withColumn(
        "current_work",
        F.when(~F.startswith(F.col("_work.summary"), marker), F.col("_work.summary")),
    ).drop("_work")
    if usage is None:
        return out.withColumn("context_tokens", F.col("estimated_context"))
    reported = usage.select(*KEYS, "reported_context")
    return (
        out.join(reported, KEYS, "left")
        .withColumn("context_tokens", F.coalesce("reported_context", "estimated_context"))
        .drop("reported_context")
    )


def whole_sums(rows: DataFrame, keys: Sequence[str], value: str, order: str, name: str, *others: Column) -> DataFrame:
    """Per key the sum of ``value``, a double, rounded to a whole number, beside ``others``.

    A sum of doubles depends on the order in which they are added. Where that can decide how it is rounded, as it lies about halfway between two whole numbers, the
    key's values are added one after the other in ``order``. All other sums are rounded alike in any order.
    """
    keys, v = list(keys), F.col(value)
    # Twice as much as two orders of adding may differ by.
    most = F.count(v) * F.sum(F.abs(v)) * F.lit(2.0**-51)
    sums = rows.groupBy(*keys).agg(F.sum(v).alias("_sum"), most.alias("_most"), *others)
    half = F.abs(F.pmod(F.abs("_sum"), F.lit(1.0)) - 0.5) <= F.col("_most")
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    again = rows.select(*keys, order, value).join(sums.filter(half).select(*keys), keys, "left_semi")
    ordered = again.withColumn("_so_far", F.sum(v).over(so_far)).groupBy(*keys).agg(F.max_by("_so_far", order).alias("_ordered"))
    whole = F.round(F.coalesce("_ordered", "_sum")).cast("long").alias(name)
    return sums.join(ordered, keys, "left").select(*[c for c in sums.columns if c not in ("_sum", "_most")], whole)

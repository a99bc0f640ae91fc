"""Assistant steps: a step starts where the assistant side resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordered import exclusive_sums, line_levels, previous
from palimpsest.plans.policy import KEYS

ASSISTANT_SIDE = ["assistant", "tool_call", "reasoning"]


def turn_starts(items: DataFrame) -> DataFrame:
    """The live rows that start an assistant step.  Rows without tokens are not live."""
    live = items.filter(F.col("est_tokens") > 0).select(
        *KEYS, "line_index", F.col("kind").isin(ASSISTANT_SIDE).alias("_assistant")
    )
    seen = previous(live, KEYS, line_levels(), {"_was_assistant": F.col("_assistant")})
    start = F.col("_assistant") & ~F.coalesce(F.col("_was_assistant"), F.lit(False))
    return seen.filter(start).select(*KEYS, "line_index")


def turns(items: DataFrame) -> DataFrame:
    """Live items with their step number; 0 is the head before the first step."""
    live = items.filter(F.col("est_tokens") > 0)
    seen = previous(
        live.withColumn("_assistant", F.col("kind").isin(ASSISTANT_SIDE)),
        KEYS,
        line_levels(),
        {"_was_assistant": F.col("_assistant")},
    )
    start = (F.col("_assistant") & ~F.coalesce(F.col("_was_assistant"), F.lit(False))).cast("long")
    counted = exclusive_sums(
        seen.withColumn("_start", start), KEYS, line_levels(), {"_starts_before": F.col("_start")}
    )
    return counted.withColumn("turn", F.col("_starts_before") + F.col("_start")).select(
        *items.columns, "turn"
    )


def turn_summary(items: DataFrame) -> DataFrame:
    """One row per step: extent, rows and tokens."""
    return turns(items).groupBy(*KEYS, "turn").agg(
        F.min("line_index").alias("first_line"),
        F.max("line_index").alias("last_line"),
        F.count("*").alias("items"),
        F.sum("est_tokens").alias("tokens"),
    )

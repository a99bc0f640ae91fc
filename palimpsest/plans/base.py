"""What every planner shares: the due sessions, the candidates, the result."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.text import card_class, tool_name
from palimpsest.functions.tokens import elision_savings, is_elidable
from palimpsest.operators.ordered import exclusive_sums, line_levels, newest
from palimpsest.plans.policy import KEYS, effective_trigger
from palimpsest.session import cut


class Plans(NamedTuple):
    """``plans``: one row per session and strategy.  ``edits``: one row per elided line."""

    plans: DataFrame
    edits: DataFrame


class Prepared(NamedTuple):
    """Inputs of the planners, computed once and shared."""

    items: DataFrame
    sessions: DataFrame  # due sessions: totals and policy columns
    elidable: DataFrame  # elidable rows of due sessions, narrow
    unprotected: DataFrame  # elidable rows before the protected tail
    keep: int | None


def due(sessions: DataFrame) -> DataFrame:
    """Sessions whose context reached the trigger."""
    return sessions.filter(F.col("context_tokens") >= effective_trigger())


def protected_cut(elidable: DataFrame, sessions: DataFrame, keep: int | None) -> DataFrame:
    """First line of the protected tail: the ``keep``-th newest elidable row.

    With one ``keep`` for all sessions Spark limits each task to that many rows per
    session.  With ``keep`` per session (None) the rank is a blocked running count.
    """
    if keep is not None:
        tail = newest(elidable.select(*KEYS, "line_index"), KEYS, [F.col("line_index").desc()], keep)
    else:
        ranked = exclusive_sums(
            elidable.select(*KEYS, "line_index"),
            KEYS,
            line_levels(newest_first=True),
            {"_newer": F.lit(1)},
        ).join(sessions.select(*KEYS, "keep_recent_tool_outputs"), KEYS)
        tail = ranked.filter(F.col("_newer") < F.col("keep_recent_tool_outputs"))
    return tail.groupBy(*KEYS).agg(F.min("line_index").alias("cut_line"))


def before_cut(rows: DataFrame, edge: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows before the cut; all rows where there is no cut."""
    joined = rows.join(edge, keys, "left")
    kept = joined.filter(F.col("cut_line").isNull() | (F.col("line_index") < F.col("cut_line")))
    return kept.drop("cut_line")


def whole_text(items: DataFrame) -> Column:
    """What classes and scores read of an item: its whole content where the table has it, else its summary."""
    return F.coalesce("content", "summary") if "content" in items.columns else F.col("summary")


def prepare(items: DataFrame, sessions: DataFrame, keep: int | None = 8) -> Prepared:
    """Narrow the items to what planners read.

    ``sessions`` has the totals and the policy columns.  Payload text is not carried:
    a card quotes labels and summaries only, but its classes come from the whole ``content`` where items have one.
    """
    ready = cut(due(sessions), "sessions")
    text = F.coalesce("summary", "label")
    seen = F.coalesce(whole_text(items), text)
    elidable = (
        items.filter(is_elidable())
        .join(ready.select(*KEYS), KEYS, "left_semi")
        .select(
            *KEYS,
            "line_index",
            "elidable_bytes",
            "label",
            "payload_sha256",
            elision_savings().alias("savings"),
            tool_name("label").alias("tool"),
            text.alias("text"),
            card_class(seen, "kind").alias("card_class"),
            "tool_use_ids",
        )
    )
    elidable = cut(elidable, "elidable")
    unprotected = before_cut(elidable, protected_cut(elidable, ready, keep))
    return Prepared(items, ready, elidable, unprotected, keep)


def remaining(candidates: DataFrame, sessions: DataFrame, levels: list[Column]) -> DataFrame:
    """Add ``remaining`` (context left before this candidate is taken) and ``place`` in the walk.

    The walk stops at the first candidate whose remaining context is at or under the
    floor.  As savings are never negative that is one comparison per row.
    """
    summed = exclusive_sums(candidates, KEYS, levels, {"_freed": F.col("savings"), "place": F.lit(1)})
    context = sessions.select(*KEYS, "context_tokens", "floor_tokens")
    return summed.join(context, KEYS).withColumn(
        "remaining", F.greatest(F.col("context_tokens") - F.col("_freed"), F.lit(0))
    )


def finish(
    strategy: str, chosen: DataFrame, sessions: DataFrame, stub: str = fixed.STUB
) -> Plans:
    """Plan and edits of a strategy without a state card."""
    edits = chosen.select(
        *KEYS,
        F.lit(strategy).alias("strategy"),
        F.lit("elide").alias("op"),
        "line_index",
        "savings",
        F.lit(stub).alias("stub"),
    )
    sums = edits.groupBy(*KEYS).agg(
        F.count("*").alias("edits"),
        F.sum("savings").alias("freed"),
        F.min("line_index").alias("first_line"),
    )
    plans = sums.join(sessions.select(*KEYS, "context_tokens"), KEYS).select(
        *KEYS,
        F.lit(strategy).alias("strategy"),
        F.col("context_tokens").alias("tokens_before"),
        F.greatest(F.col("context_tokens") - F.col("freed"), F.lit(0)).alias("tokens_after"),
        "edits",
        "first_line",
    )
    return Plans(plans, edits)

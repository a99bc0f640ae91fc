"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest import fixed
from palimpsest.operators.observe import COHORT, with_digest
from palimpsest.sources.observations import append_observations

SHOW_AGAIN_SECS = 1_200
GROWTH_TOKENS = 25_000


def ingest(
    stream: DataFrame, read_store: Callable[[], DataFrame], write_store: Callable[[DataFrame, int], None],
    write_conflicts: Callable[[DataFrame, int], None], checkpoint: str,
) -> StreamingQuery:
    """Append observations batch by batch under the identity rules.

    A replayed batch finds its rows in the store and adds nothing, so a restart after a
    lost driver is safe.  A batch with a conflict adds nothing and reports it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        result = append_observations(with_digest(batch), read_store())
        write_conflicts(result.conflicts, batch_id)
        write_store(result.inserted, batch_id)

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def activity_windows(events: DataFrame, keys: list[str], ts: str = "observed_at", gap_secs: int = fixed.HOT_SECS,
                     late: str | None = None) -> DataFrame:
    """Stretches of activity: a gap over ``gap_secs`` ends one.  Works on streams and tables.

    Session windows merge partial windows before the shuffle, so a busy key spreads.
    """
    if late is not None:
        events = events.withWatermark(ts, late)
    span = F.session_window(ts, f"{gap_secs} seconds")
    return events.groupBy(*keys, span.alias("span")).agg(F.count("*").alias("events")).select(
        *keys, F.col("span.start").alias("first_at"), F.col("span.end").alias("until"), "events"
    )


def rolling_requests(obs: DataFrame, size: str, slide: str, late: str | None = None) -> DataFrame:
    """Ended requests in sliding windows, per cohort: count, outcomes, output tokens, time."""
    ends = obs.filter(F.col("kind") == "request_finished")
    if late is not None:
        ends = ends.withWatermark("observed_at", late)
    end = F.col("request_finished")
    output = end["usage"]["output_tokens"]
    return ends.groupBy(
        F.window("observed_at", size, slide).alias("span"),
        F.col("source.kind").alias("source_kind"), F.col("source.profile").alias("source_profile"),
    ).agg(
        F.count("*").alias("requests"),
        F.count_if(end["outcome"] == "success").alias("succeeded"),
        F.sum(F.when(output["basis"] == "reported", output["value"])).alias("reported_output_tokens"),
        F.sum(end["duration_ms"]).alias("duration_ms"),
    ).select(F.col("span.start").alias("from"), F.col("span.end").alias("until"), *COHORT,
             "requests", "succeeded", "reported_output_tokens", "duration_ms")


def attempt_completion(obs: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Starts with their end; a start whose end does not come within ``wait`` stays incomplete."""
    begun = obs.filter(F.col("kind") == "request_started").select(
        F.col("source.id").alias("source_id"), F.col("identity.attempt_id").alias("attempt_id"),
        F.col("observed_at").alias("started_at"),
    ).withWatermark("started_at", late)
    ended = obs.filter(F.col("kind") == "request_finished").select(
        F.col("source.id").alias("end_source"), F.col("identity.attempt_id").alias("end_attempt"),
        F.col("observed_at").alias("finished_at"), F.col("request_finished.outcome").alias("outcome"),
    ).withWatermark("finished_at", late)
    meets = F.expr(
        "source_id = end_source AND attempt_id = end_attempt AND finished_at >= started_at "
        f"AND finished_at <= started_at + interval {wait}"
    )
    return begun.join(ended, meets, "left_outer").select(
        "source_id", "attempt_id", "started_at", "finished_at", "outcome",
        F.col("finished_at").isNull().alias("incomplete"),
    )


def monitor_buckets(samples: DataFrame, size: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Samples per interval and provider: sessions measured, greatest context, states."""
    if late is not None:
        samples = samples.withWatermark("observed_at", late)
    return samples.groupBy(F.window("observed_at", size).alias("span"), "provider").agg(
        F.count("*").alias("samples"),
        F.count("context_tokens").alias("measured"),
        F.max("context_tokens").alias("max_context"),
    ).select(F.col("span.start").alias("from"), "provider", "samples", "measured", "max_context")


def watch_decision(now_ts: str = "now_ts") -> Column:
    """What a watch pass does with a session; the first rule that applies.

    Reads fingerprint, settled_fingerprint, hold_until, last_apply, last_fire,
    reported_context, effective_trigger, apply_hold_secs, min_interval_secs.
    """
    now = F.col(now_ts)
    return (
        F.when(F.col("fingerprint") == F.col("settled_fingerprint"), "settled")
        .when(now < F.col("hold_until"), "cooldown")
        .when(now - F.col("last_apply") < F.col("apply_hold_secs"), "cooldown")
        .when(F.col("reported_context") < F.col("effective_trigger"), "below_trigger")
        .when(now - F.col("last_fire") < F.col("min_interval_secs"), "cooldown")
        .otherwise("evaluate")
    )


def watch_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("sessions"))


class Advisories:
    """Stateful throttle: repeat an advisory only after time or growth.

    One small state per session: when and at what context it was last shown.
    """

    SCHEMA = "provider string, session_id string, observed_at_ms long, context_tokens long, shown boolean"
    STATE = "shown_ms long, shown_tokens long"

    @staticmethod
    def rule(now_ms: int, tokens: int, shown_ms: int | None, shown_tokens: int | None) -> bool:
        if shown_ms is None:
            return True
        recent = now_ms - shown_ms < SHOW_AGAIN_SECS * 1000
        return not (recent and tokens - shown_tokens < GROWTH_TOKENS)


def throttle_advisories(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Over-trigger prompts with ``shown``.  A session's state ends a day after its last prompt.

    ``stream``: provider, session_id, observed_at_ms, context_tokens.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["observed_at_ms", "context_tokens"], kind="stable")
        shown = []
        for ms, tokens in zip(rows["observed_at_ms"], rows["context_tokens"]):
            show = Advisories.rule(int(ms), int(tokens), *last)
            if show:
                last = (int(ms), int(tokens))
            shown.append(show)
        state.update(last)
        ends = int(rows["observed_at_ms"].max()) + 86_400_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(shown=shown)[["provider", "session_id", "observed_at_ms", "context_tokens", "shown"]]

    timed = stream.withColumn("observed_at", F.timestamp_millis("observed_at_ms")).withWatermark("observed_at", late)
    return timed.groupBy("provider", "session_id").applyInPandasWithState(
        step, Advisories.SCHEMA, Advisories.STATE, "append", GroupStateTimeout.EventTimeTimeout
    )

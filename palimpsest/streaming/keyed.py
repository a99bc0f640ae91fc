"""Keyed streams that keep a little state per session and see its rows in order, whatever order they arrive in.

A row waits in its session's list state until the watermark has passed its time; an event-time timer then hands over all rows
that are due, sorted by time and sequence. Within the watermark's delay, shuffled arrival therefore gives
the rows and states of the ordered log; what comes later than that is dropped, as in every windowed stream. State and waiting rows are
checkpointed, so a restart in the middle of a stream changes nothing. A day after a session's last row its state goes. Timers run on event
time, not on the clock: a replay of an old log and the live stream decide alike.

The batch forms, ``watch_passes`` and ``monitor.monitor_deltas``, compute the same columns over a table, with no window over a whole session.

The streams need the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.ordered import last_known
from palimpsest.streaming.jobs import watch_decision

DAY_SECS = 86_400
KEYS = ["provider", "session_id"]


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows of a key in order of (at_ms, seq); a subclass says what a row does to the state.

    ``rows``: the schema of waiting rows, with at_ms and seq; ``state``: the schema of the state, one row.
    What a session receives at once waits as one entry, a JSON list of rows: each entry of a list state is a message of its own to the state server.
    """

    rows: T.StructType
    state: T.StructType
    out: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed string")
        self.last = handle.getValueState("last", self.state)
        self.until = handle.getValueState("until", "at_ms long")

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> dict[str, Any] | None:
        """Change ``state`` in place; a row to give out, or None."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        values = [[r[n] for n in self.rows.names] for r in rows]
        if values:
            self.waiting.appendValue((json.dumps(values),))
            at = self.rows.names.index("at_ms")
            self.handle.registerTimer(min(v[at] for v in values) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        names = self.rows.names
        held = [dict(zip(names, r, strict=True)) for (packed,) in self.waiting.get() for r in json.loads(packed)]
        due = sorted((r for r in held if r["at_ms"] < now), key=lambda r: (r["at_ms"], r["seq"]))
        if due:
            left = [r for r in held if r["at_ms"] >= now]
            if left:
                self.waiting.put([(json.dumps([[r[n] for n in names] for r in left]),)])
                self.handle.registerTimer(min(r["at_ms"] for r in left) + 1)
            else:
                self.waiting.clear()
            found = self.last.get() or [None] * len(self.state.names)
            state = dict(zip(self.state.names, found, strict=True))
            given = [g for r in due if (g := self.step(state, r)) is not None]
            self.last.update(tuple(state[n] for n in self.state.names))
            end = due[-1]["at_ms"] + (DAY_SECS + 1) * 1000
            self.until.update((end,))
            self.handle.registerTimer(end + 1)
            keys = dict(zip(KEYS, key, strict=True))
            made = Row(*self.out.names)
            yield from (made(*[(keys | g)[n] for n in self.out.names]) for g in given)
        elif not held and self.until.exists() and self.until.get()[0] < now:
            self.forget()

    def forget(self) -> None:
        """A day has passed since the last row."""
        self.last.clear()
        self.until.clear()

    def close(self) -> None:
        pass


def _run(stream: DataFrame, processor: InOrder, late: str) -> DataFrame:
    timed = stream.select(*KEYS, *processor.rows.names, F.timestamp_millis("at_ms").alias("observed_at")).withWatermark("observed_at", late)
    return timed.groupBy(*KEYS).transformWithState(
        statefulProcessor=processor, outputStructType=processor.out, outputMode="Append", timeMode="EventTime"
    )


# Watch decisions

#: A log row is a pass over a session, or one of these outcomes, which later passes heed.
OUTCOMES = ["settled", "held", "applied", "fired"]
_PASS = ["fingerprint", "reported_context", "effective_trigger", "apply_hold_secs", "min_interval_secs"]


def watch_passes(log: DataFrame, levels: list[Column], keys: list[str] = KEYS) -> DataFrame:
    """Each pass of a watch log with its ``decision``.

    ``log``: keys, at_ms, seq, kind ("pass" or one of OUTCOMES), fingerprint (of a pass; of a settled outcome), until_secs (of a held
    one) and the pass's reported_context, effective_trigger, apply_hold_secs and min_interval_secs. Outcomes older than a day do not count.
    ``levels``: block and place of a row in its session.
    """
    at = F.floor(F.col("at_ms") / 1000).cast("long")
    value = {"settled": F.col("fingerprint"), "held": F.col("until_secs").cast("string"), "applied": F.lit(""), "fired": F.lit("")}
    known = last_known(
        log, keys, levels, {k: F.when(F.col("kind") == k, F.struct(at.alias("at"), v.alias("v"))) for k, v in value.items()}
    ).filter(F.col("kind") == "pass").withColumn("now_ts", at)

    def fresh(name: str, field: str) -> Column:
        return F.when(F.col("now_ts") - F.col(f"{name}.at") <= DAY_SECS, F.col(f"{name}.{field}"))

    known = known.withColumns({
        "settled_fingerprint": fresh("settled", "v"), "hold_until": fresh("held", "v").cast("long"),
        "last_apply": fresh("applied", "at"), "last_fire": fresh("fired", "at"),
    })
    return known.select(*keys, "at_ms", "seq", watch_decision().alias("decision"))


def decide(state: dict[str, Any], row: dict[str, Any]) -> str:
    """The rules of ``watch_decision`` for one pass; the first that applies. Unknown values apply no rule."""
    now = row["at_ms"] // 1000

    def fresh(name: str, field: str):
        at = state[f"{name}_at"]
        return None if at is None or now - at > DAY_SECS else state[field]

    settled, hold, applied, fired = fresh("settled", "fingerprint"), fresh("held", "until_secs"), fresh("applied", "applied_at"), fresh("fired", "fired_at")
    if settled is not None and row["fingerprint"] == settled:
        return "settled"
    if hold is not None and now < hold:
        return "cooldown"
    if applied is not None and row["apply_hold_secs"] is not None and now - applied < row["apply_hold_secs"]:
        return "cooldown"
    if row["reported_context"] is not None and row["effective_trigger"] is not None and row["reported_context"] < row["effective_trigger"]:
        return "below_trigger"
    if fired is not None and row["min_interval_secs"] is not None and now - fired < row["min_interval_secs"]:
        return "cooldown"
    return "evaluate"


class WatchProcessor(InOrder):
    rows = T.StructType(
        [T.StructField("at_ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("fingerprint", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("until_secs", *_PASS[1:])]
    )
    state = T.StructType(
        [T.StructField("fingerprint", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("settled_at", "until_secs", "held_at", "applied_at", "fired_at")]
    )
    out = T.StructType([
        T.StructField("provider", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("at_ms", T.LongType()),
        T.StructField("seq", T.LongType()), T.StructField("decision", T.StringType()),
    ])

    def step(self, state, row):
        if row["kind"] == "pass":
            return {"at_ms": row["at_ms"], "seq": row["seq"], "decision": decide(state, row)}
        if row["kind"] in OUTCOMES:
            state[f"{row['kind']}_at"] = row["at_ms"] // 1000
            if row["kind"] == "settled":
                state["fingerprint"] = row["fingerprint"]
            elif row["kind"] == "held":
                state["until_secs"] = row["until_secs"]
        return None


def watch_stream(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The passes of a streamed watch log with their decisions, as ``watch_passes`` gives them for the whole log."""
    return _run(log, WatchProcessor(), late)


# Monitor series


class MonitorProcessor(InOrder):
    rows = T.StructType([
        T.StructField("at_ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("source_identity_sha256", T.StringType()),
        T.StructField("context_state", T.StringType()), T.StructField("context_tokens", T.LongType()), T.StructField("native_applied", T.LongType()),
    ])
    state = T.StructType(rows.fields[2:])
    out = T.StructType([
        T.StructField("provider", T.StringType()), T.StructField("session_id", T.StringType()), *rows.fields,
        T.StructField("context_drop_tokens", T.LongType()), T.StructField("native_applied_delta", T.LongType()), T.StructField("native_counter_reset", T.BooleanType()),
    ])

    def step(self, state, row):
        source, context, count = state["source_identity_sha256"], state["context_tokens"], state["native_applied"]
        same = source is not None and source == row["source_identity_sha256"]
        drop = delta = reset = None
        if same and state["context_state"] == "reported" and (context or 0) > 0 and (row["context_tokens"] or 0) > 0:
            drop = max(context - row["context_tokens"], 0)
        if same and count is not None and row["native_applied"] is not None:
            reset = row["native_applied"] < count
            delta = None if reset else row["native_applied"] - count
        for n in self.state.names:
            state[n] = row[n]
        return row | {"context_drop_tokens": drop, "native_applied_delta": delta, "native_counter_reset": reset}


def monitor_stream(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Samples with their change against the session's sample before, as ``monitor.monitor_deltas`` gives them for a table."""
    return _run(samples, MonitorProcessor(), late)


def monitor_series(deltas: DataFrame, size: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Per interval and provider: samples, how many measure their context, greatest context, what was dropped and counted, resets.

    ``deltas``: rows of ``monitor_stream`` or ``monitor.monitor_deltas`` with at_ms; a table, or a stream read from where those rows were written.
    """
    rows = deltas.withColumn("observed_at", F.timestamp_millis("at_ms"))
    if late is not None:
        rows = rows.withWatermark("observed_at", late)
    return rows.groupBy(F.window("observed_at", size).alias("span"), "provider").agg(
        F.count("*").alias("samples"), F.count("context_tokens").alias("measured"), F.max("context_tokens").alias("max_context"),
        F.sum("context_drop_tokens").alias("context_drop_tokens"), F.sum("native_applied_delta").alias("native_applied"),
        F.count_if(F.coalesce("native_counter_reset", F.lit(False))).alias("resets"), F.count("native_counter_reset").alias("compared"),
    ).select(F.col("span.start").alias("from"), "provider", "samples", "measured", "max_context", "context_drop_tokens", "native_applied", "resets", "compared")

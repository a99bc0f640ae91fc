"""Request and tool observations: validation, lenses and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.stats import coverage
from palimpsest.functions.text import opaque_shape, safe_label

COUNTERS = [
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens",
]
IDS = ["runtime_id", "session_id", "request_id", "attempt_id", "tool_id"]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _all(*conditions: Column) -> Column:
    """All conditions hold.  Least-of keeps long rules out of boolean normalization."""
    return F.least(F.lit(True), *[_true(c) for c in conditions])


def outcome_of(reason: str | Column) -> Column:
    """Outcome a finish reason stands for."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    table = F.create_map(*[F.lit(x) for pair in fixed.FINISH_OUTCOME.items() for x in pair])
    return F.when(reason.isNotNull(), F.try_element_at(table, reason))


def usage_valid(usage: Column) -> Column:
    """Counters within bounds, and every part within its whole when both have one basis."""
    def value(n: str) -> Column:
        return usage[n]["value"]

    def basis(n: str) -> Column:
        return usage[n]["basis"]

    def within(part: str, whole: str) -> Column:
        comparable = basis(part) == basis(whole)
        return ~_true(comparable & (value(part) > value(whole)))

    bounded = [~_true((value(n) > fixed.MAX_COUNTER) | (value(n) < 0)) for n in COUNTERS]
    read, write, whole = "cache_read_tokens", "cache_write_tokens", "input_tokens"
    both = (basis(whole) == basis(read)) & (basis(whole) == basis(write))
    return _all(
        *bounded,
        within("reasoning_tokens", "output_tokens"),
        within(read, whole),
        within(write, whole),
        ~_true(both & (value(read) + value(write) > value(whole))),
    )


def observation_problem() -> Column:
    """Why an observation is refused; NULL when it is valid."""
    ident, source, kind = F.col("identity"), F.col("source"), F.col("kind")
    started, finished = F.col("request_started"), F.col("request_finished")
    decision, tool, legacy = F.col("context_decision"), F.col("tool_observed"), F.col("legacy_context")
    bad_identity = ~_all(
        opaque_shape(F.col("event_id")),
        opaque_shape(source["id"]),
        source["profile"].isin(fixed.PROFILES),
        source["kind"].isin(fixed.SOURCE_KINDS),
        F.col("observed_at_ms").between(0, fixed.MAX_OBSERVED_MS),
        *[ident[i].isNull() | opaque_shape(ident[i]) for i in IDS],
    )
    request = ident["request_id"].isNotNull() & ident["attempt_id"].isNotNull()

    def count(c: Column) -> Column:
        return c.between(0, fixed.MAX_COUNTER)

    ok_started = _all(
        request,
        started["provider"].isin(fixed.REQUEST_PROVIDERS),
        started["model"].isNull() | safe_label(started["model"]),
    )
    f = finished
    gen, timing = f["generation"], f["timings"]
    ok_finished = _all(
        request,
        f["outcome"].isin(fixed.OUTCOMES),
        f["reason"].isNull()
        | (
            (outcome_of(f["reason"]) == f["outcome"])
            & ((f["reason"] != "completed") | F.coalesce(f["http_status"] < 400, F.lit(True)))
        ),
        f["http_status"].isNull() | f["http_status"].between(100, 599),
        f["duration_ms"].isNull() | f["duration_ms"].between(0, fixed.MAX_DURATION_MS),
        f["first_output_ms"].isNull() | _true(f["first_output_ms"] <= f["duration_ms"]),
        timing.isNull()
        | (
            _true(timing["preparation_ms"] + timing["upstream_headers_ms"] <= f["duration_ms"])
            & F.coalesce(timing["transform_ms"] <= timing["preparation_ms"], F.lit(True))
        ),
        f["usage"].isNull() | usage_valid(f["usage"]),
        gen.isNull()
        | _all(
            count(gen["output_tokens"]),
            gen["duration_ms"] > 0,
            gen["duration_ms"] <= f["duration_ms"],
            f["usage"]["output_tokens"]["basis"] == "reported",
            gen["output_tokens"] <= f["usage"]["output_tokens"]["value"],
        ),
    )
    ok_decision = _all(
        request,
        count(decision["estimated_before_tokens"]),
        count(decision["estimated_after_tokens"]),
        count(decision["threshold_tokens"]),
    )
    ok_tool = _all(
        ident["tool_id"].isNotNull(),
        ident["session_id"].isNotNull() | request,
        tool["tool_name"].isNull() | safe_label(tool["tool_name"]),
        tool["stage"].isin("requested", "dispatched", "terminal"),
        (tool["stage"] == "terminal") | (tool["outcome"] == "unknown"),
    )
    ok_legacy = _all(
        source["kind"] == "legacy_stats",
        count(legacy["estimated_before_tokens"]),
        count(legacy["estimated_after_tokens"]),
        *[ident[i].isNull() for i in IDS],
    )
    ok = (
        F.when(kind == "request_started", ok_started)
        .when(kind == "request_finished", ok_finished)
        .when(kind == "context_decision", ok_decision)
        .when(kind == "tool_observed", ok_tool)
        .when(kind == "legacy_context", ok_legacy)
        .otherwise(False)
    )
    return (
        F.when(~_true(F.col("schema_version") == 1), "data_event_version_unsupported")
        .when(bad_identity, "data_invalid_identity")
        .when(~ok, "data_invalid_observation")
        .when(F.octet_length(envelope()) > 16 * 1024, "data_event_limit")
    )


def validate_observations(obs: DataFrame) -> DataFrame:
    return obs.withColumn("problem", observation_problem())


def lifecycle_key() -> Column:
    """Key that may occur once: one start and one end per attempt, one row per tool stage."""
    ident, source, kind = F.col("identity"), F.col("source.id"), F.col("kind")
    stage = F.initcap(F.col("tool_observed.stage"))
    return F.when(
        kind.isin("request_started", "request_finished"),
        F.when(
            ident["attempt_id"].isNotNull(), F.concat_ws(":", source, ident["attempt_id"], kind)
        ),
    ).when(
        kind == "tool_observed",
        F.when(
            ident["tool_id"].isNotNull(),
            F.concat_ws(":", source, F.coalesce(ident["session_id"], F.lit("")), ident["tool_id"], stage),
        ),
    )


ENVELOPE = [
    "schema_version", "event_id", "source", "observed_at_ms", "identity", "kind", "request_started",
    "request_finished", "context_decision", "tool_observed", "legacy_context",
]


def envelope() -> Column:
    """The observation as canonical JSON: fixed field order, absent fields left out."""
    return F.to_json(F.struct(*ENVELOPE))


def select(
    obs: DataFrame, since_ms: int | None = None, until_ms: int | None = None, session_id: str | None = None
) -> DataFrame:
    """Observations from ``since_ms`` (inclusive) until ``until_ms`` (exclusive) of a session."""
    if since_ms is not None:
        obs = obs.filter(F.col("observed_at_ms") >= since_ms)
    if until_ms is not None:
        obs = obs.filter(F.col("observed_at_ms") < until_ms)
    if session_id is not None:
        obs = obs.filter(F.col("identity.session_id") == session_id)
    return obs


def requests(obs: DataFrame) -> DataFrame:
    """One row per source and attempt; incomplete where no end was observed.

    Start and end meet in one aggregate, so no join is needed.
    """
    order = F.struct("observed_at_ms", "event_id")
    begun = F.when(F.col("kind") == "request_started", order)
    ended = F.when(F.col("kind") == "request_finished", order)
    rows = obs.filter(
        F.col("kind").isin("request_started", "request_finished")
        & F.col("identity.attempt_id").isNotNull()
    )
    grouped = rows.groupBy(
        F.col("source.id").alias("source_id"), F.col("identity.attempt_id").alias("attempt_id")
    ).agg(
        F.min_by(F.struct("source", "identity"), order).alias("_first"),
        F.max_by(F.struct("observed_at_ms", "request_started"), begun).alias("_begun"),
        F.max_by(F.struct("observed_at_ms", "request_finished"), ended).alias("_ended"),
    )
    end = F.col("_ended.request_finished")
    return grouped.select(
        "source_id",
        "attempt_id",
        F.col("_first.source.kind").alias("source_kind"),
        F.col("_first.source.profile").alias("source_profile"),
        F.col("_first.identity.session_id").alias("session_id"),
        F.col("_first.identity.request_id").alias("request_id"),
        F.col("_begun.observed_at_ms").alias("started_at_ms"),
        F.col("_ended.observed_at_ms").alias("finished_at_ms"),
        F.col("_begun.request_started.provider").alias("provider"),
        F.col("_begun.request_started.model").alias("model"),
        *[
            end[n].alias(n)
            for n in (
                "outcome", "duration_ms", "first_output_ms", "usage", "generation", "reason", "timings",
            )
        ],
        F.col("_ended").isNull().alias("incomplete"),
    )


def sessions(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per source and session, and the number of attempts without a session.

    Tool ids are made distinct by their own aggregate, so a busy session spreads.
    """
    key = [F.col("source.id").alias("source_id"), F.col("identity.session_id").alias("session_id")]
    named = ["source_id", "session_id"]
    seen = obs.filter(F.col("identity.session_id").isNotNull())
    extent = seen.groupBy(*key).agg(
        F.min("observed_at_ms").alias("first_observed_ms"),
        F.max("observed_at_ms").alias("last_observed_ms"),
        F.count_if(F.col("kind") == "context_decision").alias("context_decisions"),
    )
    tool_ids = (
        seen.filter(F.col("identity.tool_id").isNotNull())
        .select(*key, F.col("identity.tool_id").alias("tool_id"))
        .distinct()
        .groupBy(*named)
        .agg(F.count("*").alias("tool_invocations"))
    )
    attempts = requests(obs)
    per_session = attempts.filter(F.col("session_id").isNotNull()).groupBy(*named).agg(
        F.count("*").alias("request_attempts"),
        F.count_if("incomplete").alias("incomplete_attempts"),
    )
    rows = extent.join(per_session, named, "left").join(tool_ids, named, "left").select(
        *named,
        "first_observed_ms",
        "last_observed_ms",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("request_attempts", "incomplete_attempts", "tool_invocations")
        ],
        "context_decisions",
    )
    unassigned = attempts.groupBy().agg(
        F.count_if(F.col("session_id").isNull()).alias("attempts_without_session")
    )
    return rows, unassigned


def tools(obs: DataFrame) -> DataFrame:
    """One row per source and tool call: stages reached, outcome and first name seen."""
    order = F.struct("observed_at_ms", "event_id")
    stage = F.col("tool_observed.stage")
    name = F.col("tool_observed.tool_name")
    rows = obs.filter((F.col("kind") == "tool_observed") & F.col("identity.tool_id").isNotNull())
    return (
        rows.groupBy(F.col("source.id").alias("source_id"), F.col("identity.tool_id").alias("tool_id"))
        .agg(
            F.min_by("identity", order).alias("_identity"),
            F.min_by(name, F.when(name.isNotNull(), order)).alias("name"),
            F.bool_or(stage == "requested").alias("requested"),
            F.bool_or(stage == "dispatched").alias("dispatched"),
            F.bool_or(stage == "terminal").alias("terminal"),
            F.max_by("tool_observed.outcome", F.when(stage == "terminal", order)).alias("outcome"),
        )
        .select(
            "source_id",
            "tool_id",
            F.col("_identity.session_id").alias("session_id"),
            F.col("_identity.request_id").alias("request_id"),
            F.col("_identity.attempt_id").alias("attempt_id"),
            "name", "requested", "dispatched", "terminal", "outcome",
        )
    )


COHORT = ["source_kind", "source_profile"]
BIG = "decimal(38,0)"


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast(BIG)), F.lit(0).cast(BIG))


def request_totals(attempts: DataFrame, by: list[str] = COHORT) -> DataFrame:
    """Every sum and count the measures need, in one aggregate over attempts."""
    use = F.col("usage")

    def counter(n: str, basis: str) -> Column:
        return F.when(use[n]["basis"] == basis, use[n]["value"])

    reported_in, reported_out = counter("input_tokens", "reported"), counter("output_tokens", "reported")
    span = F.col("generation")
    spanned = span["duration_ms"] > 0
    timed = reported_out.isNotNull() & (F.col("duration_ms") > 0)
    values = {
        "duration": F.col("duration_ms"),
        "first_output": F.col("first_output_ms"),
        "reported_input": reported_in,
        "reported_output": reported_out,
        "preparation": F.col("timings")["preparation_ms"],
        "upstream_headers": F.col("timings")["upstream_headers_ms"],
        "transform": F.col("timings")["transform_ms"],
        "generation_tokens": F.when(spanned, span["output_tokens"]),
        "generation_ms": F.when(spanned, span["duration_ms"]),
        "rate_tokens": F.when(timed, reported_out),
        "rate_ms": F.when(timed, F.col("duration_ms")),
    }
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count_if("incomplete").alias("incomplete_attempts"),
        F.count_if(F.coalesce(F.col("outcome") == "unknown", F.lit(True))).alias("unknown_outcomes"),
        _sum(reported_in).alias("reported_input_tokens"),
        _sum(reported_out).alias("reported_output_tokens"),
        _sum(counter("input_tokens", "estimated")).alias("estimated_input_tokens"),
        _sum(counter("output_tokens", "estimated")).alias("estimated_output_tokens"),
        F.count(use["input_tokens"]).alias("requests_with_input"),
        F.count(use["output_tokens"]).alias("requests_with_output"),
        F.count("outcome").alias("_outcomes"),
        F.count("reason").alias("_reasons"),
        *[F.count_if(F.col("outcome") == o).alias(f"_outcome_{o}") for o in fixed.OUTCOMES],
        *[F.count_if(F.col("reason") == r).alias(f"_reason_{r}") for r in fixed.FINISH_OUTCOME],
        *[_sum(v).alias(f"_sum_{n}") for n, v in values.items()],
        *[F.count(v).alias(f"_count_{n}") for n, v in values.items()],
    )


def _measure(name: str, unit: str, top: Column, bottom: Column, measured: Column, missing: Column,
             reason: str, factor: float = 1.0) -> Column:
    value = F.when(bottom > 0, top.cast("double") * factor / bottom.cast("double"))
    return F.struct(
        F.lit(name).alias("id"),
        F.lit(unit).alias("unit"),
        value.alias("value"),
        top.cast(BIG).cast("string").alias("numerator"),
        bottom.cast(BIG).cast("string").alias("denominator"),
        measured.cast("long").alias("measured"),
        missing.cast("long").alias("missing"),
        coverage(measured, missing).alias("status"),
        F.when(measured == 0, reason).alias("unavailable_reason"),
    )


def measures() -> list[Column]:
    """The 28 measures over :func:`request_totals` columns."""
    attempts = F.col("attempts")

    def mean(name: str, column: str, unit: str) -> Column:
        n = F.col(f"_count_{column}")
        return _measure(name, unit, F.col(f"_sum_{column}"), n, n, attempts - n,
                        "no_measured_observations")

    def rate(name: str, column: str, reason: str) -> Column:
        n = F.col(f"_count_{column}_tokens")
        return _measure(name, "tokens/s", F.col(f"_sum_{column}_tokens"), F.col(f"_sum_{column}_ms"),
                        n, attempts - n, reason, 1000.0)

    def fraction(name: str, count: str, total: str, reason: str) -> Column:
        n = F.col(total)
        return _measure(name, "fraction", F.col(count), n, n, attempts - n, reason)

    return [
        mean("request_duration_mean", "duration", "ms"),
        mean("first_output_latency_mean", "first_output", "ms"),
        mean("reported_input_tokens_mean", "reported_input", "tokens"),
        mean("reported_output_tokens_mean", "reported_output", "tokens"),
        rate("generation_output_tokens_per_second", "generation", "no_matching_generation_spans"),
        rate("request_output_tokens_per_second", "rate", "no_matching_request_tokens_and_durations"),
        mean("request_preparation_mean", "preparation", "ms"),
        mean("upstream_headers_latency_mean", "upstream_headers", "ms"),
        mean("request_transform_mean", "transform", "ms"),
        *[
            fraction(f"request_outcome_{o}_fraction", f"_outcome_{o}", "_outcomes",
                     "no_observed_request_outcomes")
            for o in fixed.OUTCOMES
        ],
        *[
            fraction(f"request_finish_{r}_fraction", f"_reason_{r}", "_reasons",
                     "no_observed_finish_reasons")
            for r in fixed.FINISH_OUTCOME
        ],
    ]


def metrics(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals per cohort (source kind and profile), and the measures in long form."""
    decision = F.col("context_decision")
    compacted = (F.col("kind") == "context_decision") & decision["compacted"]
    freed = F.greatest(
        decision["estimated_before_tokens"] - decision["estimated_after_tokens"], F.lit(0)
    )
    other = (
        obs.filter(~F.col("kind").isin("request_started", "request_finished"))
        .groupBy(F.col("source.kind").alias("source_kind"), F.col("source.profile").alias("source_profile"))
        .agg(
            F.count_if(compacted & ~decision["shadow"]).alias("applied_compactions"),
            F.count_if(compacted & decision["shadow"]).alias("shadow_compactions"),
            F.count_if(F.col("kind") == "legacy_context").alias("legacy_observations"),
            _sum(F.when(compacted & ~decision["shadow"], freed)).alias(
                "context_tokens_removed_estimate"
            ),
        )
    )
    both = request_totals(requests(obs)).join(other, COHORT, "full_outer")
    counted = {
        c: F.coalesce(c, F.lit(0)) for c in both.columns if c not in COHORT
    }
    full = both.withColumns(counted)
    totals = full.select(
        *COHORT, "attempts", "incomplete_attempts", "unknown_outcomes",
        *[F.col(c).cast(BIG).cast("string").alias(c) for c in (
            "reported_input_tokens", "reported_output_tokens", "estimated_input_tokens",
            "estimated_output_tokens", "context_tokens_removed_estimate")],
        "requests_with_input", "requests_with_output", "applied_compactions",
        "shadow_compactions", "legacy_observations",
    )
    long = full.select(*COHORT, F.explode(F.array(*measures())).alias("m")).select(*COHORT, "m.*")
    return totals, long


def event_page(
    obs: DataFrame, after: int, through: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Observations after a sequence up to a snapshot, and whether the page is complete."""
    window = obs.filter((F.col("sequence") > after) & (F.col("sequence") <= through))
    ahead = window.orderBy("sequence").limit(limit + 1)
    page = ahead.orderBy("sequence").limit(limit)
    state = ahead.groupBy().agg(F.count("*").alias("_n")).select(
        (F.col("_n") <= limit).alias("complete"), F.least("_n", F.lit(limit)).alias("rows")
    )
    return page, state


def incomplete_attempts(obs: DataFrame) -> DataFrame:
    """Starts without an end."""
    key = ["source_id", "attempt_id"]
    cols = [F.col("source.id").alias("source_id"), F.col("identity.attempt_id").alias("attempt_id")]
    begun = obs.filter(F.col("kind") == "request_started").select(*cols, "observed_at_ms")
    ended = obs.filter(F.col("kind") == "request_finished").select(*cols)
    return begun.join(ended, key, "left_anti")


def status(obs: DataFrame) -> DataFrame:
    """Counts of events and of attempts without an end, in one aggregate."""
    per_attempt = obs.groupBy(
        F.col("source.id").alias("source_id"), F.col("identity.attempt_id").alias("attempt_id")
    ).agg(
        F.count("*").alias("_events"),
        F.count_if(F.col("kind") == "request_started").alias("_started"),
        F.bool_or(F.col("kind") == "request_finished").alias("_finished"),
    )
    return per_attempt.groupBy().agg(
        F.sum("_events").alias("events"),
        F.sum(F.when(~F.col("_finished"), F.col("_started")).otherwise(0)).alias("incomplete_attempts"),
    )


def with_digest(obs: DataFrame) -> DataFrame:
    """Observations with their canonical body and its digest, as stored."""
    return obs.withColumn("envelope", envelope()).withColumn("digest", F.sha2("envelope", 256))


def check(stored: DataFrame) -> DataFrame:
    """Stored rows whose digest is not that of their body."""
    return stored.filter(F.sha2("envelope", 256) != F.col("digest"))

"""Evidence: which recorded reductions and retentions are qualified, and their aggregates."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.hashes import is_sha256

PAIR = [
    "provider", "session_id", "source_identity_sha256", "snapshot_before_sha256",
    "snapshot_after_sha256",
]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _all(*conditions: Column) -> Column:
    """All conditions hold.  Least-of keeps long rules out of boolean normalization."""
    return F.least(F.lit(True), *[_true(c) for c in conditions])


def _hash_or_null(c: Column) -> Column:
    return c.isNull() | is_sha256(c)


def valid_observation(name: str) -> Column:
    """A token observation that may serve as evidence."""
    o = F.col(name)
    full = o["lifetime_scope"] == "full"
    tokens, cached = o["lifetime_input_tokens"], o["lifetime_cached_tokens"]
    return _all(
        is_sha256(o["source_sha256"]),
        is_sha256(o["source_identity_sha256"]),
        _hash_or_null(o["snapshot_manifest_sha256"]),
        o["context_state"].isin("absent", "unknown", "reported", "reset"),
        o["lifetime_scope"].isin("absent", "partial", "full"),
        o["estimated_context_tokens"] >= 0,
        (o["context_state"] == "reported") == o["context_tokens"].isNotNull(),
        F.when(full, cached <= tokens).otherwise(tokens.isNull() & cached.isNull()),
    )


def valid_event(schema_name: str = fixed.EVENT_SCHEMA, prefix: str = "") -> Column:
    """An event with allowed vocabularies, hashes, counts and derived fields."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    cohort, percent = c("decision_cohort"), c("rollout_percent")
    total, literal, lexical = c("retention_total"), c("retention_retained"), c("retention_lexical")
    no_retention = total.isNull() & literal.isNull() & lexical.isNull()
    required = [
        c(n).isNotNull() & (c(n) >= 0)
        for n in (
            "ts", "trigger_tokens", "context_tokens_before", "context_tokens_after",
            "est_reclaimed_tokens", "items_covered", "duration_ms",
        )
    ]
    return _all(
        c("schema") == schema_name,
        c("provider").isin(fixed.BRANCH, fixed.WINDOW),
        *required,
        *[
            _hash_or_null(c(n))
            for n in (
                "source_identity_sha256", "binary_sha256", "config_sha256", "experiment_sha256",
                "snapshot_before_sha256", "snapshot_after_sha256",
            )
        ],
        F.when(cohort.isNull() | (cohort == "ungated"), percent.isNull())
        .when(cohort.isin("treatment", "control"), percent.between(0, 100))
        .otherwise(False),
        c("before_observation").isNull() | valid_observation(prefix + "before_observation"),
        c("after_observation").isNull() | valid_observation(prefix + "after_observation"),
        no_retention | ((literal <= total) & (lexical <= total) & (literal >= 0) & (lexical >= 0)),
        c("session_id").rlike(r"^[A-Za-z0-9._-]{1,256}$"),
        c("strategy").rlike(r"^[A-Za-z0-9._:-]{1,128}$"),
        c("action").isin(fixed.EVENT_ACTIONS),
        c("outcome").isin(fixed.EVENT_OUTCOMES),
        c("error_code").isNull() | c("error_code").isin(fixed.EVENT_ERROR_CODES),
        c("est_reclaimed_tokens")
        == F.greatest(c("context_tokens_before") - c("context_tokens_after"), F.lit(0)),
    )


def _bound_pair() -> Column:
    """Applied without error, both observations valid and bound to one source and its snapshots."""
    before, after = F.col("before_observation"), F.col("after_observation")
    return _all(
        F.col("outcome") == "applied",
        F.col("error_code").isNull(),
        F.col("action").isin("provider_compact", "transcript_compact"),
        valid_observation("before_observation"),
        valid_observation("after_observation"),
        before["source_identity_sha256"] == after["source_identity_sha256"],
        F.col("source_identity_sha256") == before["source_identity_sha256"],
        before["snapshot_manifest_sha256"] == F.col("snapshot_before_sha256"),
        after["snapshot_manifest_sha256"] == F.col("snapshot_after_sha256"),
    )


def context_reduction() -> Column:
    """Tokens between two positive provider reports of one source; NULL when not qualified."""
    before = F.col("before_observation")["context_tokens"]
    after = F.col("after_observation")["context_tokens"]
    return F.when(
        _bound_pair() & _true((before > 0) & (after > 0)), F.greatest(before - after, F.lit(0))
    )


class Evidence(NamedTuple):
    reductions: DataFrame  # one row per agreed pair: PAIR, first_index, before_tokens, reduction_tokens
    counts: DataFrame  # conflicting_pairs, duplicate_records, unqualified_records


def qualified_reductions(
    events: DataFrame, order: str = "log_order", schema_name: str = fixed.EVENT_SCHEMA
) -> Evidence:
    """Evidence pairs on which every record agrees.

    One disagreeing or unqualified record of a pair makes it a conflict.  The aggregate
    does not depend on the order of records; ``first_index`` is the pair's earliest one.
    """
    applied = events.filter(F.col("outcome") == "applied")
    keyed = _all(*[is_sha256(F.col(c)) for c in PAIR[2:]])
    claim = F.struct(
        "before_observation", "after_observation", "decision_cohort", "rollout_percent",
        "experiment_sha256", "binary_sha256", "config_sha256",
    )
    qualified = context_reduction().isNotNull() & valid_event(schema_name)
    marked = applied.withColumns(
        {"_keyed": keyed, "_ok": keyed & qualified, "_claim": F.sha2(F.to_json(claim), 256)}
    )
    pairs = marked.filter("_keyed").groupBy(*PAIR).agg(
        F.min(order).alias("first_index"),
        F.count("*").alias("records"),
        F.bool_and("_ok").alias("_all_ok"),
        # All claims equal exactly when the least and the greatest are.
        F.min("_claim").alias("_least"),
        F.max("_claim").alias("_most"),
        F.min_by(F.col("before_observation")["context_tokens"], order).alias("before_tokens"),
        F.min_by(context_reduction(), order).alias("reduction_tokens"),
    )
    pairs = pairs.withColumn("agreed", F.col("_all_ok") & _true(F.col("_least") == F.col("_most")))
    reductions = pairs.filter("agreed").select(*PAIR, "first_index", "before_tokens", "reduction_tokens")
    loose = marked.groupBy().agg(F.count_if(~F.col("_ok")).alias("unqualified_records"))
    per_pair = pairs.groupBy().agg(
        F.count_if(~F.col("agreed")).alias("conflicting_pairs"),
        F.coalesce(F.sum(F.col("records") - 1), F.lit(0)).alias("duplicate_records"),
    )
    one = F.lit(1).alias("_one")
    counts = per_pair.select("*", one).join(loose.select("*", one), "_one").drop("_one")
    return Evidence(reductions, counts)


def qualified_retention(events: DataFrame, order: str = "log_order") -> DataFrame:
    """The first record of each pair whose retention tallies all agree, with LOSSY flags."""
    total, literal, lexical = (
        F.col("retention_total"), F.col("retention_retained"), F.col("retention_lexical"),
    )
    usable = _bound_pair() & _all(literal <= total, lexical <= total)
    tally = F.struct(
        total, literal, lexical,
        F.col("before_observation")["source_sha256"].alias("before_source"),
        F.col("after_observation")["source_sha256"].alias("after_source"),
    )
    pairs = (
        events.filter(usable)
        .withColumn("_tally", tally)
        .groupBy(*PAIR)
        .agg(
            F.min(order).alias("first_index"),
            F.min("_tally").alias("_least"),
            F.max("_tally").alias("_most"),
            F.min_by("ts", order).alias("ts"),
        )
        .filter(F.col("_least") == F.col("_most"))
    )
    out = pairs.select(*PAIR, "first_index", "ts", "_least.*")
    half = F.floor(total / 2) + total % 2
    return out.withColumn("lossy", (total > 0) & (lexical < half))


def retention_totals(measured: DataFrame) -> DataFrame:
    """Measured pairs and retained checks per provider."""
    return measured.groupBy("provider").agg(
        F.count("*").alias("measured_events"),
        F.sum("retention_retained").alias("retained"),
        F.sum("retention_lexical").alias("lexical_retained"),
        F.sum("retention_total").alias("checks"),
    )


def with_reductions(events: DataFrame, evidence: Evidence, order: str = "log_order") -> DataFrame:
    """Events with ``reduction_tokens`` on the first record of each agreed pair."""
    firsts = evidence.reductions.select(
        F.col("first_index").alias("_first"), "provider", "session_id", "reduction_tokens"
    )
    return events.join(
        firsts,
        (events[order] == firsts["_first"])
        & (events["provider"] == firsts["provider"])
        & (events["session_id"] == firsts["session_id"]),
        "left",
    ).select(events["*"], firsts["reduction_tokens"])


def session_telemetry(events: DataFrame, evidence: Evidence, order: str = "log_order") -> DataFrame:
    """Per session and source: extent, applied count, qualified reductions, last strategy."""
    applied = F.col("outcome") == "applied"
    cut = F.col("reduction_tokens")
    return (
        with_reductions(events, evidence, order)
        .filter(F.col("source_identity_sha256").isNotNull())
        .groupBy("provider", "session_id", "source_identity_sha256")
        .agg(
            F.min("ts").alias("min_ts"),
            F.max("ts").alias("max_ts"),
            F.count_if(applied).alias("applied"),
            F.count_if(applied & cut.isNotNull()).alias("qualified_reductions"),
            F.count_if(applied & cut.isNull()).alias("unqualified_applied"),
            F.coalesce(F.sum(F.when(applied, cut)), F.lit(0)).alias("reclaimed_tokens"),
            F.max(F.when(applied, F.col("ts"))).alias("last_applied_ts"),
            F.max_by("strategy", F.when(applied, F.struct("ts", order))).alias("last_strategy"),
        )
    )


MAX_WINDOW_MS = 366 * 86_400_000


def session_report(
    sessions: DataFrame, telemetry: DataFrame, now_ms: int, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sessions with their window, usage and telemetry; and the coverage of the report.

    ``sessions``: provider, session_id, source_identity_sha256, age_secs, lifetime_scope,
    lifetime_input_tokens, lifetime_cached_tokens, discovery_order.  A key seen twice
    keeps its first row. All are reported; a page of the first ``limit`` is a separate wish, and the rest are then
    counted as omitted.
    """
    source = ["provider", "session_id", "source_identity_sha256"]
    keyed = sessions.withColumn("report_id", F.substring("source_identity_sha256", 1, 32))
    first = keyed.groupBy("provider", "report_id").agg(
        F.min_by(F.struct(*sessions.columns), "discovery_order").alias("s")
    ).select("report_id", "s.*")
    shown = first if limit is None else first.orderBy("discovery_order").limit(limit)
    joined = shown.join(telemetry, source, "left")
    active = F.when(
        F.col("age_secs").isNotNull(), F.greatest(now_ms - F.col("age_secs") * 1000, F.lit(0))
    )
    low = F.when(F.col("min_ts") > 0, F.least(F.col("min_ts") * 1000, F.lit(now_ms)))
    high = F.when(F.col("max_ts") > 0, F.least(F.col("max_ts") * 1000, F.lit(now_ms)))
    end = F.coalesce(active, high, F.lit(0))
    begin = F.least(F.coalesce(active, low, F.lit(0)), F.coalesce(low, end), end)
    full = (F.col("end_ms") > 0) & (F.col("lifetime_scope") == "full")
    tokens, cached = F.col("lifetime_input_tokens"), F.col("lifetime_cached_tokens")
    rows = (
        joined.withColumns({"last_activity_ms": active, "end_ms": end, "_begin": begin})
        .withColumn("start_ms", F.greatest(F.col("_begin"), F.col("end_ms") - MAX_WINDOW_MS))
        .withColumns(
            {
                "input_tokens": F.when(full, F.greatest(tokens - cached, F.lit(0))),
                "cache_read_tokens": F.when(full, F.least(cached, tokens)),
                "applied": F.coalesce("applied", F.lit(0)),
                "qualified_reductions": F.coalesce("qualified_reductions", F.lit(0)),
                "unqualified_applied": F.coalesce("unqualified_applied", F.lit(0)),
                "recorded_reduction_tokens": F.when(
                    F.col("qualified_reductions") > 0, F.col("reclaimed_tokens")
                ),
                "last_applied_ms": F.when(
                    F.col("last_applied_ts") > 0, F.least(F.col("last_applied_ts") * 1000, F.lit(now_ms))
                ),
            }
        )
        .select(
            "provider", "report_id", "session_id", "start_ms", "end_ms", "last_activity_ms",
            "input_tokens", "cache_read_tokens", "applied", "qualified_reductions",
            "unqualified_applied", "recorded_reduction_tokens", "last_applied_ms", "last_strategy",
        )
    )
    coverage = first.groupBy().agg(F.count("*").alias("distinct_sessions")).withColumns(
        {
            "exported": F.col("distinct_sessions") if limit is None else F.least("distinct_sessions", F.lit(limit)),
            "omitted": F.lit(0) if limit is None else F.greatest(F.col("distinct_sessions") - limit, F.lit(0)),
        }
    )
    return rows, coverage


def cohort_summary(events: DataFrame, evidence: Evidence, order: str = "log_order") -> DataFrame:
    """Per provider and recorded rollout arm, and per provider over all arms (arm NULL)."""
    arm = F.coalesce("decision_cohort", F.lit("unknown"))
    policy = F.startswith("strategy", F.lit("prompt-policy"))
    unresolved = _true(F.col("error_code") == "unresolved_context")
    skipped = policy & (F.col("outcome") == "skipped") & ~unresolved
    withheld = (
        skipped & (F.col("arm") == "control")
        & (F.col("context_tokens_before") >= F.col("trigger_tokens"))
    )
    applied = F.col("outcome") == "applied"
    identity = F.coalesce(
        "source_identity_sha256", F.concat(F.lit("unqualified:"), F.col("session_id"))
    )
    marked = (
        with_reductions(events, evidence, order)
        .withColumn("arm", arm)
        .withColumns(
            {
                "_identity": identity,
                "_shown": policy & (F.col("outcome") == "planned"),
                "_withheld": withheld,
                "_silent": skipped & ~withheld,
                "_watch": F.col("strategy").isin("watch-apply:control", "watch-native:control"),
                "_applied": applied,
                "_cut": F.when(applied, F.col("reduction_tokens")),
                "_unresolved": unresolved,
            }
        )
    )
    return (
        marked.rollup("provider", "arm")
        .agg(
            F.count_distinct("_identity").alias("sessions"),
            F.count("*").alias("events"),
            F.count_if("_shown").alias("advisories_shown"),
            F.count_if("_withheld").alias("advisories_suppressed"),
            F.count_if("_silent").alias("silent_decisions"),
            F.count_if("_watch").alias("watch_suppressed"),
            F.count_if("_applied").alias("applies"),
            F.coalesce(F.sum("_cut"), F.lit(0)).alias("reclaimed_tokens"),
            F.count_if("_unresolved").alias("unresolved_context"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .filter(F.col("provider").isNotNull())
    )


def failure_class(message: str | Column) -> tuple[Column, Column]:
    """Class of a provider failure text, and the seconds to hold before another try."""
    raw = F.col(message) if isinstance(message, str) else message
    text = F.lower(raw)

    def has(*needles: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])

    def exact(*needles: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(raw, F.lit(n)) for n in needles])

    name = (
        F.when(has("usage limit"), "usage limit exceeded")
        .when(has("cannot resume"), "cannot resume provider thread")
        .when(has("not found"), "provider thread not found")
        .when(has("not supported"), "provider operation not supported")
        .otherwise("provider rejected")
    )
    hold = (
        F.when(exact("usage limit"), 14_400)
        .when(exact("cannot resume", "not found", "not supported"), 86_400)
        .when(
            exact("outcome unknown", "turn failed", "turn interrupted", "turn aborted", "turn unknown"),
            3_600,
        )
        .otherwise(0)
    )
    return name, hold


def policy_decision(sessions: DataFrame) -> DataFrame:
    """What to do with each session: nothing, a provider control, a rewrite, or a block.

    Reads ``context_tokens`` (NULL when unresolved), ``session_active``, ``treatment`` and the
    policy columns.
    """
    from palimpsest.plans.policy import effective_trigger

    context = F.coalesce("context_tokens", F.lit(0))
    over = context >= F.col("effective_trigger")
    return (
        sessions.withColumn("effective_trigger", effective_trigger())
        .withColumn(
            "action",
            F.when(~over, "none")
            .when(F.col("session_active"), "provider_compact")
            .otherwise("transcript_compact"),
        )
        .withColumn(
            "control",
            F.when(
                over & F.col("session_active"),
                F.when(F.col("provider") == fixed.WINDOW, "thread/compact/start").otherwise(
                    "/compact or relaunch --autocompact"
                ),
            ),
        )
        .withColumn(
            "blocked",
            F.col("context_tokens").isNotNull()
            & (F.col("provider") == fixed.BRANCH)
            & F.col("treatment")
            & (F.col("block_tokens") > 0)
            & (context >= F.col("block_tokens")),
        )
    )

"""Monitor series: deltas between observations, coverage, freshness, arm comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordered import previous

SESSION = ["provider", "session_id"]
REASONS = [
    "missing_component", "null_component", "malformed_component", "overflow", "invalid_ancestry",
    "invalid_record", "read_limit", "source_changed", "source_unavailable",
]


def accounting_fields(rows: DataFrame) -> DataFrame:
    """Reported context and lifetime counters held to their declared states.

    Reads context_state, reported_context, context_reason, lifetime_scope,
    lifetime_input_tokens, lifetime_cached_tokens and has_components.
    """
    known = F.when(F.col("context_state").isin("absent", "unknown", "reported", "reset"), F.col("context_state")).otherwise("absent")
    scope = F.when(F.col("lifetime_scope").isin("absent", "partial", "full"), F.col("lifetime_scope")).otherwise("absent")
    reason = F.when(F.col("context_reason").isNotNull(),
                    F.when(F.col("context_reason").isin(REASONS), F.col("context_reason")).otherwise("invalid_record"))
    complete = (
        (F.col("_state") == "reported") & F.col("_reason").isNull() & ~F.col("has_components")
        & F.col("reported_context").isNotNull()
    )
    full = F.col("_scope") == "full"
    return (
        rows.withColumns({"_state": known, "_scope": scope, "_reason": reason})
        .withColumn("_complete", complete)
        .withColumns(
            {
                "context_state": F.when((F.col("_state") == "reported") & ~F.col("_complete"), "unknown").otherwise(F.col("_state")),
                "context_tokens": F.when(F.col("_complete"), F.col("reported_context")),
                "context_reason": F.when(
                    F.col("_reason").isNull() & (F.col("has_components") | ((F.col("_state") == "reported") & ~F.col("_complete"))),
                    "invalid_record",
                ).otherwise(F.col("_reason")),
                "lifetime_scope": F.col("_scope"),
                "lifetime_input_tokens": F.when(full, F.col("lifetime_input_tokens")),
                "lifetime_cached_tokens": F.when(full, F.col("lifetime_cached_tokens")),
            }
        )
        .drop("_state", "_scope", "_reason", "_complete", "reported_context", "has_components")
    )


def monitor_deltas(samples: DataFrame, levels: list[Column], keys: list[str] = SESSION) -> DataFrame:
    """Context drop and counter change against the session's observation before.

    Comparable only when both name the same source.  A counter that fell is a reset.
    """
    seen = previous(
        samples, keys, levels,
        {
            "_source": F.col("source_identity_sha256"), "_state": F.col("context_state"),
            "_context": F.col("context_tokens"), "_count": F.col("native_applied"),
        },
    )
    same = F.coalesce(F.col("_source") == F.col("source_identity_sha256"), F.lit(False))
    both = same & (F.col("_state") == "reported") & (F.col("_context") > 0) & (F.col("context_tokens") > 0)
    counted = same & F.col("native_applied").isNotNull() & F.col("_count").isNotNull()
    return seen.select(
        *samples.columns,
        F.when(both, F.greatest(F.col("_context") - F.col("context_tokens"), F.lit(0))).alias("context_drop_tokens"),
        F.when(counted & (F.col("native_applied") >= F.col("_count")), F.col("native_applied") - F.col("_count")).alias("native_applied_delta"),
        F.when(counted, F.col("native_applied") < F.col("_count")).alias("native_counter_reset"),
    )


def coverage_summary(report: DataFrame, wanted: DataFrame, providers: list[str], limit: int = 256) -> DataFrame:
    """How much of the wanted sessions a report covers, and the issues.

    ``report``: provider, session_id, context_state, context_tokens, context_reason.
    ``wanted``: session_id.
    """
    named = wanted.select("session_id").distinct().withColumn("_wanted", F.lit(True))
    ok = F.col("session_id").rlike(r"^[A-Za-z0-9._-]{1,256}$")
    rows = report.join(named, "session_id", "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    opted = F.col("provider").isin(providers) if providers else F.lit(False)
    eligible = ok & (F.col("_wanted") | opted)
    sums = rows.groupBy().agg(
        F.count_distinct(F.when(ok & F.col("_wanted"), F.col("session_id"))).alias("selected_overlap"),
        F.count_if(eligible).alias("eligible_samples"),
        F.count_if(~ok & opted).alias("identifier_omissions"),
        F.count_if(eligible & F.col("context_tokens").isNotNull()).alias("complete_samples"),
        F.count_if(eligible & F.col("context_reason").isNotNull()).alias("samples_with_reason"),
    )
    size = named.groupBy().agg(F.count("*").alias("selected_sessions"))
    one = F.lit(1).alias("_one")
    joined = sums.select("*", one).join(size.select("*", one), "_one").drop("_one")
    missing = F.col("selected_sessions") - F.col("selected_overlap")
    return joined.withColumns(
        {
            "selected_unavailable": missing,
            "exported_samples": F.least("eligible_samples", F.lit(limit)),
            "issues": F.array_compact(F.array(
                F.when((F.col("selected_sessions") > 0) & (F.col("selected_overlap") == 0), "selected_overlap_empty"),
                F.when(missing > 0, "selected_sessions_unavailable"),
                F.when(F.col("complete_samples") < F.col("eligible_samples"), "incomplete_context_measurements"),
                F.when(F.col("identifier_omissions") > 0, "unsupported_session_identifiers"),
                F.when(F.col("eligible_samples") > limit, "coverage_truncated"),
            )),
        }
    )


def checkpoint_status(artifact: str, now_ms: int) -> Column:
    """Freshness of a watch checkpoint.  Reads artifact_sha256, started_ms, completed_ms, interval_secs."""
    age = now_ms - F.coalesce("completed_ms", "started_ms")
    return (
        F.when(F.col("artifact_sha256") != artifact, "artifact_mismatch")
        .when(age > F.greatest(F.lit(180_000), F.col("interval_secs") * 3_000), "stale")
        .when(F.col("completed_ms").isNull(), "in_progress")
        .otherwise("fresh")
    )


def compare_arms(a: DataFrame, b: DataFrame, case: list[str], invariant: list[str], metrics: list[str]) -> DataFrame:
    """Metric differences of two arms per case; refused where an invariant differs."""
    left = a.select(*case, *[F.col(c).alias(f"_a_{c}") for c in invariant + metrics])
    right = b.select(*case, *[F.col(c).alias(f"_b_{c}") for c in invariant + metrics])
    joined = left.join(right, case)
    same = F.lit(True)
    for c in invariant:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    delta = [F.when(same, F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias(f"{m}_delta") for m in metrics]
    lacking = F.array_compact(F.array(*[
        F.when(F.col(f"_a_{m}").isNull() | F.col(f"_b_{m}").isNull(), m) for m in metrics
    ]))
    return joined.select(*case, same.alias("comparable"), *delta, lacking.alias("unavailable"))


def score_answers(answers: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Recall answers per fact: passed, failed, or invalid_response.

    ``answers``: keys, fact, answer (NULL when none was given), is_text.
    """
    joined = expected.join(answers, keys + ["fact"], "left")
    status = (
        F.when(F.col("answer").isNull() | ~F.coalesce("is_text", F.lit(False)), "invalid_response")
        .when(F.col("answer") == F.col("expected"), "passed").otherwise("failed")
    )
    return joined.select(*keys, "fact", status.alias("status"))


def cost_totals(costs: DataFrame, by: list[str]) -> DataFrame:
    """Sum of reported costs and whether every one was usable."""
    ok = F.coalesce((F.col("cost") >= 0) & ~F.isnan("cost"), F.lit(False))
    return costs.groupBy(*by).agg(
        F.sum(F.when(ok, F.col("cost"))).alias("cost"), F.bool_and(ok).alias("complete"), F.count("*").alias("reports")
    )

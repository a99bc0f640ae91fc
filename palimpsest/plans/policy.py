"""Policies: defaults, layers, validation, adaptation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.operators.ordered import newest

KEYS = ["provider", "session_id", "path"]


@dataclass(frozen=True)
class Policy:
    """When to compact a session, and what to keep.  Defaults are the published ones."""

    trigger_tokens: int = 250_000
    floor_tokens: int = 40_000
    keep_recent_tool_outputs: int = 8
    keep_score_threshold: float | None = None
    min_interval_secs: int = 300
    apply_hold_secs: int = 1_800
    min_savings_tokens: int = 4_096
    quota_pressure: str = "normal"
    adaptive: bool = False
    block_tokens: int = 0
    keep_recent_turns: int = 3
    result_max_bytes: int = 500

    def columns(self) -> dict[str, Column]:
        out = {}
        for name, value in asdict(self).items():
            lit = F.lit(value)
            if isinstance(value, bool) or isinstance(value, str):
                out[name] = lit
            elif name == "keep_score_threshold":
                out[name] = lit.cast("double")
            else:
                out[name] = lit.cast("long")
        return out


POLICY_FIELDS = list(asdict(Policy()))


def with_policy(sessions: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Put one policy on every session."""
    return sessions.withColumns((policy or Policy()).columns())


def effective_trigger(
    trigger: str | Column = "trigger_tokens", pressure: str | Column = "quota_pressure"
) -> Column:
    """Trigger under quota pressure, at least one."""
    trigger = F.col(trigger) if isinstance(trigger, str) else trigger
    pressure = F.col(pressure) if isinstance(pressure, str) else pressure
    factor = F.when(pressure == "high", 0.7).when(pressure == "low", 1.15).otherwise(1.0)
    return F.greatest(F.round(trigger.cast("double") * factor), F.lit(1.0)).cast("long")


def accepts_savings(
    before: str = "tokens_before", after: str = "tokens_after", least: str = "min_savings_tokens"
) -> Column:
    return F.greatest(F.col(before) - F.col(after), F.lit(0)) >= F.col(least)


def resolve_policy(sessions: DataFrame, layers: DataFrame) -> DataFrame:
    """Most specific setting wins: session, preset, provider, global, then the default.

    ``layers`` has ``scope`` (global, provider, preset, session), ``scope_key``, and any
    policy columns, NULL where the layer says nothing.  ``sessions`` may have ``preset``.
    """
    fields = [f for f in POLICY_FIELDS if f in layers.columns]
    out = sessions
    if "preset" not in out.columns:
        out = out.withColumn("preset", F.lit(None).cast("string"))
    scopes = [
        ("session", F.col("session_id")),
        ("preset", F.col("preset")),
        ("provider", F.col("provider")),
        ("global", F.lit("")),
    ]
    for scope, key in scopes:
        side = layers.filter(F.col("scope") == scope).select(
            F.coalesce(F.col("scope_key"), F.lit("")).alias(f"_key_{scope}"),
            *[F.col(f).alias(f"_{scope}_{f}") for f in fields],
        )
        out = out.join(side, key == F.col(f"_key_{scope}"), "left")
    defaults = Policy().columns()
    resolved = {
        f: F.coalesce(*[F.col(f"_{s}_{f}") for s, _ in scopes], defaults[f])
        if f in fields
        else defaults[f]
        for f in POLICY_FIELDS
    }
    return out.withColumns(resolved).select(*sessions.columns, *POLICY_FIELDS)


def policy_problem() -> Column:
    """Why a policy row is refused; NULL when it is valid."""
    score = F.col("keep_score_threshold")
    big, items, secs = fixed.MAX_POLICY_TOKENS, fixed.MAX_ITEMS, fixed.MAX_INTERVAL_SECS
    bad_bounds = (
        (F.col("trigger_tokens") <= 0)
        | (F.col("trigger_tokens") > big)
        | (F.col("floor_tokens") >= F.col("trigger_tokens"))
        | (F.col("keep_recent_tool_outputs") > items)
        | (F.col("min_interval_secs") > secs)
        | (F.col("apply_hold_secs") > secs)
        | (F.col("min_savings_tokens") > big)
        | (F.col("block_tokens") > big)
        | (F.col("keep_recent_turns") > items)
        | (F.col("result_max_bytes") > big)
    )
    bad_score = score.isNotNull() & (F.isnan(score) | (score < 0.0) | (score > 1.0))
    return F.when(bad_score, "keep_score_threshold").when(bad_bounds, "bounds")


def validate_policy(policies: DataFrame) -> DataFrame:
    """The refused policies with their reason."""
    return policies.withColumn("problem", policy_problem()).filter(F.col("problem").isNotNull())


def recent_reductions(reductions: DataFrame, k: int = 3) -> DataFrame:
    """The latest ``k`` positive reductions of each session, newest first."""
    keys = ["provider", "session_id"]
    top = newest(
        reductions.filter(F.col("reduction_tokens") > 0), keys, [F.col("first_index").desc()], k
    )
    return top.groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("_rank", "before_tokens", "reduction_tokens"))
            ),
            lambda r: F.struct(r.before_tokens.alias("before"), r.reduction_tokens.alias("reclaimed")),
        ).alias("recent")
    )


def adapt_policy(sessions: DataFrame) -> DataFrame:
    """Trigger and floor fitted to each session, with the reasons.

    Reads the policy columns and ``model_context_window``, ``context_tokens``,
    ``elidable_tokens`` and ``recent`` (array of before/reclaimed, newest first).
    """
    base = F.col("trigger_tokens")
    window = F.col("model_context_window")
    cap = F.round(window * 0.25).cast("long")
    capped = F.coalesce((window > 0) & (base > cap), F.lit(False))
    step1 = F.when(capped, F.greatest(cap, F.lit(10_000))).otherwise(base)

    recent = F.slice("recent", 1, 3)
    low_yield = F.coalesce(
        (F.size(recent) >= 2)
        & F.forall(
            recent,
            lambda r: (r.before > 0) & (r.reclaimed.cast("double") < r.before.cast("double") * 0.10),
        ),
        F.lit(False),
    )
    raised = F.round(F.col("_t1") * 1.5).cast("long")
    raise_it = F.col("_low") & (raised > F.col("_t1"))
    step2 = F.when(
        raise_it, F.least(raised, F.round(base * 2.0).cast("long"))
    ).otherwise(F.col("_t1"))

    tight = F.round(F.col("_t2") * 0.8).cast("long")
    tighten = F.coalesce(
        (F.col("context_tokens") > 0)
        & (F.col("elidable_tokens").cast("double") > F.col("context_tokens") * 0.5)
        & (tight < F.col("_t2")),
        F.lit(False),
    )
    step3 = F.when(tighten, tight).otherwise(F.col("_t2"))

    floor_cap = F.floor(F.col("_t3") * 0.5).cast("long")
    cut_floor = F.col("floor_tokens") > floor_cap
    floor1 = F.when(cut_floor, F.greatest(floor_cap, F.lit(1_000))).otherwise(F.col("floor_tokens"))
    trigger = F.greatest(F.col("_t3"), F.lit(10_000), F.col("_f1") * 2)
    floor2 = F.least(
        F.greatest(F.col("_f1"), F.lit(1_000)), F.floor(F.col("adapted_trigger") / 2).cast("long")
    )
    out = (
        sessions.withColumns({"_t1": step1, "_capped": capped, "_low": low_yield})
        .withColumns({"_t2": step2, "_raised": raise_it})
        .withColumns({"_t3": step3, "_tight": tighten})
        .withColumns({"_f1": floor1, "_cut": cut_floor})
        .withColumn("adapted_trigger", trigger)
        .withColumn("adapted_floor", floor2)
        .withColumn(
            "reasons",
            F.array_compact(
                F.array(
                    F.when(F.col("_capped"), "trigger_capped_to_window_fraction"),
                    F.when(F.col("_raised"), "trigger_raised_low_yield"),
                    F.when(F.col("_tight"), "trigger_lowered_high_elidable"),
                    F.when(F.col("_cut"), "floor_capped_to_trigger_half"),
                )
            ),
        )
    )
    return out.select(*sessions.columns, "adapted_trigger", "adapted_floor", "reasons")


def economics(policies: DataFrame, against: Sequence[tuple[int, int]] = ((900_000, 60_000),)) -> DataFrame:
    """Mean context of the fill-and-compact cycle, and its ratio to other cycles."""
    mean = ((F.col("trigger_tokens") + F.col("floor_tokens")) / 2).cast("double")
    out = policies.withColumn("mean_context", mean)
    for trigger, floor in against:
        other = (trigger + floor) / 2
        out = out.withColumn(f"ratio_to_{trigger}_{floor}", F.lit(other) / F.col("mean_context"))
    return out

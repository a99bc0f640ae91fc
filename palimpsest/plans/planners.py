"""The planners: which elidable rows to drop, as window selections over many sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.operators.ordered import exclusive_sums, line_levels, newest
from palimpsest.operators.turns import turn_starts
from palimpsest.plans.base import Plans, Prepared, before_cut, finish, remaining
from palimpsest.plans.card import choose_with_card
from palimpsest.plans.policy import KEYS
from palimpsest.plans.scores import heuristic_scores
from palimpsest.session import cut


def oldest_first():
    return line_levels()


def newest_first():
    return line_levels(newest_first=True)


def over_floor(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("remaining") > F.col("floor_tokens"))


def plan_elide(p: Prepared) -> Plans:
    """Oldest unprotected rows first, until the floor."""
    return finish("elide", over_floor(remaining(p.unprotected, p.sessions, oldest_first())), p.sessions)


def plan_compacted(p: Prepared) -> Plans:
    """Oldest first, with a state card."""
    return choose_with_card("compacted", remaining(p.unprotected, p.sessions, oldest_first()), p.sessions)


def plan_cache_aware(p: Prepared) -> Plans:
    """Newest unprotected rows first, to leave the prefix unchanged."""
    return choose_with_card("cache_aware", remaining(p.unprotected, p.sessions, newest_first()), p.sessions)


def dedupe_candidates(p: Prepared) -> DataFrame:
    """Unprotected rows with a newer unprotected copy: same label, same payload."""
    copies = KEYS + ["label", "payload_sha256"]
    known = p.unprotected.filter(F.col("payload_sha256").isNotNull())
    latest = known.groupBy(*copies).agg(F.max("line_index").alias("cut_line"))
    return (
        known.join(latest, copies).filter(F.col("line_index") < F.col("cut_line")).drop("cut_line")
    )


def plan_dedupe(p: Prepared) -> Plans:
    return choose_with_card(
        "dedupe", remaining(dedupe_candidates(p), p.sessions, oldest_first()), p.sessions
    )


def micro_candidates(p: Prepared, keep_per_tool: int = 2) -> DataFrame:
    """All but the newest two rows of each tool.  The protected tail is not spared here."""
    by_tool = KEYS + ["tool"]
    kept = newest(
        p.elidable.select(*by_tool, "line_index"), by_tool, [F.col("line_index").desc()], keep_per_tool
    )
    edge = kept.groupBy(*by_tool).agg(F.min("line_index").alias("cut_line"))
    return before_cut(p.elidable, edge, by_tool).select(*p.elidable.columns)


def plan_micro(p: Prepared) -> Plans:
    return choose_with_card("micro", remaining(micro_candidates(p), p.sessions, oldest_first()), p.sessions)


def middle_candidates(p: Prepared) -> DataFrame:
    """Rows after the first k and before the last k elidable rows."""
    if p.keep is None:
        raise ValueError("middle needs one keep_recent_tool_outputs for all sessions")
    lines = p.elidable.select(*KEYS, "line_index")
    head = newest(lines, KEYS, [F.col("line_index")], p.keep)
    head_end = head.groupBy(*KEYS).agg(F.max("line_index").alias("_head_end"))
    after_head = (
        p.unprotected.join(head_end, KEYS, "left")
        .filter(F.col("_head_end").isNull() | (F.col("line_index") > F.col("_head_end")))
        .drop("_head_end")
    )
    return after_head


def plan_middle(p: Prepared) -> Plans:
    return choose_with_card("middle", remaining(middle_candidates(p), p.sessions, oldest_first()), p.sessions)


def plan_structured(p: Prepared, tail_items: int = 24) -> Plans:
    """Every unprotected row before the last 24 items, whatever the floor."""
    lines = p.items.join(p.sessions.select(*KEYS), KEYS, "left_semi").select(*KEYS, "line_index")
    tail = newest(lines, KEYS, [F.col("line_index").desc()], tail_items)
    edge = tail.groupBy(*KEYS).agg(F.min("line_index").alias("cut_line"))
    return finish("structured", before_cut(p.unprotected, edge), p.sessions)


def plan_cliff(p: Prepared, keep_turns: int = 3) -> Plans:
    """Older large results between the head and the newest ``keep_turns`` steps."""
    starts = turn_starts(p.items.join(p.sessions.select(*KEYS), KEYS, "left_semi"))
    extent = starts.groupBy(*KEYS).agg(
        F.count("*").alias("_steps"), F.min("line_index").alias("_head_end")
    )
    older = extent.filter(F.col("_steps") > keep_turns)
    tail = newest(starts, KEYS, [F.col("line_index").desc()], keep_turns)
    edge = tail.groupBy(*KEYS).agg(F.min("line_index").alias("cut_line"))
    chosen = (
        before_cut(p.unprotected, edge)
        .join(older, KEYS)
        .join(p.sessions.select(*KEYS, "result_max_bytes"), KEYS)
        .filter(
            (F.col("line_index") >= F.col("_head_end"))
            & (F.col("elidable_bytes") > F.col("result_max_bytes"))
        )
    )
    return finish("cliff", chosen, p.sessions, fixed.CLIFF_STUB)


def plan_sawtooth(p: Prepared) -> Plans:
    """Hand over to the provider's own compaction: one control row per due session."""
    control = F.when(
        F.col("provider") == fixed.WINDOW, "codex app-server: thread/compact/start"
    ).otherwise("claude: /compact (or --autocompact at launch)")
    plans = p.sessions.select(
        *KEYS,
        F.lit("sawtooth").alias("strategy"),
        F.col("context_tokens").alias("tokens_before"),
        F.col("floor_tokens").alias("tokens_after"),
        F.lit(1).cast("long").alias("edits"),
        F.lit(None).cast("long").alias("first_line"),
    )
    edits = p.sessions.select(
        *KEYS,
        F.lit("sawtooth").alias("strategy"),
        F.lit("provider_compact").alias("op"),
        control.alias("control"),
    )
    return Plans(plans, edits)


def usable_scores(candidates: DataFrame, scores: DataFrame, threshold: float | None) -> DataFrame:
    """Candidates with ``keep_score``.

    Without a cutoff a missing score counts 0.5 and a repeated one takes the last by
    ``score_order``.  With a cutoff only rows with one finite score in 0..1 under it
    stay; missing and repeated scores keep the row from being dropped.
    """
    lines = KEYS + ["line_index"]
    if "score_order" not in scores.columns:
        scores = scores.withColumn("score_order", F.lit(0))
    one = scores.groupBy(*lines).agg(
        F.max_by("keep_probability", "score_order").alias("_score"), F.count("*").alias("_given")
    )
    joined = candidates.join(one, lines, "left")
    if threshold is None:
        usable = joined.withColumn("keep_score", F.coalesce("_score", F.lit(0.5)))
    else:
        usable = joined.filter(
            (F.col("_given") == 1)
            & ~F.isnan("_score")
            & F.col("_score").between(0.0, 1.0)
            & (F.col("_score") < threshold)
        ).withColumn("keep_score", F.col("_score"))
    return usable.drop("_score", "_given")


def score_key(score: str = "keep_score"):
    """Score in millionths, within 0..1; not-a-number counts as 0."""
    held = F.when(F.isnan(score), 0.0).otherwise(
        F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    )
    return F.floor(held * 1_000_000).cast("long")


def plan_scored(
    p: Prepared, scores: DataFrame | None = None, threshold: float | None = None
) -> Plans:
    """Lowest keep scores inside the smallest tailward window that can reach the floor."""
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        empty = p.unprotected.limit(0)
        return finish("scored", empty, p.sessions)
    if scores is None:
        scores = cut(heuristic_scores(p.items, p.sessions, p.unprotected), "scores")
    usable = usable_scores(p.unprotected, scores, threshold)
    tailward = exclusive_sums(usable, KEYS, newest_first(), {"_newer_savings": F.col("savings")})
    targets = p.sessions.select(
        *KEYS, F.greatest(F.col("context_tokens") - F.col("floor_tokens"), F.lit(0)).alias("_target")
    )
    window = (
        tailward.join(targets, KEYS)
        .filter(F.col("_newer_savings") < F.col("_target") + fixed.CARD_RESERVE_TOKENS)
        .drop("_newer_savings", "_target")
    )
    by_score = [score_key(), -F.col("savings"), *oldest_first()]
    return choose_with_card(
        "scored", remaining(window, p.sessions, by_score), p.sessions, one_by_one=True
    )


def plan_cache_edits(p: Prepared, scores: DataFrame | None = None) -> Plans:
    """Tool-use ids to drop by provider control, lowest keep score first.  Branch dialect only."""
    branch = p.unprotected.filter(
        (F.col("provider") == fixed.BRANCH) & (F.size("tool_use_ids") > 0)
    )
    if scores is None:
        scores = cut(heuristic_scores(p.items, p.sessions, branch), "scores")
    usable = usable_scores(branch, scores, None)
    order = F.struct(F.col("keep_score"), (-F.col("savings")).alias("s"), F.col("line_index"))
    ids = usable.select(
        *KEYS, "line_index", order.alias("_order"), F.explode("tool_use_ids").alias("tool_use_id")
    )
    first = ids.groupBy(*KEYS, "tool_use_id").agg(
        F.min("_order").alias("_order"),
    )
    introduced = first.select(
        *KEYS, F.col("_order.line_index").alias("line_index"), "tool_use_id"
    )
    fresh = introduced.groupBy(*KEYS, "line_index").agg(F.count("*").alias("_fresh"))
    rows = usable.join(fresh, KEYS + ["line_index"])
    levels = [score_key(), F.col("keep_score"), -F.col("savings"), *oldest_first()]
    summed = exclusive_sums(
        rows, KEYS, levels, {"_freed": F.col("savings"), "_ids": F.col("_fresh")}
    )
    context = p.sessions.select(*KEYS, "context_tokens", "floor_tokens")
    chosen = summed.join(context, KEYS).filter(
        (F.col("context_tokens") - F.col("_freed") > F.col("floor_tokens"))
        & (F.col("_ids") + F.col("_fresh") <= fixed.MAX_ITEMS)
    )
    edits = introduced.join(chosen.select(*KEYS, "line_index", "savings"), KEYS + ["line_index"]).select(
        *KEYS,
        F.lit("cache_edits").alias("strategy"),
        F.lit("cache_edit").alias("op"),
        "line_index",
        "savings",
        "tool_use_id",
    )
    sums = chosen.groupBy(*KEYS).agg(F.sum("savings").alias("freed"), F.sum("_fresh").alias("edits"))
    plans = sums.join(context, KEYS).select(
        *KEYS,
        F.lit("cache_edits").alias("strategy"),
        F.col("context_tokens").alias("tokens_before"),
        F.greatest(F.col("context_tokens") - F.col("freed"), F.lit(0)).alias("tokens_after"),
        "edits",
        F.lit(None).cast("long").alias("first_line"),
    )
    return Plans(plans, edits)


STRATEGIES = {
    "cache_aware": plan_cache_aware,
    "scored": plan_scored,
    "elide": plan_elide,
    "compacted": plan_compacted,
    "dedupe": plan_dedupe,
    "micro": plan_micro,
    "middle": plan_middle,
    "structured": plan_structured,
    "cliff": plan_cliff,
    "sawtooth": plan_sawtooth,
    "cache_edits": plan_cache_edits,
}
# Planners that rewrite a transcript, in the order ties are settled.
FILE_STRATEGIES = [
    "cache_aware", "scored", "elide", "compacted", "dedupe", "micro", "middle", "structured",
]


def register(name: str, planner) -> None:
    """Add a planner of one's own: ``Prepared -> Plans``."""
    STRATEGIES[name] = planner


def prefix_tokens(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans with the tokens before their first edited line; the whole context without one."""
    first = plans.select(*KEYS, "strategy", "first_line")
    sums = (
        items.select(*KEYS, "line_index", "est_tokens")
        .join(first, KEYS)
        .filter(F.col("first_line").isNull() | (F.col("line_index") < F.col("first_line")))
        .groupBy(*KEYS, "strategy")
        .agg(F.sum("est_tokens").alias("prefix_tokens"))
    )
    return plans.join(sums, KEYS + ["strategy"], "left").withColumn(
        "prefix_tokens", F.coalesce("prefix_tokens", F.lit(0))
    )


def scored_plans(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans with ``score``: savings times the cube of the unchanged share of the context."""
    ratio = F.col("prefix_tokens").cast("double") / F.greatest("tokens_before", F.lit(1))
    saved = F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0))
    return (
        prefix_tokens(items, plans)
        .withColumn("saved", saved)
        .withColumn("prefix_ratio", ratio)
        .withColumn("score", saved.cast("double") * (ratio * ratio * ratio))
    )


def all_plans(p: Prepared, strategies: list[str]) -> DataFrame:
    """The plans of several strategies, one row per session and strategy."""
    out = None
    for name in strategies:
        rows = STRATEGIES[name](p).plans
        rows = rows.select(
            *KEYS, "strategy", "tokens_before", "tokens_after", F.col("edits").cast("long"), "first_line"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def plan_auto(p: Prepared, strategies: list[str] | None = None, active: DataFrame | None = None) -> DataFrame:
    """The best plan of each session.

    Idle sessions take the highest score, the first listed strategy on a tie.  Sessions
    named in ``active`` take a provider control: cache edits in the branch dialect where
    there are any, else the provider's own compaction.
    """
    names = strategies or FILE_STRATEGIES
    rank = F.lit(len(names))
    for i, name in enumerate(names):
        rank = F.when(F.col("strategy") == name, i).otherwise(rank)
    scored = scored_plans(p.items, all_plans(p, names)).withColumn("_order", rank)
    if active is not None:
        scored = scored.join(active.select(*KEYS), KEYS, "left_anti")
    best = newest(scored, KEYS, [F.col("score").desc(), F.col("_order")], 1).drop("_rank", "_order")
    if active is None:
        return best
    live = p._replace(
        sessions=p.sessions.join(active.select(*KEYS), KEYS, "left_semi"),
        unprotected=p.unprotected.join(active.select(*KEYS), KEYS, "left_semi"),
    )
    cache = plan_cache_edits(live).plans
    saw = plan_sawtooth(live).plans.join(cache.select(*KEYS), KEYS, "left_anti")
    controls = cache.unionByName(saw)
    return best.unionByName(controls, allowMissingColumns=True)


def explain_no_plan(sessions: DataFrame, plans: DataFrame) -> DataFrame:
    """Why a session has no plan, with the numbers."""
    from palimpsest.plans.policy import effective_trigger

    saved = F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0))
    per_session = plans.select(*KEYS, saved.alias("_saved")).groupBy(*KEYS).agg(
        F.max("_saved").alias("saved_tokens")
    )
    trigger = effective_trigger()
    reason = (
        F.when(F.col("context_tokens") < trigger, "below_trigger")
        .when(F.col("saved_tokens").isNull(), "no_selection")
        .when(F.col("saved_tokens") < F.col("min_savings_tokens"), "savings_too_small")
    )
    return (
        sessions.join(per_session, KEYS, "left")
        .withColumn("effective_trigger", trigger)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(
            *KEYS, "reason", "context_tokens", "effective_trigger", "saved_tokens", "min_savings_tokens"
        )
    )

"""Admission of plans: the reasons a plan may not be applied.  And plans from editor calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.tokens import elision_savings, is_elidable, tokens_of_bytes
from palimpsest.operators.ordered import exclusive_sums, line_levels
from palimpsest.plans.base import Plans, protected_cut
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut

PLAN = KEYS + ["strategy"]
EDIT_COLUMNS = {
    "edit_index": "int",
    "op": "string",
    "line_index": "long",
    "stub": "string",
    "item_stub": "string",
    "control": "string",
    "tool_use_id": "string",
    "card": None,
}
TEXT_FIELDS = ["goal", "summary", "current_work", "context"]
LIST_FIELDS = ["concepts", "files_touched", "decisions", "errors", "open_tasks"]


def card_bytes(card: str = "card") -> Column:
    """Text bytes of a card."""
    c = F.col(card)
    texts = [F.coalesce(F.octet_length(c[f]), F.lit(0)) for f in TEXT_FIELDS]
    lists = [
        F.aggregate(
            F.coalesce(c[f], F.expr("cast(array() as array<string>)")),
            F.lit(0),
            lambda n, t: n + F.octet_length(t),
        )
        for f in LIST_FIELDS
    ]
    return reduce(lambda a, b: a + b, texts + lists)


def validate_plans(
    items: DataFrame, edits: DataFrame, sessions: DataFrame, keep: int | None = 8
) -> DataFrame:
    """Findings: one row per plan and reason with the number of offending rows.

    ``edits`` has one row per elided line, id or card.  A plan without findings is
    admitted.  Columns an edit kind does not use may be absent.
    """
    for name, kind in EDIT_COLUMNS.items():
        if name not in edits.columns and kind is not None:
            default = F.lit(0) if name == "edit_index" else F.lit(None)
            edits = edits.withColumn(name, default.cast(kind))
    edits = cut(edits, "edits")
    scope = items.join(edits.select(*KEYS).distinct(), KEYS, "left_semi")
    findings = []

    def found(rows: DataFrame, reason: str) -> None:
        findings.append(
            rows.groupBy(*PLAN).agg(F.count("*").alias("rows")).withColumn("reason", F.lit(reason))
        )

    lines = cut(
        scope.groupBy(*KEYS, "line_index").agg(
            F.count("*").alias("_copies"),
            F.first("est_tokens").alias("est_tokens"),
            F.first("elidable_bytes").alias("elidable_bytes"),
        ),
        "lines",
    )
    sizes = lines.groupBy(*KEYS).agg(
        F.sum("_copies").alias("_items"), F.max("_copies").alias("_most")
    )
    by_plan = edits.groupBy(*PLAN).agg(
        F.count_distinct("edit_index").alias("_edits"),
        F.count_distinct(F.when(F.col("op") == "inject_digest", F.col("edit_index"))).alias("_cards"),
        F.max(F.col("op").isin("provider_compact", "cache_edit")).alias("_control"),
        F.count(F.when(F.col("op") == "cache_edit", 1)).alias("_ids"),
    ).join(sizes, KEYS, "left")
    found(
        by_plan.filter((F.col("_edits") > fixed.MAX_EDITS) | (F.col("_items") > fixed.MAX_ITEMS)),
        "too_many_edits_or_items",
    )
    found(by_plan.filter(F.col("_most") > 1), "line_occurs_twice")
    found(
        by_plan.filter((F.col("_cards") > 1) | (F.col("_control") & (F.col("_edits") > 1))),
        "edits_do_not_combine",
    )

    elide = edits.filter(F.col("op") == "elide")
    control_char = r"[\x00-\x1f\x7f-\x9f]"
    bad_stub = (
        (F.octet_length("stub") > 96)
        | F.contains("stub", F.lit("{kind}"))
        | F.col("stub").rlike(r"[\n\r]")
        | (F.col("item_stub") == "")
        | (F.octet_length("item_stub") > 200)
        | F.col("item_stub").rlike(control_char)
    )
    found(elide.filter(bad_stub), "bad_stub")
    joined = elide.select(*PLAN, "edit_index", "line_index").join(
        lines, KEYS + ["line_index"], "left"
    )
    found(joined.filter(F.col("_copies").isNull()), "no_such_line")
    tail = protected_cut(
        lines.filter(is_elidable()).select(*KEYS, "line_index"), sessions, keep
    )
    guarded = joined.filter(F.col("_copies").isNotNull()).join(tail, KEYS, "left")
    found(
        guarded.filter(
            ~is_elidable() | F.coalesce(F.col("line_index") >= F.col("cut_line"), F.lit(False))
        ),
        "line_must_stay",
    )
    found(
        elide.groupBy(*PLAN, "line_index").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1),
        "line_elided_twice",
    )

    if "card" in edits.columns:
        cards = edits.filter(F.col("op") == "inject_digest").join(sizes, KEYS, "left")
        covers = F.col("card.covers_items")
        found(
            cards.filter(
                (covers <= 0) | (covers > F.col("_items")) | (card_bytes() > fixed.MAX_CARD_BYTES)
            ),
            "bad_card",
        )
    found(
        edits.filter(F.col("op") == "provider_compact").filter(
            F.coalesce(
                (F.col("control") == "")
                | (F.octet_length("control") > 256)
                | F.col("control").rlike(control_char),
                F.lit(True),
            )
        ),
        "bad_control",
    )
    ids = edits.filter(F.col("op") == "cache_edit")
    found(
        by_plan.filter(
            (F.col("_ids") > fixed.MAX_ITEMS)
            | ((F.col("_ids") > 0) & (F.col("provider") != fixed.BRANCH))
        ),
        "cache_edit_not_allowed",
    )
    known = scope.select(*KEYS, F.explode("tool_use_ids").alias("tool_use_id")).distinct()
    shaped = F.col("tool_use_id").rlike(r"^[A-Za-z0-9_.-]{1,256}$")
    unknown = ids.join(known, KEYS + ["tool_use_id"], "left_anti")
    repeated = (
        ids.groupBy(*PLAN, "tool_use_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    )
    found(
        unknown.select(*PLAN)
        .unionByName(ids.filter(~F.coalesce(shaped, F.lit(False))).select(*PLAN))
        .unionByName(repeated.select(*PLAN)),
        "bad_tool_use_id",
    )
    return reduce(lambda a, b: a.unionByName(b), findings)


def plan_from_calls(
    items: DataFrame,
    calls: DataFrame,
    sessions: DataFrame,
    fallback: DataFrame | None = None,
    keep: int | None = 8,
) -> Plans:
    """Plans from an editor's keep, elide, summarize and defer calls.

    ``calls``: KEYS, call_index, op, from_item, to_item, items (array), digest.  Item
    numbers are positions in the session.  A session with an invalid call, a deferral or
    an inadmissible plan gets none; ``fallback`` plans serve sessions without calls.
    """
    calls = cut(calls, "calls")
    scope = items.join(calls.select(*KEYS).distinct(), KEYS, "left_semi")
    placed = exclusive_sums(
        scope.select(
            *KEYS, "line_index", is_elidable().alias("_elidable"), elision_savings().alias("savings")
        ),
        KEYS,
        line_levels(),
        {"position": F.lit(1)},
    )
    sizes = scope.groupBy(*KEYS).agg(F.count("*").alias("_items"))
    sized = calls.join(sizes, KEYS)
    bad_range = F.col("op").isin("keep", "summarize") & (
        (F.col("from_item") >= F.col("to_item")) | (F.col("to_item") > F.col("_items"))
    )
    asked = (
        sized.filter(F.col("op") == "elide")
        .select(*KEYS, "call_index", "_items", F.explode("items").alias("position"))
    )
    kept = sized.filter(F.col("op") == "keep").select(
        *KEYS, F.col("from_item").alias("_from"), F.col("to_item").alias("_to")
    )
    in_kept = asked.join(
        kept,
        [asked[k] == kept[k] for k in KEYS]
        + [F.col("position") >= F.col("_from"), F.col("position") < F.col("_to")],
        "left_semi",
    )
    refused = (
        sized.filter(bad_range | (F.col("op") == "defer")).select(*KEYS)
        .unionByName(asked.filter(F.col("position") >= F.col("_items")).select(*KEYS))
        .unionByName(in_kept.select(*KEYS))
        .unionByName(
            calls.groupBy(*KEYS).agg(F.count("*").alias("_n"))
            .filter(F.col("_n") > fixed.MAX_EDITS).select(*KEYS)
        )
        .distinct()
    )
    elided = (
        asked.join(placed, KEYS + ["position"]).filter("_elidable")
        .select(
            *KEYS,
            F.lit("agentic").alias("strategy"),
            F.col("call_index").alias("edit_index"),
            F.lit("elide").alias("op"),
            "line_index",
            "savings",
            F.lit(fixed.STUB).alias("stub"),
        )
    )
    width = F.col("to_item") - F.col("from_item")
    no_list = F.expr("cast(array() as array<string>)")
    text = F.lit(None).cast("string")
    card = F.struct(
        F.col("digest").alias("goal"),
        F.concat(F.lit("agentic digest covering "), width.cast("string"), F.lit(" items")).alias(
            "summary"
        ),
        *[no_list.alias(f) for f in LIST_FIELDS],
        text.alias("current_work"),
        text.alias("context"),
        width.cast("long").alias("covers_items"),
    )
    digests = sized.filter(F.col("op") == "summarize").select(
        *KEYS,
        F.lit("agentic").alias("strategy"),
        F.col("call_index").alias("edit_index"),
        F.lit("inject_digest").alias("op"),
        card.alias("card"),
        tokens_of_bytes(F.octet_length("digest")).alias("_added"),
    )
    edits = cut(
        elided.unionByName(digests, allowMissingColumns=True).join(refused, KEYS, "left_anti"),
        "calls",
    )
    problems = validate_plans(items, edits, sessions, keep).select(*KEYS).distinct()
    edits = edits.join(problems, KEYS, "left_anti")
    sums = edits.groupBy(*KEYS, "strategy").agg(
        F.count_distinct("edit_index").alias("edits"),
        F.sum(F.coalesce("savings", F.lit(0))).alias("_freed"),
        F.sum(F.coalesce("_added", F.lit(0))).alias("_added"),
        F.min("line_index").alias("first_line"),
    )
    plans = sums.join(sessions.select(*KEYS, "context_tokens"), KEYS).select(
        *KEYS,
        "strategy",
        F.col("context_tokens").alias("tokens_before"),
        (F.greatest(F.col("context_tokens") - F.col("_freed"), F.lit(0)) + F.col("_added")).alias(
            "tokens_after"
        ),
        "edits",
        "first_line",
    )
    if fallback is not None:
        others = fallback.join(calls.select(*KEYS).distinct(), KEYS, "left_anti")
        plans = plans.unionByName(
            others.withColumn("strategy", F.lit("agentic")).select(*plans.columns)
        )
    return Plans(plans, edits.drop("_added"))

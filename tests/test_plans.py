"""Planners with a state card against a plain loop over one session at a time."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.operators import ordered
from palimpsest.operators.totals import session_totals
from palimpsest.plans.base import prepare
from palimpsest.plans import card
from palimpsest.plans.card import parse_card, render_card
from palimpsest.plans.planners import STRATEGIES, plan_scored
from palimpsest.plans.policy import KEYS, Policy, with_policy
from palimpsest.sources.tables import ITEM_COLUMNS

POLICY = Policy(trigger_tokens=3_000, floor_tokens=1_500)
KEEP = 3
SCHEMA = (
    "provider string, session_id string, path string, line_index long, kind string, est_tokens long, "
    "elidable_bytes long, elidable_parts int, label string, summary string, uuid string, parent_uuid string, "
    "tool_use_ids array<string>, payload_sha256 string"
)


def sessions(seed=11):
    rng = random.Random(seed)
    tools = ["bash", "read_file", "zed", "Alpha", "mid", "grep", "kappa", "omega", "beta", "delta"]
    out = []
    for s in range(8):
        for line in range(60):
            kind = rng.choice(["tool_result"] * 3 + ["user", "assistant"])
            size = rng.randint(300, 900) if kind == "tool_result" else None
            words = rng.choice(["plain", "src/x.py", "error here", "TODO later", "é" * rng.randint(1, 40)])
            label = f"{rng.choice(tools)}({rng.randint(0, 3)})" if size else kind
            out.append((
                fixed.BRANCH, f"s{s}", "p", line, kind, (size or rng.randint(20, 200)) // 4 + 10, size, 1 if size else 0,
                label, f"{words} {line}" if rng.random() < 0.9 else None, None, None,
                [f"id{line}"] if size else [], str(rng.randint(0, 5)) if size and rng.random() < 0.9 else None,
            ))
    return out


def tokens(n):
    return max(-(-n // 4), 1)


def savings(item):
    return min(max(tokens(item[6]) - 24 * item[7], 0), item[5])


def card_tokens(items, chosen):
    """Size of the card for a set of lines, from the definition of a card."""
    rows = [i for i in items if i[3] in chosen]
    lists = {"e": [], "t": [], "f": []}
    for i in rows:
        text = i[9] if i[9] is not None else i[8]
        low = text.lower()
        group = "e" if any(m in low for m in fixed.ERROR_MARKERS) else "t" if any(m in low for m in fixed.OPEN_TASK_MARKERS) else "f"
        lists[group].append(text)
    names = sorted({i[8].split("(")[0].split(" ")[0].lower() for i in rows} - {""})[:8]
    users = [i[9] for i in items if i[4] == "user" and i[9] is not None and not i[9].startswith("<")]
    replies = [i[9] for i in items if i[4] == "assistant"]
    goal = users[-1] if users else None
    if goal is None:
        summary = f"{fixed.CARD_NAME} covering {len(chosen)} elided items"
    else:
        raw = goal.strip().encode()
        summary = goal.strip() if len(raw) <= 120 else raw[:117].decode(errors="ignore") + "..."
    texts = [goal, summary, replies[-1] if replies else None, f"provider: {items[0][0]}", *names]
    texts += [t for rows in lists.values() for t in rows[:8]]
    return tokens(64 + sum(len(t.encode()) for t in texts if t is not None))


def candidates(items, name):
    elig = [i for i in items if i[6]]
    free = elig[:-KEEP]
    if name == "compacted":
        return free
    if name == "cache_aware":
        return free[::-1]
    if name == "middle":
        return elig[KEEP:-KEEP]
    if name == "micro":
        groups = {}
        for i in elig:
            groups.setdefault(i[8].split("(")[0].lower(), []).append(i)
        return [i for i in elig if i not in groups[i[8].split("(")[0].lower()][-2:]]
    newest = {}
    for i in free:
        if i[13] is not None:
            newest[i[8], i[13]] = i[3]
    return [i for i in free if i[13] is not None and newest[i[8], i[13]] != i[3]]


def choice(lefts, costs, floor, one_by_one=False):
    """How many rows are taken, from the context left and the card's cost after 0, 1, 2, ... rows; None without any."""
    first = next((n for n, left in enumerate(lefts) if left <= floor), len(lefts) - 1)
    if first == 0:
        return None
    numbers = range(first, len(lefts))
    if one_by_one:
        return next((n for n in numbers if lefts[n] + costs[n] <= floor), len(lefts) - 1)
    now = first
    while lefts[now] + costs[now] > floor:
        room = max(floor - costs[now], 0)
        ahead = next((n for n in numbers if n >= now and lefts[n] <= room), len(lefts) - 1)
        if ahead == now:
            break
        now = ahead
    return now


def expected(items, name):
    context = sum(i[5] for i in items)
    todo = candidates(items, name)
    if context < POLICY.trigger_tokens:
        return None
    lefts = [max(context - sum(savings(i) for i in todo[:n]), 0) for n in range(len(todo) + 1)]
    costs = [card_tokens(items, {i[3] for i in todo[:n]}) for n in range(len(todo) + 1)]
    n = choice(lefts, costs, POLICY.floor_tokens)
    return None if n is None else (sorted(i[3] for i in todo[:n]), lefts[n] + costs[n])


@pytest.mark.parametrize("size", [3, ordered.BLOCK])
@pytest.mark.parametrize("one_by_one", [False, True])
def test_choice_in_any_order(spark, monkeypatch, one_by_one, size):
    """Rows in an order unlike that of their lines; floors from above the context to below any card."""
    monkeypatch.setattr(card, "block", lambda c: ordered.block(c, size))
    monkeypatch.setattr(card, "line_levels", lambda c: ordered.line_levels(c, size))
    rng = random.Random(size + one_by_one)
    scope, rows, want = [], [], {}
    for s in range(60):
        key, context, floor = (fixed.BRANCH, f"s{s}", "p"), rng.randint(500, 3000), rng.choice([10, 60, 100, 200, 400, 1000, 4000])
        goal, work = rng.choice([None, "g", " goal " * 40]), rng.choice([None, "w" * 50])
        lines = rng.sample(range(1000), rng.randint(1, 45))
        told = [(n, rng.randint(0, 120), rng.choice(["", None, "a", "bb", "ccc", *[f"tool{i}" for i in range(12)]]), rng.choice(card.LISTS[:3]), rng.choice([None, "x" * rng.randint(1, 60), "é" * 9])) for n in lines]
        lefts, costs, left = [context], [], context
        for n in range(len(told) + 1):
            texts = [t[4] for c in card.LISTS for t in sorted((t for t in told[:n] if t[3] == c), key=lambda t: t[0])[:8]]
            names = sorted({t[2] for t in told[:n]} - {"", None})[:8]
            raw = (goal or "").strip().encode()
            summary = (goal.strip() if len(raw) <= 120 else raw[:117].decode(errors="ignore") + "...") if goal else f"{fixed.CARD_NAME} covering {n} elided items"
            costs.append(tokens(64 + sum(len(t.encode()) for t in [goal, summary, work, f"provider: {key[0]}", *texts, *names] if t)))
            if n < len(told):
                rows.append((*key, *told[n][:3], told[n][3], told[n][4], left, n))
                left = max(left - told[n][1], 0)
                lefts.append(left)
        scope.append((*key, context, floor, goal, work))
        n = choice(lefts, costs, floor, one_by_one)
        if n is not None:
            want[key[1]] = (lefts[n] + costs[n], costs[n], n, sorted(t[0] for t in told[:n]))
    ranked = spark.createDataFrame(rows, "provider string, session_id string, path string, line_index long, savings long, tool string, card_class string, text string, remaining long, place long")
    sessions = spark.createDataFrame(scope, "provider string, session_id string, path string, context_tokens long, floor_tokens long, goal string, current_work string")
    plans, edits = card.choose_with_card("any", ranked.repartition(3), sessions, one_by_one=one_by_one)
    assert "FlatMapGroups" not in plans._jdf.queryExecution().toString()
    lines = {}
    for r in edits.collect():
        lines.setdefault(r.session_id, []).append(r.line_index)
    got = {r.session_id: (r.tokens_after, r.overhead, r.edits, sorted(lines[r.session_id])) for r in plans.collect()}
    assert got == want and 20 < len(want) < 60


@pytest.fixture(scope="module")
def prepared(spark):
    items = spark.createDataFrame(sessions(), SCHEMA).select(*ITEM_COLUMNS).repartition(3)
    return prepare(items, with_policy(session_totals(items), POLICY), KEEP)


@pytest.mark.parametrize("name", ["compacted", "cache_aware", "dedupe", "micro", "middle"])
def test_card_planner(prepared, name):
    plans, edits = STRATEGIES[name](prepared)
    after = {r.session_id: r.tokens_after for r in plans.collect()}
    lines = {}
    for r in edits.collect():
        lines.setdefault(r.session_id, []).append(r.line_index)
    data = sessions()
    for s in sorted({d[1] for d in data}):
        want = expected([d for d in data if d[1] == s], name)
        got = (sorted(lines[s]), after[s]) if s in lines else None
        assert got == want, (name, s)


def test_column_keep_equals_fixed_keep(spark, prepared):
    items = prepared.items
    ses = with_policy(session_totals(items), Policy(trigger_tokens=3_000, floor_tokens=1_500, keep_recent_tool_outputs=KEEP))
    other = prepare(items, ses, None)
    a = {tuple(r) for r in prepared.unprotected.select("session_id", "line_index").collect()}
    b = {tuple(r) for r in other.unprotected.select("session_id", "line_index").collect()}
    assert a == b and a


def test_scored_cutoff_keeps_missing_scores(prepared):
    some = prepared.unprotected.filter(F.col("line_index") % 2 == 0)
    scores = some.select(*KEYS, "line_index", F.lit(0.1).alias("keep_probability"))
    _plans, edits = plan_scored(prepared, scores, 0.5)
    assert edits.filter(F.col("line_index") % 2 == 1).count() == 0
    assert edits.count() > 0


def test_card_round_trip(prepared):
    plans = STRATEGIES["compacted"](prepared).plans.filter(~F.col("card.goal").contains("\n"))
    again = plans.select("card", parse_card(render_card("card")).alias("back")).collect()
    assert again
    for r in again:
        assert r.card.asDict(True) == r.back.asDict(True)


def test_newest_k_is_limited_before_the_shuffle(spark, prepared):
    from palimpsest.operators.ordered import newest

    top = newest(prepared.elidable, KEYS, [F.col("line_index").desc()], 8)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan

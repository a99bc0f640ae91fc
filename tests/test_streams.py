"""Response events and keyed streams against plain sequential rules, on random input in any order."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.monitor import monitor_deltas
from palimpsest.sources import responses
from palimpsest.streaming import keyed

EVENTS = "attempt string, seq long, dialect string, streamed boolean, raw string"
LARGEST = 10**12


# Response events


def counters(rng):
    return rng.choice([0, 1, 5, 9, 40, 100, LARGEST, LARGEST + 1, -1, 2.5, "7", None, True, [1]])


def maybe(rng, **fields):
    return {k: x() if callable(x) else x for k, x in fields.items() if rng.random() < 0.6}


def anthropic(rng):
    usage = maybe(rng, input_tokens=lambda: counters(rng), output_tokens=lambda: counters(rng), cache_read_input_tokens=lambda: counters(rng), cache_creation_input_tokens=lambda: counters(rng))
    tool = {"type": rng.choice(["tool_use", "server_tool_use", "text"]), "id": rng.choice(["t1", "t2", "", "x" * 513, 5]), "name": rng.choice(["read", "bad name", None, "a..b", "run"])}
    return rng.choice([
        {"type": "message_start", "message": {"usage": usage}}, {"type": "message_delta", "usage": usage, "delta": {"stop_reason": rng.choice(["end_turn", "refusal"])}},
        {"type": "content_block_start", "content_block": tool}, {"type": "message_stop"}, {"type": "ping"}, {"usage": rng.choice([usage, None, 3])},
        {"type": "message", "content": [tool, {"type": "text"}], "stop_reason": rng.choice(["tool_use", ""]), "usage": usage}, {"type": "error"}, {"error": rng.choice([None, {}, "x"])},
    ])


def openai(rng):
    usage = maybe(rng, input_tokens=lambda: counters(rng), output_tokens=lambda: counters(rng), input_tokens_details=lambda: {"cached_tokens": counters(rng)}, output_tokens_details=lambda: {"reasoning_tokens": counters(rng)})
    call = maybe(rng, call_id=lambda: rng.choice(["c1", "c2", None]), id=lambda: rng.choice(["c3", ""]), name=lambda: rng.choice(["get", "no good", "put"])) | {"type": rng.choice(["function_call", "custom_tool_call", "message"])}
    refusal = {"type": "message", "content": [{"type": rng.choice(["refusal", "output_text"])}]}
    return rng.choice([
        {"type": "response.created", "response": {"status": "in_progress"}}, {"type": "response.completed", "response": {"usage": usage, "output": rng.choice([[call, refusal], None])}},
        {"type": "response.output_item.added", "item": call}, {"type": "response.output_item.done", "item": rng.choice([call, None])}, {"type": "response.incomplete"},
        {"object": "response", "status": rng.choice(["completed", "failed"]), "usage": usage, "output": [call]}, {"type": "response.refusal.delta", "delta": rng.choice(["", "no"])},
        {"usage": usage}, {"response": {"error": rng.choice([None, 1])}}, {"type": "other"},
    ])


def chat(rng):
    usage = maybe(rng, prompt_tokens=lambda: counters(rng), completion_tokens=lambda: counters(rng), prompt_tokens_details=lambda: {"cached_tokens": counters(rng)}, completion_tokens_details=lambda: {"reasoning_tokens": counters(rng)})
    part = maybe(rng, index=lambda: rng.choice([0, 1, -1]), id=lambda: rng.choice(["p1", "p2", ""]), function=lambda: maybe(rng, name=lambda: rng.choice(["lo", "ok", "", "x" * 70, " "])))
    whole = {"id": rng.choice(["w1", "p1", None]), "function": {"name": rng.choice(["find", "?", None])}}
    choice = maybe(rng, index=lambda: rng.choice([0, 1]), delta=lambda: maybe(rng, tool_calls=lambda: [part, part], refusal=lambda: rng.choice(["", "no"])), message=lambda: maybe(rng, tool_calls=lambda: [whole]), finish_reason=lambda: rng.choice(["stop", "content_filter", "", None]))
    return maybe(rng, choices=lambda: rng.choice([[choice], [choice, choice], []]), object=lambda: rng.choice(["chat.completion", "chat.completion.chunk", "x"]), usage=lambda: rng.choice([usage, usage, None]))


MAKERS = {"anthropic": anthropic, "responses": openai, "chat_completions": chat}


def at(value, *path):
    """(found, value) at a path of keys."""
    for p in path:
        if not isinstance(value, dict) or p not in value:
            return False, None
        value = value[p]
    return True, value


def whole_number(x):
    return x if isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= LARGEST else None


def fold_usage(dialect, events):
    """One event after the other, as a reader of the stream would count."""
    state = {}
    places = {
        "anthropic": {"output": ["output_tokens"]},
        "responses": {"input": ["input_tokens"], "output": ["output_tokens"], "read": ["input_tokens_details", "cached_tokens"], "reasoning": ["output_tokens_details", "reasoning_tokens"]},
        "chat_completions": {"input": ["prompt_tokens"], "output": ["completion_tokens"], "read": ["prompt_tokens_details", "cached_tokens"], "reasoning": ["completion_tokens_details", "reasoning_tokens"]},
    }[dialect]
    for e in events:
        if not isinstance(e, dict):
            continue
        inner = {"anthropic": at(e, "message", "usage"), "responses": at(e, "response", "usage"), "chat_completions": (False, None)}[dialect]
        found, usage = inner if inner[0] else at(e, "usage")
        if not found:
            continue
        if isinstance(usage, dict):
            if dialect == "anthropic":
                bad = False
                for f, k in (("read", "cache_read_input_tokens"), ("write", "cache_creation_input_tokens")):
                    if k in usage:
                        state[f] = whole_number(usage[k])
                        bad |= state[f] is None
                if "input_tokens" in usage:
                    n = whole_number(usage["input_tokens"])
                    total = None if n is None or bad else n + (state.get("read") or 0) + (state.get("write") or 0)
                    state["input"] = whole_number(total)
            for f, path in places.items():
                have, x = at(usage, *path)
                if have:
                    state[f] = whole_number(x)
            i, o, r, w, g = (state.get(f) for f in ("input", "output", "read", "write", "reasoning"))
            above = lambda part, all_: part is not None and all_ is not None and part > all_
            if above(g, o) or above(r, i) or above(w, i) or (None not in (i, r, w) and r + w > i):
                state = {}
        if dialect == "anthropic" and e.get("type") == "message_start":
            state["output"] = None
    out = tuple(state.get(f) for f in ("input", "output", "read", "write", "reasoning"))
    return out if any(x is not None for x in out) else None


def label(x):
    ok = isinstance(x, str) and 0 < len(x.encode()) <= 128 and all(c.isascii() and (c.isalnum() or c in "_.:-/") for c in x)
    return x if ok and ".." not in x and not x.startswith("/") else None


def fold_tools(dialect, streamed, events):
    whole, parts = {}, {}

    def add(found_id, name):
        if isinstance(found_id, str) and 0 < len(found_id.encode()) <= 512:
            whole[found_id] = label(name) or whole.get(found_id)

    def rows(x):
        return [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []

    for e in events:
        if not isinstance(e, dict):
            continue
        kind = e.get("type")
        if dialect == "anthropic":
            items = ([e.get("content_block")] if kind == "content_block_start" else []) + (e.get("content") or [] if not streamed else [])
            for i in rows(items):
                if i.get("type") in ("tool_use", "server_tool_use"):
                    add(i.get("id"), i.get("name"))
        elif dialect == "responses":
            found, output = at(e, "response", "output")
            items = ([e.get("item")] if kind in ("response.output_item.added", "response.output_item.done") else []) + rows(output if found else e.get("output"))
            for i in rows(items):
                if i.get("type") in ("function_call", "custom_tool_call"):
                    add(i["call_id"] if "call_id" in i else i.get("id"), i.get("name"))
        else:
            for place, c in enumerate(e.get("choices") or []):
                for t in rows(at(c, "message", "tool_calls")[1]):
                    add(t.get("id"), at(t, "function", "name")[1])
                for t in rows(at(c, "delta", "tool_calls")[1]):
                    if whole_number(t.get("index")) is None:
                        continue
                    one = parts.setdefault((c.get("index", place), t["index"]), [None, ""])
                    if isinstance(t.get("id"), str) and t["id"]:
                        one[0] = t["id"]
                    one[1] += at(t, "function", "name")[1] or ""
    for _, (found_id, name) in sorted(parts.items()):
        if found_id is not None:
            whole.setdefault(found_id, label(name))
    return whole


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(17)
    told = {}
    for n in range(600):
        dialect = rng.choice(list(MAKERS))
        lines = [json.dumps(MAKERS[dialect](rng)) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["[DONE]", "not json", "[1]", "", None, "3"]))
        told[f"a{n}"] = (dialect, rng.random() < 0.7, lines)
    rows = [(a, i * 3, d, s, line) for a, (d, s, lines) in told.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    return told, spark.createDataFrame(rows, EVENTS).repartition(4).cache()


def read(line):
    try:
        return json.loads(line or "")
    except ValueError:
        return None


@pytest.mark.parametrize("block", [2, 8192])
def test_usage(streams, block):
    told, events = streams
    want = {a: u for a, (d, _, lines) in told.items() if (u := fold_usage(d, map(read, lines))) is not None}
    got = {r["attempt"]: tuple(r[f] for f in responses.FIELDS) for r in responses.stream_usage(events, ["attempt"], block).collect()}
    assert got == want and len(want) > 150


def test_tools(streams):
    told, events = streams
    want = {(a, t, name) for a, (d, s, lines) in told.items() for t, name in fold_tools(d, s, map(read, lines)).items()}
    got = responses.stream_tools(events, ["attempt"]).collect()
    assert {(r["attempt"], r["tool_id"], r["tool_name"]) for r in got} == want and len(got) == len(want) > 100


def test_parts_of_a_name(spark):
    def line(index, tool_id=None, name=None):
        call = {"index": index} | ({"id": tool_id} if tool_id else {}) | ({"function": {"name": name}} if name is not None else {})
        return json.dumps({"choices": [{"index": 0, "delta": {"tool_calls": [call]}}]})

    lines = [line(0, "a"), line(0, name="re"), line(1, "b", "x" * 100), line(0, name="ad"), line(1, name="y" * 29), line(2, name="lost"), line(3, "c"), line(4, "a", "later"), line(5, "d", "n" * 128)]
    rows = [("s", i, "chat_completions", True, x) for i, x in enumerate(lines)]
    rows += [("long", i, "chat_completions", True, line(0, "z" if i == 0 else None, "")) for i in range(500)] + [("long", 600, "chat_completions", True, line(0, None, "end"))]
    got = {(r["attempt"], r["tool_id"]): r["tool_name"] for r in responses.stream_tools(spark.createDataFrame(rows, EVENTS).repartition(5), ["attempt"]).collect()}
    assert got == {("s", "a"): "read", ("s", "b"): None, ("s", "c"): None, ("s", "d"): "n" * 128, ("long", "z"): "end"}


def test_ends(spark):
    def one(name, dialect, streamed, *lines):
        return name, [(name, i, dialect, streamed, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(lines)]

    cases = {
        "completed": [one("a1", "anthropic", True, {"type": "message_start"}, {"type": "message_stop"}), one("a2", "chat_completions", True, {"choices": []}, "[DONE]"),
                      one("a3", "anthropic", False, {"type": "message", "content": [], "stop_reason": "end_turn"}), one("a4", "responses", False, {"object": "response", "status": "completed"}),
                      one("a5", "chat_completions", False, {"object": "chat.completion", "choices": [{"finish_reason": "stop"}]})],
        "missing_terminal": [one("b1", "anthropic", True, {"type": "ping"}), one("b2", "chat_completions", True, {"object": "chat.completion", "choices": [{"finish_reason": "stop"}]}),
                             one("b3", "responses", True, {"type": "response.created"}), one("b4", "chat_completions", False, {"object": "chat.completion", "choices": [{"finish_reason": ""}]})],
        "parser_uncertain": [one("c1", "anthropic", True, "{", {"type": "message_stop"}), one("c2", "responses", True, {"type": "response.completed"}, "[DONE]"), one("c3", "responses", True, {"a": 1}), one("c4", "anthropic", False, None)],
        "provider_refused": [one("d1", "anthropic", True, {"delta": {"stop_reason": "refusal"}}, "{"), one("d2", "responses", True, {"type": "response.refusal.done", "refusal": "no"}),
                             one("d3", "chat_completions", True, {"choices": [{"delta": {"refusal": "no"}}]}), one("d4", "responses", True, {"output": [{"content": [{"type": "refusal"}]}]})],
        "provider_error": [one("e1", "responses", True, {"type": "response.failed"}), one("e2", "anthropic", True, {"stop_reason": "refusal"}, {"error": {}}), one("e3", "responses", True, {"response": {"status": "cancelled"}})],
    }
    rows = [r for some in cases.values() for _, rs in some for r in rs]
    got = {r["attempt"]: r["reason"] for r in responses.stream_end(spark.createDataFrame(rows, EVENTS).repartition(3), ["attempt"]).collect()}
    assert got == {name: reason for reason, some in cases.items() for name, _ in some}


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    assert responses.stream_usage(none, ["attempt"]).isEmpty() and responses.stream_tools(none, ["attempt"]).isEmpty() and responses.stream_end(none, ["attempt"]).isEmpty()


# Keyed streams


def arrive(spark, rows, schema, rng, parts=4):
    """Rows in files: shuffled in each, every fifth one file late."""
    size = -(-len(rows) // parts)
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    late = [[r for r in f if rng.random() < 0.2] if i + 1 < len(files) else [] for i, f in enumerate(files)]
    files = [[r for r in f if r not in late[i]] + (late[i - 1] if i else []) for i, f in enumerate(files)]
    for f in files:
        rng.shuffle(f)
    return files


def replay(spark, make, files, schema, delay):
    """The stream over the files, stopped after half of them and started again; a last row far ahead lets all others pass."""
    keyed.use_state_store(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = make(source, delay).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i == len(files) // 2:
            run()
    ahead = max(r[2] for f in files for r in f) + 30 * 86_400_000
    spark.createDataFrame([("end", "end", ahead, 0) + (None,) * (len(files[0][0]) - 4)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    return spark.read.parquet(f"{folder}/out")


LOG = (
    "provider string, session_id string, at_ms long, seq long, kind string, fingerprint string, until_secs long, reported_context long, "
    "effective_trigger long, apply_hold_secs long, min_interval_secs long"
)


def test_watch_stream_equals_the_table(spark):
    rng = random.Random(3)
    rows, now = [], 1_700_000_000_000
    for i in range(1200):
        now += rng.choice([0, 1000, rng.randint(0, 500_000), 3_000_000 if i % 50 == 0 else 7])
        kind = rng.choice(["pass"] * 4 + keyed.OUTCOMES)
        rows.append((
            "p", f"s{rng.randint(0, 6)}" if i < 900 else "s7", now + (90_000_000 if i > 1000 else 0), i, kind, rng.choice(["a", "b", None]),
            now // 1000 + rng.randint(0, 9000) if kind == "held" else None, rng.choice([None, 10, 100, 200]), rng.choice([None, 50, 150]),
            rng.choice([None, 600, 200_000]), rng.choice([None, 600, 200_000]),
        ))
    df = spark.createDataFrame(rows, LOG)
    for size in (3_600_000, 10**15):
        levels = [F.floor(F.col("at_ms") / size), F.struct("at_ms", "seq")]
        want = {(r["session_id"], r["seq"]): r["decision"] for r in keyed.watch_passes(df, levels).collect()}
        state, plain = {}, {}
        for r in rows:
            s = state.setdefault(r[1], dict.fromkeys(keyed.WatchProcessor.state.names))
            out = keyed.WatchProcessor.step(None, s, dict(zip(LOG.replace(",", "").split()[::2], r)))
            if out:
                plain[r[1], r[3]] = out["decision"]
        assert want == plain
    assert set(want.values()) == {"settled", "cooldown", "below_trigger", "evaluate"}
    got = replay(spark, keyed.watch_stream, arrive(spark, rows, LOG, rng), LOG, "4 days").collect()
    assert len(got) == len(want) and {(r["session_id"], r["seq"]): r["decision"] for r in got} == want


def test_a_day_without_rows_ends_the_state(spark):
    def seen(names):
        return dict.fromkeys(names)

    state = seen(keyed.WatchProcessor.state.names)
    step = lambda at, kind, **more: keyed.WatchProcessor.step(None, state, {"at_ms": at * 1000, "seq": 0, "kind": kind, **dict.fromkeys(["fingerprint", "until_secs", *keyed._PASS[1:]]), **more})
    step(10, "settled", fingerprint="f")
    assert step(10 + 86_400, "pass", fingerprint="f")["decision"] == "settled"
    assert step(11 + 86_400, "pass", fingerprint="f")["decision"] == "evaluate"


SAMPLES = "provider string, session_id string, at_ms long, seq long, source_identity_sha256 string, context_state string, context_tokens long, native_applied long"


def test_monitor_stream_equals_the_table(spark):
    rng = random.Random(8)
    rows, now = [], 1_700_000_000_000
    for i in range(1000):
        now += rng.randint(0, 400_000)
        rows.append((rng.choice(["codex", "claude_code"]), f"s{rng.randint(0, 5)}", now, i, rng.choice(["x", "x", "x", "y", None]), rng.choice(["reported", "reported", "unknown"]), rng.choice([None, 0, 50, 80, 120]), rng.choice([None, 1, 2, 3, 4])))
    df = spark.createDataFrame(rows, SAMPLES)
    want = monitor_deltas(df, [F.floor(F.col("at_ms") / 3_600_000), F.struct("at_ms", "seq")])
    got = replay(spark, keyed.monitor_stream, arrive(spark, rows, SAMPLES, rng), SAMPLES, "4 days")
    names = ["provider", "session_id", "seq", "context_tokens", "context_drop_tokens", "native_applied_delta", "native_counter_reset"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    assert want.filter("native_counter_reset").count() > 20
    buckets = lambda d: sorted(map(str, keyed.monitor_series(d, "6 hours").collect()))
    assert buckets(got) == buckets(want) and len(buckets(got)) > 4

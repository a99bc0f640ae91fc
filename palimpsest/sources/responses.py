"""What a provider's response says about itself, from its events in three dialects.

``events``: the keys of an attempt, ``seq`` (order in the attempt, unique), ``dialect`` (anthropic, responses, chat_completions), ``streamed``
(whether the response came as events, or as one whole body) and ``raw``, the event's text. An event may stand anywhere in any file or
batch; only its ``seq`` counts. Text that is no JSON object makes an attempt's parse doubtful and says nothing else.

An attempt may hold any number of events: marks and tool calls are aggregates with partial merge, and counters are carried
forward block by block, so no attempt needs to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.functions.text import safe_label
from palimpsest.operators.ordered import last_known, line_levels, once
from palimpsest.session import cut
from palimpsest.sources.observations import completion_reason

FIELDS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
_ANY = "cast(array() as array<variant>)"


def _parsed(events: DataFrame) -> DataFrame:
    return once(events, "_e", F.try_parse_json("raw"))


def _list(value: Column, path: str) -> Column:
    return F.coalesce(v.items(value, path), F.expr(_ANY))


def _said(value: Column, path: str) -> Column:
    """Whether a path holds a string that is not empty."""
    return F.coalesce(v.string(value, path) != "", F.lit(False))


def _is(value: Column, path: str, *words: str) -> Column:
    return F.coalesce(v.string(value, path).isin(*words), F.lit(False))


def _array_at(value: Column, path: str) -> Column:
    return v.items(value, path).isNotNull()


def _by_dialect(anthropic: Column, responses: Column, chat: Column) -> Column:
    return F.when(F.col("dialect") == "anthropic", anthropic).when(F.col("dialect") == "responses", responses).when(F.col("dialect") == "chat_completions", chat)


def _output(e: Column) -> Column:
    """Output items of a whole response; the enclosed response goes first."""
    return F.coalesce(v.items(e, "$.response.output"), F.when(v.get(e, "$.response.output").isNull(), v.items(e, "$.output")), F.expr(_ANY))


def event_marks(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, seq and what each event says of the end: failed, refused, uncertain, terminal, protocol."""
    e = F.col("_e")
    kind = F.coalesce(v.string(e, "$.type"), F.lit(""))
    choices = _list(e, "$.choices")
    protocol = _by_dialect(
        kind.isin(*fixed.ANTHROPIC_EVENTS),
        kind.startswith("response.") | (kind == "error") | _is(e, "$.object", "response"),
        _array_at(e, "$.choices") | _is(e, "$.object", "chat.completion", "chat.completion.chunk"),
    )
    refusal_item = F.exists(_output(e), lambda i: F.exists(_list(i, "$.content"), lambda b: _is(b, "$.type", "refusal")))
    refused = _by_dialect(
        F.when(v.get(e, "$.stop_reason").isNotNull(), _is(e, "$.stop_reason", "refusal")).otherwise(_is(e, "$.delta.stop_reason", "refusal")),
        (kind.isin("response.refusal.delta", "response.refusal.done") & (_said(e, "$.delta") | _said(e, "$.refusal"))) | refusal_item,
        F.exists(choices, lambda c: _is(c, "$.finish_reason", "content_filter") | _said(c, "$.delta.refusal") | _said(c, "$.message.refusal")),
    )

    def broken(path: str) -> Column:
        error = v.get(e, f"{path}.error")
        return (error.isNotNull() & ~F.is_variant_null(error)) | _is(e, f"{path}.status", *fixed.FAILED_STATUS)

    failed = kind.isin("error", "response.failed", "response.incomplete") | broken("$") | broken("$.response")
    whole = _by_dialect(
        (kind == "message") & _array_at(e, "$.content") & _said(e, "$.stop_reason"),
        _is(e, "$.object", "response") & _is(e, "$.status", "completed"),
        _is(e, "$.object", "chat.completion") & (F.size(choices) > 0) & F.forall(choices, lambda c: _said(c, "$.finish_reason")),
    )
    terminal = failed | kind.isin("message_stop", "response.completed", "response.done") | (~F.col("streamed") & whole)
    end = F.coalesce(F.col("streamed") & (F.trim("raw") == "[DONE]"), F.lit(False))
    chat_end = end & (F.col("dialect") == "chat_completions")
    seen = v.is_object(e)

    def mark(value: Column) -> Column:
        return F.coalesce(seen & value, F.lit(False))

    return _parsed(events).select(
        *keys, "seq", mark(failed).alias("failed"), mark(refused).alias("refused"), (~seen & ~chat_end).alias("uncertain"),
        (mark(terminal) | chat_end).alias("terminal"), (mark(protocol) | chat_end).alias("protocol"),
    )


def stream_end(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and finish reason of each attempt."""
    return completion_reason(event_marks(events, keys), list(keys))


# Usage


def _counter(value: Column) -> Column:
    """A whole number from 0 to the largest counter."""
    n = v.count(value, "$")
    return F.when(n <= fixed.MAX_COUNTER, n)


def _usage_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each event with a usage object; a field that it sets is a struct, whose value is null where it is invalid."""
    e = F.col("_e")
    nested = lambda path: F.coalesce(v.get(e, path), v.get(e, "$.usage"))
    rows = _parsed(events).filter(v.is_object(F.col("_e")))
    rows = once(rows, "_u", _by_dialect(nested("$.message.usage"), nested("$.response.usage"), v.get(e, "$.usage"))).filter(F.col("_u").isNotNull())
    u = F.col("_u")
    says = v.is_object(u)
    # Where each dialect keeps its counters.
    paths = {
        "input": ("$.input_tokens", "$.input_tokens", "$.prompt_tokens"),
        "output": ("$.output_tokens", "$.output_tokens", "$.completion_tokens"),
        "read": ("$.cache_read_input_tokens", "$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens"),
        "write": ("$.cache_creation_input_tokens", None, None),
        "reasoning": (None, "$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens"),
    }
    nothing = F.lit(None).cast("variant")
    found = {name: _by_dialect(*[v.get(u, p) if p else nothing for p in three]) for name, three in paths.items()}
    sets = {f"_{n}": F.when(says & x.isNotNull(), F.struct(_counter(x).alias("n"))) for n, x in found.items()}
    first = (F.col("dialect") == "anthropic") & F.coalesce(v.string(e, "$.type") == "message_start", F.lit(False))
    return rows.select(*keys, "seq", (F.col("dialect") == "anthropic").alias("_adds"), first.alias("_first"), *[c.alias(n) for n, c in sets.items()])


def _states(rows: DataFrame, keys: Sequence[str], levels) -> DataFrame:
    """The counters as they stand after each event, if none before it was at odds."""
    given = {n: F.col(f"_{n}") for n in ("read", "write")}
    rows = last_known(rows, keys, levels, {"_r": given["read"], "_w": given["write"]})
    bad = F.coalesce(F.col("_read").isNotNull() & F.col("_read.n").isNull(), F.lit(False)) | F.coalesce(F.col("_write").isNotNull() & F.col("_write.n").isNull(), F.lit(False))
    total = F.col("_input.n") + F.coalesce("_r.n", F.lit(0)) + F.coalesce("_w.n", F.lit(0))
    added = F.when(~bad & (total <= fixed.MAX_COUNTER), total)
    value = F.when(F.col("_adds"), added).otherwise(F.col("_input.n"))
    rows = rows.withColumn("_input", F.when(F.col("_input").isNotNull(), F.struct(value.alias("n"))))
    # The first event's output counter is a placeholder: it counts as unknown, whatever it says.
    output = F.when(F.col("_first"), F.struct(F.lit(None).cast("long").alias("n"))).otherwise(F.col("_output"))
    return last_known(rows, keys, levels, {"_i": F.col("_input"), "_o": output, "_g": F.col("_reasoning")})


def _at_odds(i: Column, o: Column, r: Column, w: Column, g: Column) -> Column:
    """A part above its whole."""
    return F.coalesce(g > o, F.lit(False)) | F.coalesce(r > i, F.lit(False)) | F.coalesce(w > i, F.lit(False)) | F.coalesce(r + w > i, F.lit(False))


def stream_usage(events: DataFrame, keys: Sequence[str], block: int = 8192) -> DataFrame:
    """Keys and the five counters of each attempt whose events tell any; null: unknown.

    A later value takes an earlier one's place, an invalid one makes its field unknown, and a state in which a part is above its
    whole is forgotten with all before it. An event whose own counters are at odds is forgotten with all before it whatever came before, so
    one aggregate finds the last of those; each further round takes the first event of an attempt that only
    earlier ones put at odds, until there is none. Rounds: one more than the most such events of any attempt.
    """
    keys = list(keys)
    rows = _usage_events(events, keys)
    own = _at_odds(F.when(~F.col("_adds"), F.col("_input.n")), F.when(~F.col("_first"), F.col("_output.n")), F.col("_read.n"), F.col("_write.n"), F.col("_reasoning.n"))
    rows = cut(rows.withColumn("_own", own), "usage")
    stale = rows.filter("_own").groupBy(*keys).agg(F.max("seq").alias("_from"))
    levels = line_levels("seq", block)
    while True:
        rest = rows.join(stale, keys, "left").filter(F.col("_from").isNull() | (F.col("seq") > F.col("_from"))).drop("_from")
        states = cut(_states(rest, keys, levels), "usage-states")
        odd = states.filter(_at_odds(*[F.col(f"{n}.n") for n in ("_i", "_o", "_r", "_w", "_g")]))
        more = cut(odd.groupBy(*keys).agg(F.min("seq").alias("_from")), "usage-odd")
        if more.isEmpty():
            break
        stale = cut(stale.unionByName(more).groupBy(*keys).agg(F.max("_from").alias("_from")), "usage-stale")
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"{n}.n").alias(f) for n, f in zip(("_i", "_o", "_r", "_w", "_g"), FIELDS)]), "seq").alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{f}").alias(f) for f in FIELDS]).filter(F.coalesce(*FIELDS).isNotNull())


# Tools


def _tool(item: Column, at: Column, *ids: str, name: str = "$.name") -> Column:
    id_ = F.coalesce(*[F.when(v.get(item, p).isNotNull(), F.coalesce(v.string(item, p), F.lit(""))) for p in ids])
    return F.struct(at.alias("at"), F.when((id_ != "") & (F.octet_length(id_) <= fixed.MAX_TOOL_ID_BYTES), id_).alias("tool_id"), v.string(item, name).alias("name"))


def _whole_calls(e: Column) -> Column:
    """Calls that an event names whole: (at, tool_id, name)."""
    kind = F.coalesce(v.string(e, "$.type"), F.lit(""))
    one = lambda path: F.when(v.get(e, path).isNotNull(), F.array(v.get(e, path))).otherwise(F.expr(_ANY))
    blocks = F.concat(F.when(kind == "content_block_start", one("$.content_block")).otherwise(F.expr(_ANY)), F.when(~F.col("streamed"), _list(e, "$.content")).otherwise(F.expr(_ANY)))
    items = F.concat(F.when(kind.isin("response.output_item.added", "response.output_item.done"), one("$.item")).otherwise(F.expr(_ANY)), _output(e))
    calls = F.flatten(F.transform(_list(e, "$.choices"), lambda c: _list(c, "$.message.tool_calls")))
    return _by_dialect(
        F.transform(F.filter(blocks, lambda b: _is(b, "$.type", "tool_use", "server_tool_use")), lambda b, i: _tool(b, i, "$.id")),
        F.transform(F.filter(items, lambda b: _is(b, "$.type", "function_call", "custom_tool_call")), lambda b, i: _tool(b, i, "$.call_id", "$.id")),
        F.transform(calls, lambda b, i: _tool(b, i, "$.id", name="$.function.name")),
    )


def _fragments(e: Column) -> Column:
    """Parts of calls that are told by number: (choice, call, at, tool_id, part)."""
    def of(choice: Column, place: Column) -> Column:
        number = F.coalesce(v.count(choice, "$.index"), place.cast("long"))
        told = F.transform(_list(choice, "$.delta.tool_calls"), lambda c, i: F.struct(
            number.alias("choice"), v.count(c, "$.index").alias("call"), F.struct(place.alias("choice"), i.alias("call")).alias("at"),
            _tool(c, i, "$.id")["tool_id"].alias("tool_id"), v.string(c, "$.function.name").alias("part"),
        ))
        return F.filter(told, lambda x: x["call"].isNotNull())

    return F.flatten(F.transform(_list(e, "$.choices"), of))


def stream_tools(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, tool_id and tool_name (null: unknown) of each tool call that an attempt's events request.

    Of a call named whole more than once, the last fit name counts. A call that comes in parts under its number has the last id told,
    and the name that its parts make in order; over 128 bytes it has none. A whole call goes before parts of the same id.
    """
    keys = list(keys)
    rows = cut(_parsed(events).filter(v.is_object(F.col("_e"))).select(
        *keys, "seq", _whole_calls(F.col("_e")).alias("_whole"), F.when(F.col("dialect") == "chat_completions", _fragments(F.col("_e"))).alias("_parts")
    ).filter((F.size("_whole") > 0) | (F.size("_parts") > 0)), "calls")
    whole = rows.select(*keys, "seq", F.explode("_whole").alias("c")).filter("c.tool_id is not null")
    name = F.when(safe_label(F.col("c.name")), F.col("c.name"))
    whole = whole.groupBy(*keys, F.col("c.tool_id").alias("tool_id")).agg(
        F.max_by(name, F.when(name.isNotNull(), F.struct("seq", "c.at"))).alias("tool_name")
    )
    parts = rows.select(*keys, "seq", F.explode("_parts").alias("p")).select(*keys, "seq", "p.*")
    call = [*keys, "choice", "call"]
    size = F.coalesce(F.sum(F.octet_length("part")), F.lit(0))
    made = parts.groupBy(*call).agg(size.alias("_size"), F.max_by("tool_id", F.when(F.col("tool_id").isNotNull(), F.struct("seq", "at"))).alias("tool_id"))
    # Parts of a fit name hold a byte at least, so no more than 128 of them meet in one row.
    fit = made.filter((F.col("_size") > 0) & (F.col("_size") <= fixed.MAX_LABEL_BYTES)).select(*call)
    spelt = parts.filter("part <> ''").join(fit, call).groupBy(*call).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "part"))).alias("_p"))
    spelt = spelt.select(*call, F.array_join("_p.part", "").alias("_name"))
    named = made.filter("tool_id is not null").join(spelt, call, "left").withColumn("_name", F.when(safe_label(F.col("_name")), F.col("_name")))
    told = named.groupBy(*keys, "tool_id").agg(F.min(F.struct("choice", "call", F.col("_name").alias("n"))).alias("_m"))
    told = told.select(*keys, "tool_id", F.col("_m.n").alias("tool_name"))
    return whole.unionByName(told.join(whole.select(*keys, "tool_id"), [*keys, "tool_id"], "left_anti"))

"""Queries of response events and of keyed streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.catalog.requesting import E, events, samples
from palimpsest.operators import billing
from palimpsest.operators import monitor as mo
from palimpsest.session import checkpoint_dir
from palimpsest.sources import responses
from palimpsest.sources.tables import table
from palimpsest.streaming import keyed

# Response events: a user's events with the same k % 4 are one attempt. The texts below are the input of Spark and DuckDB alike.
_N = "CAST(CAST(round(value) AS BIGINT) AS STRING)"
_K = "CAST({} AS STRING)"
RAW = f"""CASE WHEN k % 29 = 0 THEN 'no json' WHEN user_id % 3 = 0 THEN CASE event_type
  WHEN 'view' THEN '{{"type":"message_start","message":{{"usage":{{"input_tokens":' || {_N} || ',"output_tokens":1' || CASE WHEN k % 3 = 0 THEN ',"cache_read_input_tokens":' || {_K.format("k * 2")} ELSE '' END || '}}}}}}'
  WHEN 'click' THEN '{{"type":"content_block_start","content_block":{{"type":"' || CASE WHEN k % 2 = 0 THEN 'tool_use' ELSE 'server_tool_use' END || '","id":"call_' || {_K.format("k % 7")} || '","name":"' || CASE WHEN k % 5 = 0 THEN 'bad name' ELSE 'tool_' || {_K.format("k % 11")} END || '"}}}}'
  WHEN 'signup' THEN '{{"type":"message_delta","usage":{{"output_tokens":' || CASE WHEN k % 9 = 0 THEN 'null' ELSE {_N} END || CASE WHEN k % 5 = 0 THEN ',"cache_creation_input_tokens":' || {_K.format("k * 3")} ELSE '' END || '}}}}'
  WHEN 'purchase' THEN '{{"type":"message_stop"}}'
  ELSE CASE WHEN k % 23 = 0 THEN '{{"type":"error"}}' WHEN k % 19 = 0 THEN '{{"delta":{{"stop_reason":"refusal"}}}}' ELSE '{{"type":"ping"}}' END END
WHEN user_id % 3 = 1 THEN CASE event_type
  WHEN 'view' THEN '{{"type":"response.output_item.added","item":{{"type":"function_call","call_id":"call_' || {_K.format("k % 6")} || '"' || CASE WHEN k % 2 = 0 THEN ',"name":"tool_' || {_K.format("k % 13")} || '"' ELSE '' END || '}}}}'
  WHEN 'click' THEN '{{"type":"response.completed","response":{{"status":"completed","usage":{{"input_tokens":' || {_N} || ',"input_tokens_details":{{"cached_tokens":' || {_K.format("k - 40")} || '}},"output_tokens":' || {_K.format("k * 3")} || '}}}}}}'
  WHEN 'signup' THEN '{{"usage":{{"output_tokens":' || {_N} || ',"output_tokens_details":{{"reasoning_tokens":' || {_K.format("k % 60")} || '}}}}}}'
  WHEN 'purchase' THEN '{{"type":"response.output_text.delta","delta":"x"}}'
  ELSE CASE WHEN k % 23 = 0 THEN '{{"response":{{"error":{{"code":1}}}}}}' WHEN k % 19 = 0 THEN '{{"type":"response.refusal.delta","delta":"no"}}' ELSE '{{"type":"response.created","response":{{"error":null}}}}' END END
ELSE CASE event_type
  WHEN 'view' THEN '{{"choices":[{{"index":0,"delta":{{"tool_calls":[{{"index":' || {_K.format("k % 3")} || CASE WHEN k % 2 = 0 THEN ',"id":"call_' || {_K.format("k % 10")} || '"' ELSE '' END || ',"function":{{"name":"' || CASE WHEN k % 7 = 0 THEN '' ELSE 'part' || {_K.format("k % 5")} || CASE WHEN k % 10 = 0 THEN repeat('y', 90) ELSE '' END END || '"}}}}]}}}}]}}'
  WHEN 'click' THEN '{{"object":"chat.completion.chunk","choices":[],"usage":{{"prompt_tokens":' || {_N} || ',"prompt_tokens_details":{{"cached_tokens":' || {_K.format("k")} || '}}}}}}'
  WHEN 'signup' THEN '{{"usage":{{"completion_tokens":' || CASE WHEN k % 8 = 0 THEN '1.5' ELSE {_N} END || ',"completion_tokens_details":{{"reasoning_tokens":' || {_K.format("k % 50")} || '}}}}}}'
  WHEN 'purchase' THEN '[DONE]'
  ELSE CASE WHEN k % 23 = 0 THEN '{{"error":"x"}}' WHEN k % 19 = 0 THEN '{{"choices":[{{"finish_reason":"content_filter"}}]}}' ELSE '{{"choices":[{{"message":{{"tool_calls":[{{"id":"call_' || {_K.format("k % 10")} || '","function":{{"name":"whole"}}}}]}}}}]}}' END END END"""

KEYS = ["user_id", "stream"]
R = E + f""", r AS (SELECT user_id, k % 4 AS stream, event_id AS seq, user_id % 3 AS d, {RAW} AS raw FROM e),
j AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS o FROM r)
"""


def response_events(spark, sf_dir):
    dialect = F.element_at(F.array(F.lit("anthropic"), F.lit("responses"), F.lit("chat_completions")), (F.col("user_id") % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(
        "user_id", (F.col("k") % 4).alias("stream"), F.col("event_id").alias("seq"), dialect.alias("dialect"), F.lit(True).alias("streamed"), F.expr(RAW).alias("raw")
    )


@query(
    "stream_end",
    R + """, m AS (SELECT user_id, stream, d, raw, o, o->>'$.type' AS t FROM j),
x AS (SELECT user_id, stream,
  bool_or(coalesce(t IN ('error', 'response.failed', 'response.incomplete') OR coalesce(json_type(o, '$.error'), 'NULL') <> 'NULL' OR coalesce(json_type(o, '$.response.error'), 'NULL') <> 'NULL', false)) AS failed,
  bool_or(coalesce(CASE d WHEN 0 THEN o->>'$.delta.stop_reason' = 'refusal' WHEN 1 THEN t = 'response.refusal.delta' AND o->>'$.delta' <> '' ELSE o->>'$.choices[0].finish_reason' = 'content_filter' END, false)) AS refused,
  bool_or(o IS NULL AND NOT (d = 2 AND raw = '[DONE]')) AS uncertain,
  bool_or(coalesce(t IN ('message_stop', 'response.completed'), false) OR (d = 2 AND raw = '[DONE]')) AS terminal,
  bool_or(coalesce(CASE d WHEN 0 THEN t IS NOT NULL WHEN 1 THEN t LIKE 'response.%' ELSE json_type(o, '$.choices') = 'ARRAY' END, false) OR (d = 2 AND raw = '[DONE]')) AS protocol FROM m GROUP BY 1, 2)
SELECT user_id, stream, CASE WHEN failed THEN 'provider_error' WHEN refused THEN 'provider_refused' WHEN uncertain THEN 'parser_uncertain' WHEN terminal THEN 'completed'
  WHEN protocol THEN 'missing_terminal' ELSE 'parser_uncertain' END AS reason FROM x""",
)
def _(spark, sf_dir):
    return responses.stream_end(response_events(spark, sf_dir), KEYS)


def _usage_sql() -> str:
    def value(*paths):
        whens = " ".join(f"WHEN {d} THEN CASE WHEN json_type(u, '$.{p}') = 'UBIGINT' THEN CAST(json_extract(u, '$.{p}') AS BIGINT) END" for d, p in enumerate(paths) if p)
        return f"CASE d {whens} END"

    def told(*paths):
        return "coalesce(CASE d " + " ".join(f"WHEN {d} THEN json_type(u, '$.{p}') IS NOT NULL" for d, p in enumerate(paths) if p) + " END, false)"

    places = {
        "i": ("input_tokens", "input_tokens", "prompt_tokens"), "o": ("output_tokens", "output_tokens", "completion_tokens"),
        "r": ("cache_read_input_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"), "w": ("cache_creation_input_tokens", None, None),
        "g": (None, "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens"),
    }
    rows = ", ".join(f"{value(*p)} AS {n}, {told(*p)} AS p{n}" for n, p in places.items())
    r, w = (f"(CASE WHEN x.p{n} THEN x.{n} ELSE a.{n} END)" for n in "rw")
    whole = f"x.i + coalesce({r}, 0) + coalesce({w}, 0)"
    i = f"(CASE WHEN NOT x.pi THEN a.i WHEN x.d > 0 THEN x.i WHEN (x.pr AND x.r IS NULL) OR (x.pw AND x.w IS NULL) THEN NULL ELSE {whole} END)"
    o, g = (f"(CASE WHEN x.p{n} THEN x.{n} ELSE a.{n} END)" for n in "og")
    odd = f"(coalesce({g} > {o}, false) OR coalesce({r} > {i}, false) OR coalesce({w} > {i}, false) OR coalesce({r} + {w} > {i}, false))"
    new = ", ".join(f"'{n}': CASE WHEN NOT {odd} {'AND NOT x.first ' if n == 'o' else ''}THEN {e} END, 'p{n}': false" for n, e in zip("iorwg", (i, o, r, w, g)))
    blank = ", ".join(f"'{n}': NULL::BIGINT, 'p{n}': false" for n in "iorwg")
    each = ", ".join(f"'{n}': {n}, 'p{n}': p{n}" for n in "iorwg")
    return R + f""", u AS (SELECT *, CASE d WHEN 0 THEN coalesce(json_extract(o, '$.message.usage'), json_extract(o, '$.usage')) WHEN 1 THEN coalesce(json_extract(o, '$.response.usage'), json_extract(o, '$.usage'))
    ELSE json_extract(o, '$.usage') END AS u FROM j WHERE o IS NOT NULL),
f AS (SELECT user_id, stream, seq, d, coalesce(d = 0 AND o->>'$.type' = 'message_start', false) AS first, {rows} FROM u WHERE u IS NOT NULL),
l AS (SELECT user_id, stream, list({{{each}, 'd': d, 'first': first}} ORDER BY seq) AS es FROM f GROUP BY 1, 2),
s AS (SELECT user_id, stream, list_reduce(list_prepend({{{blank}, 'd': 0::BIGINT, 'first': false}}, es), lambda a, x: {{{new}, 'd': x.d, 'first': x.first}}) AS s FROM l)
SELECT user_id, stream, s.i AS input_tokens, s.o AS output_tokens, s.r AS cache_read_tokens, s.w AS cache_write_tokens, s.g AS reasoning_tokens FROM s
WHERE coalesce(s.i, s.o, s.r, s.w, s.g) IS NOT NULL"""


@query("stream_usage", _usage_sql())
def _(spark, sf_dir):
    return responses.stream_usage(response_events(spark, sf_dir), KEYS)


@query(
    "stream_tools",
    R + """, c AS (SELECT user_id, stream, seq, CASE d WHEN 0 THEN o->>'$.content_block.id' WHEN 1 THEN o->>'$.item.call_id' ELSE o->>'$.choices[0].message.tool_calls[0].id' END AS id,
  CASE d WHEN 0 THEN o->>'$.content_block.name' WHEN 1 THEN o->>'$.item.name' ELSE o->>'$.choices[0].message.tool_calls[0].function.name' END AS name FROM j WHERE o IS NOT NULL),
w AS (SELECT user_id, stream, id, arg_max(name, seq) FILTER (name IS NOT NULL AND name NOT LIKE '% %') AS name FROM c WHERE id IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT user_id, stream, seq, (o->>'$.choices[0].delta.tool_calls[0].index')::BIGINT AS n, o->>'$.choices[0].delta.tool_calls[0].id' AS id, o->>'$.choices[0].delta.tool_calls[0].function.name' AS part FROM j WHERE o IS NOT NULL),
q AS (SELECT user_id, stream, n, arg_max(id, seq) FILTER (id IS NOT NULL) AS id, string_agg(part, '' ORDER BY seq) AS name FROM p WHERE n IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT user_id, stream, id, CASE WHEN strlen(name) BETWEEN 1 AND 128 THEN name END AS name FROM q WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, stream, id ORDER BY n) = 1)
SELECT user_id, stream, id AS tool_id, name AS tool_name FROM w UNION ALL SELECT f.user_id, f.stream, f.id, f.name FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = f.user_id AND w.stream = f.stream AND w.id = f.id)""",
)
def _(spark, sf_dir):
    return responses.stream_tools(response_events(spark, sf_dir), KEYS)


# Billable characters: a turn as a message with nested tool input, and an image on some turns. A dump's fixed part is counted on a message of empty strings.

def _message(role: str, text: str, n: int) -> dict:
    nested = {"n": n, "ok": True, "none": None, "deep": [[], {}, {"a": [text]}]}
    return {"role": role, "content": [{"type": "text", "text": text}, {"type": "tool_use", "name": "a:b, c", "input": nested}]}


_IMAGE = {"type": "tool_result", "content": [{"type": "image", "source": {"type": "base64", "data": ""}}]}
_ESCAPES = "(length(text) - length(replace(replace(replace(replace(replace(text, chr(34), ''), chr(92), ''), chr(10), ''), chr(13), ''), chr(9), '')))"


def _json(image: bool) -> str:
    text = json.dumps(_message("@role", "@text", 7), separators=(",", ":"))
    if image:
        text = text[:-2] + "," + json.dumps(_IMAGE, separators=(",", ":")).replace('"data":""', '"data":"@data"') + "]}"
    return text


@query(
    "billable_characters",
    f"""WITH c AS (SELECT conv_id, turn, {len(json.dumps(_message("", "", 7)))} - 1 + length(turn::VARCHAR) + length(role) + 2 * (length(text) + {_ESCAPES})
  + CASE WHEN turn % 3 = 0 THEN {len(json.dumps(_IMAGE)) + 2} + 4 * 1568 ELSE 0 END AS n FROM conversations)
SELECT conv_id, turn, n::BIGINT AS billable_chars, (n // 4)::BIGINT AS est_tokens FROM c""",
)
def _(spark, sf_dir):
    quoted = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")

    def made(image: bool):
        value = F.lit(_json(image))
        for mark, text in (('"@text"', quoted), ("@role", F.col("role")), ("7", F.col("turn").cast("string")), ("@data", F.repeat(F.lit("QUJD"), F.col("turn").cast("int")))):
            value = F.replace(value, F.lit(mark), text) if mark != "7" else F.replace(value, F.lit('"n":7'), F.concat(F.lit('"n":'), text))
        return value

    rows = table(spark, sf_dir, "conversations").withColumn("raw", F.when(F.col("turn") % 3 == 0, made(True)).otherwise(made(False)))
    rows = rows.select("conv_id", "turn", F.parse_json("raw").alias("value"))
    return billing.billable_chars(rows, ["conv_id", "turn"]).select("conv_id", "turn", "billable_chars", "est_tokens")


# Keyed streams

def hours():
    return [F.floor(F.col("at_ms") / 3_600_000), F.struct("at_ms", "seq")]


def watch_log(spark, sf_dir):
    at, k, kind = F.unix_millis("ts"), F.col("k"), F.col("event_type")
    is_pass = kind.isin("view", "click")
    return events(spark, sf_dir).select(
        F.lit("codex").alias("provider"), F.col("user_id").cast("string").alias("session_id"), at.alias("at_ms"), F.col("event_id").alias("seq"),
        F.when(is_pass, "pass").when(kind == "error", "held").when(kind == "signup", "fired").when(k % 2 == 0, "applied").otherwise("settled").alias("kind"),
        (k % 4).cast("string").alias("fingerprint"), F.when(kind == "error", F.floor(at / 1000) + (k % 24) * 1800).cast("long").alias("until_secs"),
        F.when(is_pass & (k % 11 != 0), F.round("value").cast("long")).alias("reported_context"), F.when(is_pass, 30).cast("long").alias("effective_trigger"),
        F.when(is_pass, 14_400).cast("long").alias("apply_hold_secs"), F.when(is_pass, 36_000).cast("long").alias("min_interval_secs"),
    )


WATCH_SQL = E + """, x AS (SELECT *, user_id::VARCHAR AS session_id, ms // 1000 AS s, CASE event_type WHEN 'error' THEN 'held' WHEN 'signup' THEN 'fired' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'applied' ELSE 'settled' END ELSE 'pass' END AS kind FROM e),
y AS (SELECT *, last_value(CASE WHEN kind = 'settled' THEN {'at': s, 'v': k % 4} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN kind = 'held' THEN {'at': s, 'v': s + (k % 24) * 1800} END IGNORE NULLS) OVER w AS h,
  last_value(CASE WHEN kind = 'applied' THEN s END IGNORE NULLS) OVER w AS p, last_value(CASE WHEN kind = 'fired' THEN s END IGNORE NULLS) OVER w AS f
  FROM x WINDOW w AS (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING))
SELECT session_id, ms AS at_ms, event_id AS seq, CASE WHEN s - a.at <= 86400 AND k % 4 = a.v THEN 'settled' WHEN s - h.at <= 86400 AND s < h.v THEN 'cooldown' WHEN s - p < 14400 THEN 'cooldown'
  WHEN k % 11 <> 0 AND round(value) < 30 THEN 'below_trigger' WHEN s - f < 36000 THEN 'cooldown' ELSE 'evaluate' END AS decision FROM y WHERE kind = 'pass'"""


@query("watch_passes", WATCH_SQL)
def _(spark, sf_dir):
    return keyed.watch_passes(watch_log(spark, sf_dir), hours()).drop("provider")


def replayed(spark, rows, make, late: str = "3 days"):
    """What a stream makes of a table: its rows arrive in two parts, a tenth of them up to two days late, and the stream is stopped between the parts.

    A last row far ahead lets the watermark pass all others; it gives no result itself.
    """
    keyed.use_state_store(spark)
    folder = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    ends = rows.agg(F.min("at_ms").alias("a"), F.max("at_ms").alias("b")).first()
    middle, last = ((ends["a"] or 0) + (ends["b"] or 0)) // 2, ends["b"] or 0
    second = (F.col("at_ms") >= middle) | ((F.col("at_ms") >= middle - 2 * 86_400_000) & (F.pmod(F.xxhash64("seq"), F.lit(10)) == 0))
    ahead = spark.createDataFrame([("end", "end", last + 30 * 86_400_000, 0)], "provider string, session_id string, at_ms long, seq long")
    for part in (rows.filter(~second), rows.filter(second), ahead):
        part = part.select(*[F.col(c).cast(t) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        part.write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), late).writeStream
        stream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("watch_stream", WATCH_SQL)
def _(spark, sf_dir):
    return replayed(spark, watch_log(spark, sf_dir), keyed.watch_stream).drop("provider")


def monitor_samples(spark, sf_dir):
    return samples(spark, sf_dir).select(
        "provider", "session_id", F.unix_millis("ts").alias("at_ms"), F.col("event_id").alias("seq"), "source_identity_sha256", "context_state", "context_tokens", "native_applied"
    )


MONITOR = E + """, x AS (SELECT *, CASE WHEN k % 9 <> 0 THEN 'same' ELSE 'other' END AS src, CASE WHEN event_type <> 'error' THEN round(value)::BIGINT END AS c FROM e),
y AS (SELECT *, lag(src) OVER w AS ps, lag(c) OVER w AS pc, lag(k) OVER w AS pk FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
z AS (SELECT user_id::VARCHAR AS session_id, CASE WHEN user_id % 2 = 0 THEN 'claude_code' ELSE 'codex' END AS provider, ms, event_id AS seq, c, CASE WHEN ps = src AND pc > 0 AND c > 0 THEN greatest(pc - c, 0) END AS context_drop_tokens,
  CASE WHEN ps = src AND k >= pk THEN k - pk END AS native_applied_delta, CASE WHEN ps = src THEN k < pk END AS native_counter_reset FROM y)
"""


@query("monitor_stream", MONITOR + "SELECT session_id, seq, context_drop_tokens, native_applied_delta, native_counter_reset FROM z")
def _(spark, sf_dir):
    return replayed(spark, monitor_samples(spark, sf_dir), keyed.monitor_stream).select(
        "session_id", "seq", "context_drop_tokens", "native_applied_delta", "native_counter_reset"
    )


@query(
    "monitor_series",
    MONITOR + """SELECT ms // 21600000 * 21600 AS from_s, provider, count(*) AS samples, count(c) AS measured, max(c) AS max_context, sum(context_drop_tokens)::BIGINT AS context_drop_tokens,
  sum(native_applied_delta)::BIGINT AS native_applied, count(*) FILTER (native_counter_reset) AS resets, count(native_counter_reset) AS compared FROM z GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    deltas = mo.monitor_deltas(monitor_samples(spark, sf_dir), hours())
    return keyed.monitor_series(deltas, "6 hours").withColumn("from_s", F.unix_seconds("from")).drop("from")

"""Queries of request histories, calibration, streams and monitor series."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.functions import variant as v
from palimpsest.functions.tokens import image_tokens
from palimpsest.operators import monitor as mo
from palimpsest.operators import requests as rq
from palimpsest.session import cut
from palimpsest.sources.tables import observations, table, time_levels
from palimpsest.streaming import jobs

E = """
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events)
"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("message_index"),
        (F.col("role") == "assistant").alias("assistant"), "role", "text",
    )


@query(
    "request_points",
    """SELECT conv_id::VARCHAR AS session_id, turn AS message_index FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
WHERE role <> 'assistant' AND coalesce(nx = 'assistant', true)""",
)
def _(spark, sf_dir):
    return rq.request_points(messages(spark, sf_dir), ["session_id"]).select("session_id", "message_index")


@query(
    "repeated_reads",
    E + """, f AS (SELECT user_id, k, min(event_id) AS a, min(event_id) FILTER (event_type <> 'error') AS b FROM e GROUP BY 1, 2)
SELECT user_id, count(*) AS calls, count(*) FILTER (event_id > a) AS repeated_reads, count(*) FILTER (event_id > a AND b < event_id) AS repeated_reads_covered FROM e JOIN f USING (user_id, k) GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    doc = F.try_parse_json(F.concat(F.lit('{"url":"u'), F.col("k").cast("string"), F.lit('"}')))
    calls = rows.select(
        "user_id", F.col("event_id").alias("line_index"), F.col("event_id").cast("string").alias("call_id"),
        rq.read_key(F.lit("fetch"), doc).alias("read_key"),
    )
    results = rows.filter(F.col("event_type") != "error").select(
        "user_id", F.col("event_id").cast("string").alias("call_id")
    )
    return rq.repeated_reads(calls, results, ["user_id"])


@query(
    "calibration",
    E + """, s AS (SELECT event_type, event_id, (round(value * 40)::BIGINT + 900) * 1000 // (1000 + k * 5) AS s FROM e),
u AS (SELECT event_type, count(*) AS samples, list_reduce(list(s ORDER BY event_id), lambda m, x: CASE WHEN x >= m THEN m + ((x - m) // 8) ELSE m - ((m - x) // 8) END) AS m FROM s WHERE s BETWEEN 250 AND 4000 GROUP BY 1)
SELECT event_type, samples, m AS mean_permille, CASE WHEN samples < 5 THEN 1000 ELSE least(greatest(m, 1000), 2000) END::BIGINT AS ratio_permille FROM u""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_type", F.col("event_id").alias("request_index"), (F.col("k") * 5 + 1000).alias("est_tokens"),
        (F.round(F.col("value") * 40).cast("long") + 900).alias("reported_tokens"),
    )
    return rq.calibrate(rows, ["event_type"])


@query(
    "ratio_stats",
    E + """, r AS (SELECT event_type, list_sort(list((round(value * 40)::BIGINT + 900) * 1000 // (1000 + k * 5))) AS l FROM e GROUP BY 1)
SELECT event_type, len(l) AS measured, l[1] AS least, l[len(l) // 2 + 1] AS median, l[len(l)] AS greatest FROM r""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_type", (F.col("k") * 5 + 1000).alias("est_tokens"),
        (F.round(F.col("value") * 40).cast("long") + 900).alias("reported_tokens"),
    ).withColumn("ratio", rq.ratio_permille())
    return rq.rank_value(rows, ["event_type"], "ratio")


@query(
    "prefix_digests",
    """SELECT count(*) AS messages, count(DISTINCT p) AS prefixes FROM (SELECT list(md5(role || ':' || coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)""",
)
def _(spark, sf_dir):
    """How many different prefixes the histories have, messages known by role and whole text."""
    rows = messages(spark, sf_dir).withColumn(
        "digest", F.sha2(F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    )
    out = rq.prefix_digests(rows, ["session_id"])
    return out.groupBy().agg(
        F.count("*").alias("messages"), F.count_distinct("prefix_digest").alias("prefixes")
    )


@query("message_digests")
def _(spark, sf_dir):
    doc = F.try_parse_json(F.to_json(F.struct("text")))
    return messages(spark, sf_dir).select(
        "session_id", "message_index", rq.message_digest(F.col("role"), v.get(doc, "$.text")).alias("digest")
    )


@query(
    "carried_words",
    """SELECT session_id, count(*) AS parts, min(message_index) AS first_part FROM (SELECT conv_id::VARCHAR AS session_id, turn AS message_index,
  sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 900 GROUP BY 1""",
)
def _(spark, sf_dir):
    kept = rq.bound_suffix(messages(spark, sf_dir), ["session_id"], 900, "message_index")
    return kept.groupBy("session_id").agg(
        F.count("*").alias("parts"), F.min("message_index").alias("first_part")
    )


@query(
    "cliff_messages",
    """WITH f AS (SELECT *, role = 'assistant' AND coalesce(lag(role) OVER w <> 'assistant', true) AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, min(turn) FILTER (st) AS head, max(turn) FILTER (st) AS tail, count(*) FILTER (st) AS turns, count(*) AS n FROM f GROUP BY 1)
SELECT conv_id::VARCHAR AS session_id, 1 + count(*) FILTER (turn < head OR turn >= tail) AS messages FROM f JOIN x USING (conv_id) WHERE turns > 1 AND tail - head > 1 GROUP BY 1""",
)
def _(spark, sf_dir):
    kept = rq.cliff_messages(messages(spark, sf_dir), ["session_id"], 1)
    return kept.groupBy("session_id").agg(F.count("*").alias("messages"))


@query(
    "retained_evidence",
    """WITH l AS (SELECT lang, text, max(doc_id) AS d FROM documents GROUP BY 1, 2), s AS (SELECT *, strlen(text) AS b, length(text) AS c FROM l WHERE strlen(text) <= 30000 AND length(text) <= 200000),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY d DESC) AS r FROM s), u AS (SELECT *, sum(b) OVER (PARTITION BY lang ORDER BY r) AS sb FROM t WHERE r <= 128)
SELECT lang, d AS line_index FROM u WHERE sb <= 30000""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("line_index"), "text")
    return rq.retain_evidence(rows, ["lang"], 30_000, 200_000, 100_000).select("lang", "line_index")


@query(
    "request_stats",
    E + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM e), h AS (SELECT user_id, n - lag(n) OVER (PARTITION BY user_id ORDER BY n) AS gap FROM r WHERE event_type = 'signup'),
g AS (SELECT user_id, count(*) AS compactions, min(gap) AS min_compaction_gap, count(*) FILTER (gap = 1) AS back_to_back FROM h GROUP BY 1)
SELECT user_id, count(*) AS requests, max(k) AS peak_tokens, arg_max(k, n) AS last_tokens, sum(k)::BIGINT AS total_tokens, count(*) FILTER (k > 80) AS over_threshold,
  coalesce(any_value(compactions), 0) AS compactions, any_value(min_compaction_gap) AS min_compaction_gap, coalesce(any_value(back_to_back), 0) AS back_to_back FROM r LEFT JOIN g USING (user_id) GROUP BY 1""",
)
def _(spark, sf_dir):
    from palimpsest.operators.ordered import exclusive_sums, line_levels

    rows = exclusive_sums(
        events(spark, sf_dir), ["user_id"], line_levels("event_id"), {"request_index": F.lit(1)}
    ).select(
        "user_id", "request_index", F.col("k").alias("est_tokens"), F.lit(80).alias("threshold_tokens"),
        (F.col("event_type") == "signup").alias("compacted"),
    )
    return rq.request_stats(cut(rows, "requests"), ["user_id"])


@query(
    "cache_estimates",
    E + """, r AS (SELECT *, lag(k) OVER w AS pk, lag(event_type) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, k, CASE WHEN pt = event_type THEN pk ELSE least(20, k) END AS rd FROM r)
SELECT user_id, sum(rd)::BIGINT AS cache_read, sum(greatest(k - rd, 0))::BIGINT AS cache_write, round(sum(rd) * 0.05::DOUBLE + sum(greatest(k - rd, 0)) * 1.25::DOUBLE, 6) AS cost FROM c GROUP BY 1""",
)
def _(spark, sf_dir):
    """A request extends the one before when it has the same type."""
    rows = events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("request_index"), F.col("k").alias("est_tokens"),
        F.lit(20).cast("long").alias("fixed_tokens"), F.col("event_type").alias("prefix_digest"),
        F.col("event_type").alias("previous_prefix"),
    )
    sums = rq.cache_estimate(rows, ["user_id"]).groupBy("user_id").agg(
        F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write")
    )
    return rq.replay_cost(sums).withColumn("cost", F.round("cost", 6))


@query(
    "ledger_activity",
    E + """SELECT event_type AS dialect, count(*) AS requests, count(*) FILTER (k % 2 = 0) AS compacted, count(*) FILTER (k % 3 = 0) AS reused_prefix, count(*) FILTER (k > 90) AS over_budget,
  count(*) FILTER (k % 5 = 0) AS shadow, sum(k * 10)::BIGINT AS est_tokens_in, sum(k * 7)::BIGINT AS est_tokens_out, max(k % 4) AS highest_rung FROM e GROUP BY 1""",
)
def _(spark, sf_dir):
    k = F.col("k")
    rows = events(spark, sf_dir).select(
        F.col("event_type").alias("dialect"), (k % 2 == 0).alias("compacted"), (k % 3 == 0).alias("reused_prefix"),
        (k > 90).alias("over_budget"), (k % 5 == 0).alias("shadow"), (k * 10).alias("est_tokens_in"),
        (k * 7).alias("est_tokens_out"), (k % 4).alias("rung"),
    )
    return rq.ledger_activity(rows)


@query(
    "request_dialects",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'chat_completions' WHEN 2 THEN 'responses' END AS dialect FROM pages""",
)
def _(spark, sf_dir):
    n = F.col("page_id") % 4
    path = F.concat(
        F.lit("/v1"),
        F.when(n == 0, "/messages?beta=true").when(n == 1, "/chat/completions").when(n == 2, "/responses/").otherwise("/models"),
    )
    return table(spark, sf_dir, "pages").select("page_id", rq.dialect_of(path).alias("dialect"))


@query(
    "context_errors",
    """SELECT doc_id, regexp_matches(lower(text), 'context.?length|context.?window|prompt is too long|input.tokens|maximum.context|exceeds.limit|too.many.tokens|reduce.the.length|reduce.the.input', 's') AS context_error FROM documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rq.is_context_error("text").alias("context_error"))


@query(
    "requested_output",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 32000 ELSE greatest(page_id, CASE WHEN page_id % 2 = 0 THEN 100 ELSE 0 END) END::BIGINT AS tokens FROM pages",
)
def _(spark, sf_dir):
    n = F.col("page_id")
    body = F.to_json(F.struct(
        F.when(n % 3 != 0, n).alias("max_tokens"), F.when((n % 2 == 0) & (n % 3 != 0), F.lit(100)).alias("max_output_tokens")
    ))
    rows = table(spark, sf_dir, "pages").select("page_id", F.try_parse_json(body).alias("b"))
    return rows.select("page_id", rq.requested_output(F.col("b")).alias("tokens"))


@query(
    "attributed_sessions",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN NULL WHEN 2 THEN url ELSE NULL END AS session_id FROM pages""",
)
def _(spark, sf_dir):
    """A thread id; a bare session id; two names that agree; two that do not."""
    n = F.col("page_id") % 4

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    heads = (
        F.when(n == 0, F.array(header("Thread-Id", F.col("url")), header("session_id", F.lit("x"))))
        .when(n == 1, F.array(header("Session-Id", F.col("url")), header("session_id", F.col("url"))))
        .when(n == 2, F.array(header("session_id", F.col("url")), header("Conversation_Id", F.col("url"))))
        .otherwise(F.array(header("session_id", F.col("url")), header("conversation_id", F.lit("y"))))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(heads))
    return rq.attribute_session(rows, ["page_id"])


@query(
    "image_tokens",
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 1568 ELSE least(4784, ceil(page_id * 9 / 28.0) * ceil(page_id * 7 / 28.0)) END::BIGINT AS tokens FROM pages",
)
def _(spark, sf_dir):
    width = F.when(F.col("page_id") % 5 != 0, F.col("page_id") * 9)
    return table(spark, sf_dir, "pages").select(
        "page_id", image_tokens(width, F.col("page_id") * 7).alias("tokens")
    )


@query(
    "pairing_violations",
    """SELECT 'call_without_result' AS violation, count(*) AS rows FROM conversations a WHERE role = 'assistant' AND turn % 3 = 1 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role <> 'assistant') HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    """Each reply calls once; the next turn answers, but not after every third turn."""
    rows = cut(messages(spark, sf_dir), "messages")
    asked = rows.filter("assistant").select("session_id", "message_index", F.col("message_index").cast("string").alias("call_id"))
    told = asked.filter(F.col("message_index") % 3 != 1).select(
        "session_id", (F.col("message_index") + 1).alias("message_index"), "call_id"
    )
    return rq.pairing_violations(rows, asked, told, ["session_id"]).groupBy("violation").agg(
        F.count("*").alias("rows")
    )


# --- streams in their batch form, and monitor series -------------------------------------

@query(
    "activity_windows",
    """WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM p)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 43200000000 AS until_us, count(*) AS events FROM g GROUP BY user_id, n""",
)
def _(spark, sf_dir):
    rows = jobs.activity_windows(table(spark, sf_dir, "events"), ["user_id"], "ts", 43_200)
    return rows.select(
        "user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("until").alias("until_us"), "events"
    )


@query(
    "rolling_requests",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events), f AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM a WHERE rn % 2 = 1),
w AS (SELECT *, unnest([s // 21600 * 21600, s // 21600 * 21600 - 21600]) AS st FROM f)
SELECT st AS from_s, CASE WHEN user_id % 2 = 0 THEN 'live_proxy' ELSE 'native_transcript' END AS source_kind, count(*) AS requests, count(*) FILTER (event_type IN ('purchase', 'view')) AS succeeded FROM w GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = jobs.rolling_requests(observations(spark, sf_dir), "12 hours", "6 hours")
    return rows.select(F.unix_seconds("from").alias("from_s"), "source_kind", "requests", "succeeded")


@query(
    "attempt_completion",
    """WITH a AS (SELECT *, row_number() OVER w - 1 AS rn, lead(ts) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT count(*) AS attempts, count(*) FILTER (nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 43200000000) AS incomplete FROM a WHERE rn % 2 = 0""",
)
def _(spark, sf_dir):
    rows = jobs.attempt_completion(observations(spark, sf_dir), "12 hours")
    return rows.groupBy().agg(F.count("*").alias("attempts"), F.count_if("incomplete").alias("incomplete"))


@query(
    "watch_decisions",
    E + """, s AS (SELECT user_id, count(*) AS n, sum(k)::BIGINT AS t, max(k) AS m, min(k) AS lo FROM e GROUP BY 1)
SELECT CASE WHEN n % 4 = 0 THEN 'settled' WHEN 1000 < m * 20 - 900 THEN 'cooldown' WHEN 1000 - lo * 10 < 960 THEN 'cooldown' WHEN t < 3300 THEN 'below_trigger' WHEN 1000 - t % 1000 < 300 THEN 'cooldown' ELSE 'evaluate' END AS decision,
  count(*) AS sessions FROM s GROUP BY 1""",
)
def _(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("k").alias("t"), F.max("k").alias("m"), F.min("k").alias("lo")
    )
    rows = s.select(
        "user_id", F.lit(1000).alias("now_ts"), F.lit("f").alias("fingerprint"),
        F.when(F.col("n") % 4 == 0, "f").alias("settled_fingerprint"), (F.col("m") * 20 - 900).alias("hold_until"),
        (F.col("lo") * 10).alias("last_apply"), (F.col("t") % 1000).alias("last_fire"),
        F.col("t").alias("reported_context"), F.lit(3300).alias("effective_trigger"),
        F.lit(960).alias("apply_hold_secs"), F.lit(300).alias("min_interval_secs"),
    )
    return jobs.watch_counts(rows.withColumn("decision", jobs.watch_decision()))


def samples(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", "ts", F.when(F.col("user_id") % 2 == 0, "claude_code").otherwise("codex").alias("provider"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("k") % 9 != 0, F.lit("same")).otherwise("other").alias("source_identity_sha256"),
        F.when(F.col("event_type") == "error", "unknown").otherwise("reported").alias("context_state"),
        F.when(F.col("event_type") != "error", F.round("value").cast("long")).alias("context_tokens"),
        F.col("k").alias("native_applied"),
    )


@query(
    "monitor_deltas",
    E + """, x AS (SELECT *, CASE WHEN k % 9 <> 0 THEN 'same' ELSE 'other' END AS src, CASE WHEN event_type <> 'error' THEN round(value)::BIGINT END AS c FROM e),
y AS (SELECT *, lag(src) OVER w AS ps, lag(c) OVER w AS pc, lag(k) OVER w AS pk FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id::VARCHAR AS session_id, sum(CASE WHEN ps = src AND pc > 0 AND c > 0 THEN greatest(pc - c, 0) END)::BIGINT AS context_drop, sum(CASE WHEN ps = src AND k >= pk THEN k - pk END)::BIGINT AS delta,
  count(*) FILTER (ps = src AND k < pk) AS resets FROM y GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = mo.monitor_deltas(samples(spark, sf_dir), time_levels())
    return rows.groupBy("session_id").agg(
        F.sum("context_drop_tokens").alias("context_drop"), F.sum("native_applied_delta").alias("delta"),
        F.count_if("native_counter_reset").alias("resets"),
    )


@query(
    "coverage_summary",
    E + """, l AS (SELECT user_id, arg_max(CASE WHEN event_type <> 'error' THEN round(value)::BIGINT ELSE -1 END, event_id) AS c FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM l WHERE user_id % 3 = 0) + 1 AS selected_sessions, count(*) FILTER (user_id % 3 = 0) AS selected_overlap, 1::BIGINT AS selected_unavailable,
  count(*) FILTER (user_id % 3 = 0 OR user_id % 2 = 1) AS eligible_samples, count(*) FILTER ((user_id % 3 = 0 OR user_id % 2 = 1) AND c >= 0) AS complete_samples FROM l""",
)
def _(spark, sf_dir):
    every = samples(spark, sf_dir)
    report = every.groupBy("provider", "session_id").agg(
        F.max_by("context_state", "event_id").alias("context_state"),
        F.max_by("context_tokens", "event_id").alias("context_tokens"),
    ).withColumn("context_reason", F.lit(None).cast("string"))
    wanted = report.filter(F.col("session_id").cast("long") % 3 == 0).select("session_id").unionByName(
        report.groupBy().agg(F.lit("absent").alias("session_id"))
    )
    return mo.coverage_summary(report, wanted, ["codex"]).select(
        "selected_sessions", "selected_overlap", "selected_unavailable", "eligible_samples", "complete_samples"
    )


@query(
    "compared_arms",
    E + """, a AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n0, count(*) FILTER (event_id % 2 = 1) AS n1, sum(k) FILTER (event_id % 2 = 0)::BIGINT AS s0, sum(k) FILTER (event_id % 2 = 1)::BIGINT AS s1 FROM e GROUP BY 1)
SELECT user_id, n0 = n1 AS comparable, CASE WHEN n0 = n1 THEN s1 - s0 END AS tokens_delta FROM a WHERE n0 > 0 AND n1 > 0""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 2).alias("arm")).agg(
        F.count("*").alias("requests"), F.sum("k").alias("tokens")
    )
    a, b = rows.filter("arm = 0").drop("arm"), rows.filter("arm = 1").drop("arm")
    return mo.compare_arms(a, b, ["user_id"], ["requests"], ["tokens"]).select("user_id", "comparable", "tokens_delta")


@query(
    "scored_answers",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'invalid_response' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status, count(*) AS facts FROM labels GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    expected = rows.select("doc_id", F.lit("fact").alias("fact"), F.lit("1").alias("expected"))
    answers = rows.filter(F.col("doc_id") % 4 != 0).select(
        "doc_id", F.lit("fact").alias("fact"), F.col("quality").cast("string").alias("answer"), F.lit(True).alias("is_text")
    )
    return mo.score_answers(answers, expected, ["doc_id"]).groupBy("status").agg(F.count("*").alias("facts"))


@query(
    "cost_totals",
    E + "SELECT event_type, round(sum(CASE WHEN k % 10 <> 3 THEN value END), 4) AS cost, bool_and(k % 10 <> 3) AS complete, count(*) AS reports FROM e GROUP BY 1",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", F.when(F.col("k") % 10 != 3, F.col("value")).alias("cost"))
    return mo.cost_totals(rows, ["event_type"]).withColumn("cost", F.round("cost", 4))


@query(
    "checkpoint_status",
    E + """SELECT event_id, CASE WHEN k % 11 = 0 THEN 'artifact_mismatch' WHEN 1707000000000 - ms > greatest(180000, k * 3000 * 100) THEN 'stale' WHEN k % 7 = 0 THEN 'in_progress' ELSE 'fresh' END AS status FROM e""",
)
def _(spark, sf_dir):
    ms = F.unix_millis("ts")
    rows = events(spark, sf_dir).select(
        "event_id", F.when(F.col("k") % 11 == 0, "b").otherwise("a").alias("artifact_sha256"), ms.alias("started_ms"),
        F.when(F.col("k") % 7 != 0, ms).alias("completed_ms"), (F.col("k") * 100).alias("interval_secs"),
    )
    return rows.select("event_id", mo.checkpoint_status("a", 1_707_000_000_000).alias("status"))


@query(
    "completion_reasons",
    E + """, s AS (SELECT user_id, k % 20 AS stream, bool_or(event_type = 'error' AND k % 3 = 0) AS f, bool_or(event_type = 'click' AND k % 4 = 0) AS r, bool_or(event_type = 'signup' AND k % 5 = 0) AS u,
  bool_or(event_type = 'purchase') AS t, bool_or(event_type = 'view') AS p FROM e GROUP BY 1, 2)
SELECT user_id, stream, CASE WHEN f THEN 'provider_error' WHEN r THEN 'provider_refused' WHEN u THEN 'parser_uncertain' WHEN t THEN 'completed' WHEN p THEN 'missing_terminal' ELSE 'parser_uncertain' END AS reason FROM s""",
)
def _(spark, sf_dir):
    from palimpsest.sources.observations import completion_reason

    kind, k = F.col("event_type"), F.col("k")
    rows = events(spark, sf_dir).select(
        "user_id", (k % 20).alias("stream"), ((kind == "error") & (k % 3 == 0)).alias("failed"),
        ((kind == "click") & (k % 4 == 0)).alias("refused"), ((kind == "signup") & (k % 5 == 0)).alias("uncertain"),
        (kind == "purchase").alias("terminal"), (kind == "view").alias("protocol"),
    )
    return completion_reason(rows, ["user_id", "stream"])

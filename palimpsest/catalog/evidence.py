"""Queries of compaction events: evidence, cohorts, telemetry, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.catalog.registry import query
from palimpsest.functions.hashes import rollout_bucket
from palimpsest.operators import evidence as ev
from palimpsest.operators.ordered import once
from palimpsest.operators.totals import whole_sums
from palimpsest.plans.policy import Policy, recent_reductions, with_policy
from palimpsest.session import cut
from palimpsest.sources.events import event_diagnostics, events_tail, filter_events, read_events
from palimpsest.sources.tables import compaction_events, table

BASE = f"""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id::VARCHAR AS session_id,
    CASE WHEN user_id % 2 = 0 THEN '{fixed.BRANCH}' ELSE '{fixed.WINDOW}' END AS provider FROM events),
c AS (SELECT *, epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS sec,
    round(value * 10)::BIGINT + 1 AS b, greatest(round(value * 10)::BIGINT + 1 - k, 0) AS af,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'applied' WHEN event_type = 'view' AND k % 2 = 0 THEN 'planned'
         WHEN event_type = 'error' THEN 'failed' ELSE 'skipped' END AS outcome,
    CASE WHEN event_type = 'view' THEN 'prompt-policy' WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'prompt-policy' ELSE 'watch-apply:control' END ELSE 'elide' END AS strategy,
    CASE WHEN event_type = 'error' THEN 'io' WHEN event_type = 'click' AND k % 4 = 0 THEN 'unresolved_context' END AS error_code,
    CASE WHEN user_id % 5 = 0 THEN 'ungated' WHEN ('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT % 100 < 40 THEN 'treatment' ELSE 'control' END AS arm,
    sha256('identity:' || user_id) AS identity, k % 40 AS pk, 1000 + (k % 40) * 7 + (event_id % 9 = 0)::BIGINT AS bt, 500 + k % 40 AS at_
    FROM e),
pairs AS (SELECT provider, session_id, identity, pk, min(event_id) AS first_index, count(*) AS n, min(bt) = max(bt) AS agreed,
    arg_min(bt, event_id) AS bt, arg_min(at_, event_id) AS at_ FROM c WHERE outcome = 'applied' AND k % 11 <> 0 GROUP BY 1, 2, 3, 4),
good AS (SELECT * FROM pairs WHERE agreed),
m AS (SELECT c.*, good.bt - good.at_ AS cut FROM c LEFT JOIN good ON c.event_id = first_index)
"""


@query(
    "qualified_reductions",
    BASE + "SELECT provider, session_id, first_index, bt AS before_tokens, bt - at_ AS reduction_tokens FROM good",
)
def _(spark, sf_dir):
    return ev.qualified_reductions(compaction_events(spark, sf_dir)).reductions.select(
        "provider", "session_id", "first_index", "before_tokens", "reduction_tokens"
    )


@query(
    "reduction_counts",
    BASE + """SELECT count(*) FILTER (NOT agreed) AS conflicting_pairs, sum(n - 1)::BIGINT AS duplicate_records,
  (SELECT count(*) FROM c WHERE outcome = 'applied' AND k % 11 = 0) AS unqualified_records FROM pairs""",
)
def _(spark, sf_dir):
    return ev.qualified_reductions(compaction_events(spark, sf_dir)).counts


@query(
    "recent_reductions",
    BASE + """SELECT provider, session_id, list(bt ORDER BY first_index DESC)[1] AS newest_before, len(list(bt)) AS kept, sum(bt - at_)::BIGINT AS reclaimed
FROM (SELECT *, row_number() OVER (PARTITION BY provider, session_id ORDER BY first_index DESC) AS r FROM good) WHERE r <= 3 GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = recent_reductions(ev.qualified_reductions(compaction_events(spark, sf_dir)).reductions)
    return rows.select(
        "provider", "session_id",
        F.col("recent")[0]["before"].alias("newest_before"),
        F.size("recent").cast("long").alias("kept"),
        F.aggregate("recent", F.lit(0).cast("long"), lambda n, r: n + r.reclaimed).alias("reclaimed"),
    )


@query(
    "qualified_retention",
    BASE + """SELECT provider, count(*) AS measured_events, sum(pk % 20)::BIGINT AS retained, sum(pk % 21)::BIGINT AS lexical_retained, sum(20)::BIGINT AS checks FROM pairs GROUP BY 1""",
)
def _(spark, sf_dir):
    return ev.retention_totals(ev.qualified_retention(compaction_events(spark, sf_dir)))


@query(
    "lossy_sessions",
    BASE + "SELECT provider, session_id, first_index FROM pairs WHERE pk % 21 < 10",
)
def _(spark, sf_dir):
    return ev.qualified_retention(compaction_events(spark, sf_dir)).filter("lossy").select(
        "provider", "session_id", "first_index"
    )


@query(
    "session_telemetry",
    BASE + """SELECT provider, session_id, min(sec) AS min_ts, max(sec) AS max_ts, count(*) FILTER (outcome = 'applied') AS applied,
  count(cut) AS qualified_reductions, count(*) FILTER (outcome = 'applied' AND cut IS NULL) AS unqualified_applied,
  coalesce(sum(cut), 0)::BIGINT AS reclaimed_tokens, max(sec) FILTER (outcome = 'applied') AS last_applied_ts FROM m GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    events = compaction_events(spark, sf_dir)
    return ev.session_telemetry(events, ev.qualified_reductions(events)).drop(
        "source_identity_sha256", "last_strategy"
    )


@query(
    "cohort_summary",
    BASE + """SELECT provider, arm, count(DISTINCT identity) AS sessions, count(*) AS events,
  count(*) FILTER (strategy = 'prompt-policy' AND outcome = 'planned') AS advisories_shown,
  count(*) FILTER (strategy = 'prompt-policy' AND outcome = 'skipped' AND error_code IS NULL AND arm = 'control' AND b >= 150) AS advisories_suppressed,
  count(*) FILTER (strategy = 'prompt-policy' AND outcome = 'skipped' AND error_code IS NULL AND NOT (arm = 'control' AND b >= 150)) AS silent_decisions,
  count(*) FILTER (strategy = 'watch-apply:control') AS watch_suppressed, count(*) FILTER (outcome = 'applied') AS applies,
  coalesce(sum(cut), 0)::BIGINT AS reclaimed_tokens, count(*) FILTER (error_code = 'unresolved_context') AS unresolved_context,
  min(sec) AS first_ts, max(sec) AS last_ts FROM m GROUP BY ROLLUP (provider, arm) HAVING provider IS NOT NULL""",
)
def _(spark, sf_dir):
    events = compaction_events(spark, sf_dir)
    return ev.cohort_summary(events, ev.qualified_reductions(events))


@query(
    "session_report",
    BASE + """, t AS (SELECT provider, session_id, identity, min(sec) AS lo, count(*) FILTER (outcome = 'applied') AS applied, count(cut) AS q, sum(cut) AS cut FROM m GROUP BY 1, 2, 3),
s AS (SELECT user_id, session_id, provider, identity, round(sum(value))::BIGINT AS v FROM c GROUP BY ALL)
SELECT s.provider, s.session_id, least(1707000000000 - (user_id * 1000 * 1000), lo * 1000) AS start_ms, 1707000000000 - user_id * 1000 * 1000 AS end_ms,
  CASE WHEN user_id % 3 = 0 THEN v - v // 4 END AS input_tokens, CASE WHEN user_id % 3 = 0 THEN v // 4 END AS cache_read_tokens, applied, q AS qualified_reductions,
  CASE WHEN q > 0 THEN cut END::BIGINT AS recorded_reduction_tokens FROM s JOIN t USING (provider, session_id, identity)""",
)
def _(spark, sf_dir):
    events = compaction_events(spark, sf_dir)
    users = whole_sums(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", "v")
    sessions = users.select(
        F.when(F.col("user_id") % 2 == 0, fixed.BRANCH).otherwise(fixed.WINDOW).alias("provider"),
        F.col("user_id").cast("string").alias("session_id"),
        F.sha2(F.concat(F.lit("identity:"), F.col("user_id").cast("string")), 256).alias(
            "source_identity_sha256"
        ),
        (F.col("user_id") * 1000).alias("age_secs"),
        F.when(F.col("user_id") % 3 == 0, "full").otherwise("partial").alias("lifetime_scope"),
        F.col("v").alias("lifetime_input_tokens"),
        F.floor(F.col("v") / 4).cast("long").alias("lifetime_cached_tokens"),
        F.col("user_id").alias("discovery_order"),
    )
    telemetry = ev.session_telemetry(events, ev.qualified_reductions(events))
    rows, _coverage = ev.session_report(sessions, telemetry, 1_707_000_000_000)
    return rows.select(
        "provider", "session_id", "start_ms", "end_ms", "input_tokens", "cache_read_tokens", "applied",
        "qualified_reductions", "recorded_reduction_tokens",
    )


@query(
    "rollout_buckets",
    """SELECT user_id, (('0x' || substr(sha256(user_id::VARCHAR), 1, 16))::UBIGINT % 100)::INT AS bucket
FROM (SELECT DISTINCT user_id FROM events)""",
)
def _(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", rollout_bucket(F.col("user_id").cast("string")).alias("bucket"))


@query(
    "policy_decisions",
    BASE + """, s AS (SELECT user_id, provider, arm, round(sum(value))::BIGINT AS ctx, user_id % 3 = 0 AS live FROM c GROUP BY ALL)
SELECT user_id, CASE WHEN ctx < 1500 THEN 'none' WHEN live THEN 'provider_compact' ELSE 'transcript_compact' END AS action,
  provider = 'claude_code' AND arm <> 'control' AND ctx >= 1600 AS blocked FROM s""",
)
def _(spark, sf_dir):
    events = compaction_events(spark, sf_dir)
    users = whole_sums(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", "context_tokens")
    arms = events.select(
        F.col("session_id").cast("long").alias("user_id"), "provider",
        (F.col("decision_cohort") != "control").alias("treatment"),
    ).distinct()
    rows = with_policy(
        users.join(arms, "user_id").withColumn("session_active", F.col("user_id") % 3 == 0),
        Policy(trigger_tokens=1_500, block_tokens=1_600),
    )
    return ev.policy_decision(rows).select("user_id", "action", "blocked")


@query(
    "events_tail",
    BASE + """SELECT count(*) AS events, count(*) FILTER (outcome = 'applied') AS applied,
  coalesce(sum(b - af) FILTER (outcome = 'applied'), 0)::BIGINT AS reclaimed FROM c WHERE sec >= 1704700000 - 3 * 86400 AND starts_with(session_id, '1')""",
)
def _(spark, sf_dir):
    rows = filter_events(compaction_events(spark, sf_dir), 1_704_700_000, "3d", "1")
    return events_tail(rows, 20)[1]


def log_lines(spark, sf_dir):
    """The events as log lines; some cut short, some of another schema or provider."""
    events = compaction_events(spark, sf_dir)
    order = F.col("log_order")
    marked = events.withColumns(
        {
            "schema": F.when(order % 23 == 0, "other/1").otherwise(F.col("schema")),
            "provider": F.when(order % 29 == 0, "other").otherwise(F.col("provider")),
            "outcome": F.when(order % 31 == 0, "maybe").otherwise(F.col("outcome")),
        }
    )
    made = once(marked, "body", F.to_json(F.struct(*[c for c in marked.columns if c != "log_order"])))
    body, line = F.col("body"), F.col("line_number")
    named = made.select(F.when(order % 2 == 0, 1).otherwise(0).alias("generation"), order.alias("line_number"), "body")
    raw = (
        F.when(line % 37 == 0, F.substring(body, 1, 60))
        .when(line % 41 == 0, F.concat(body, F.repeat(F.lit(" "), 17_000)))
        .otherwise(body)
    )
    return once(named, "raw", raw).drop("body")


REASONS_SQL = """
WITH r AS (SELECT CASE WHEN event_id % 37 = 0 THEN 'invalid_json' WHEN event_id % 41 = 0 THEN 'oversized_record' WHEN event_id % 23 = 0 THEN 'unsupported_schema'
 WHEN event_id % 29 = 0 THEN 'unsupported_provider' WHEN event_id % 31 = 0 THEN 'invalid_fields' END AS reason FROM events)
"""


@query("event_diagnostics", REASONS_SQL + "SELECT reason, count(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return event_diagnostics(log_lines(spark, sf_dir))[2]


@query(
    "event_read_status",
    REASONS_SQL + """SELECT count(*) FILTER (reason IS NULL) AS valid_records, count(*) FILTER (reason = 'oversized_record') AS oversized_records,
  count(*) FILTER (reason <> 'oversized_record') AS invalid_records FROM r""",
)
def _(spark, sf_dir):
    return read_events(log_lines(spark, sf_dir))[1]


@query(
    "read_events_reductions",
    BASE.replace("FROM events)", "FROM events WHERE NOT (event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0))", 1)
    + "SELECT provider, session_id, count(*) AS reductions FROM good GROUP BY 1, 2",
)
def _(spark, sf_dir):
    """From log text to agreed pairs."""
    events = read_events(log_lines(spark, sf_dir))[0]
    return ev.qualified_reductions(events).reductions.groupBy("provider", "session_id").agg(
        F.count("*").alias("reductions")
    )


@query(
    "failure_classes",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'usage limit') THEN 'usage limit exceeded' WHEN contains(lower(text), 'cannot resume') THEN 'cannot resume provider thread'
 WHEN contains(lower(text), 'not found') THEN 'provider thread not found' WHEN contains(lower(text), 'not supported') THEN 'provider operation not supported' ELSE 'provider rejected' END AS class,
 CASE WHEN contains(text, 'usage limit') THEN 14400 WHEN contains(text, 'cannot resume') OR contains(text, 'not found') OR contains(text, 'not supported') THEN 86400
 WHEN contains(text, 'outcome unknown') OR contains(text, 'turn failed') OR contains(text, 'turn interrupted') OR contains(text, 'turn aborted') OR contains(text, 'turn unknown') THEN 3600 ELSE 0 END AS hold_secs
FROM documents""",
)
def _(spark, sf_dir):
    name, hold = ev.failure_class("text")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("class"), hold.alias("hold_secs"))

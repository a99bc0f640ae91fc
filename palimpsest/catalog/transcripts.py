"""Queries over transcript lines made from conversations: items, usage, findings, rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog.registry import query
from palimpsest.operators import normalize as nm
from palimpsest.operators import verify as vf
from palimpsest.operators.ordered import once
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut
from palimpsest.sources.tables import conversation_records, conversation_window_records
from palimpsest.sources.transcripts import decode


def branch(spark, sf_dir):
    return once(cut(conversation_records(spark, sf_dir), "records"), "rec", decode("raw"))


def window(spark, sf_dir):
    return once(cut(conversation_window_records(spark, sf_dir), "records"), "rec", decode("raw"))


LINES = """
WITH t AS (SELECT *, conv_id || '-' || turn AS p, to_json(text)::VARCHAR AS q, strlen(text) AS b FROM conversations),
said AS (SELECT conv_id, 2 * turn AS line_index, role AS kind, NULL::BIGINT AS bytes, role AS label,
  CASE WHEN role = 'assistant' THEN '{"content":[{"text":' || q || ',"type":"text"},{"id":"call-' || p || '","input":{"file_path":"/' || p || '"},"name":"Read","type":"tool_use"}],"id":"m-' || p ||
    '","role":"assistant","stop_reason":"end_turn","usage":{"cache_creation_input_tokens":0,"cache_read_input_tokens":0,"input_tokens":' || b || ',"output_tokens":' || (turn + 1) || '}}'
  ELSE '{"content":' || q || ',"role":"' || role || '"}' END AS m FROM t),
told AS (SELECT conv_id, 2 * turn + 1, CASE WHEN b > 256 THEN 'tool_result' ELSE 'user' END, CASE WHEN b > 256 THEN b END,
  CASE WHEN b > 256 THEN 'Read' ELSE 'user' END, '{"content":[{"content":' || q || ',"tool_use_id":"call-' || p || '","type":"tool_result"}],"role":"user"}' FROM t WHERE role = 'assistant'),
dead AS (SELECT conv_id, 2 * turn + 1, 'assistant', NULL, 'assistant (dead branch)', NULL FROM t WHERE role <> 'assistant' AND conv_id % 5 = 0 AND turn = 0),
lines AS (SELECT * FROM said UNION ALL SELECT * FROM told UNION ALL SELECT * FROM dead)
"""


@query(
    "items_branch",
    LINES + """SELECT conv_id::VARCHAR AS session_id, line_index, kind, CASE WHEN m IS NULL THEN 0 ELSE (strlen(m) + 3) // 4 END::BIGINT AS est_tokens,
  bytes AS elidable_bytes, label FROM lines""",
)
def _(spark, sf_dir):
    return nm.items_branch(branch(spark, sf_dir)).select(
        "session_id", "line_index", "kind", "est_tokens", "elidable_bytes", "label"
    )


@query(
    "usage_branch",
    """SELECT conv_id::VARCHAR AS session_id, arg_max(strlen(text) + turn + 1, turn)::BIGINT AS reported_context, sum(strlen(text))::BIGINT AS lifetime_input_tokens,
  CASE WHEN conv_id % 5 = 0 THEN 'partial' ELSE 'full' END AS lifetime_scope FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
)
def _(spark, sf_dir):
    return nm.usage_branch(branch(spark, sf_dir)).select(
        "session_id", "reported_context", "lifetime_input_tokens", "lifetime_scope"
    ).filter(F.col("reported_context").isNotNull())


@query(
    "live_lines",
    LINES + "SELECT conv_id::VARCHAR AS session_id, count(*) AS live FROM lines WHERE m IS NOT NULL GROUP BY 1",
)
def _(spark, sf_dir):
    return nm.live_lines(branch(spark, sf_dir)).filter("state = 'live'").groupBy("session_id").agg(
        F.count("*").alias("live")
    )


@query(
    "items_window",
    """SELECT conv_id::VARCHAR AS session_id, count(*) + count(*) FILTER (role = 'assistant') * 2 + CASE WHEN conv_id % 4 = 0 AND max(turn) >= 1 THEN 1 ELSE 0 END AS items,
  count(*) FILTER (role = 'assistant' AND strlen(text) > 256 AND NOT (conv_id % 4 = 0 AND turn <= 1)) AS elidable FROM conversations GROUP BY conv_id""",
)
def _(spark, sf_dir):
    return nm.items_window(window(spark, sf_dir)).groupBy("session_id").agg(
        F.count("*").alias("items"), F.count("elidable_bytes").alias("elidable")
    )


@query("items_window_rows")
def _(spark, sf_dir):
    return nm.items_window(window(spark, sf_dir)).drop("provider", "path")


@query(
    "tool_calls",
    """SELECT conv_id::VARCHAR AS session_id, 2 * turn AS line_index, 'call-' || conv_id || '-' || turn AS call_id, 'Read({"file_path":"/' || conv_id || '-' || turn || '"})' AS label
FROM conversations WHERE role = 'assistant'""",
)
def _(spark, sf_dir):
    return nm.branch_calls(branch(spark, sf_dir)).select("session_id", "line_index", "call_id", "label")


@query(
    "findings_branch",
    """SELECT 'broken_parent_chain' AS code, count(*) AS findings FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'assistant' AND a.turn % 4 = 1 AND a.conv_id % 7 = 3 HAVING count(*) > 0
UNION ALL SELECT 'orphaned_tool_use', count(*) FROM conversations WHERE role = 'assistant' AND turn % 4 = 1 AND conv_id % 7 = 3 HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    """Transcripts that lost some tool results: their calls stay open and their children hang free."""
    lost = F.col("raw").contains('"tool_result"') & (F.floor(F.col("line_index") / 2) % 4 == 1) & (
        F.col("session_id").cast("long") % 7 == 3
    )
    rows = branch(spark, sf_dir).filter(~lost)
    return vf.verify_branch(rows).groupBy("code").agg(F.count("*").alias("findings"))


@query(
    "findings_common",
    """WITH l AS (SELECT conv_id, 2 * turn AS line_index FROM conversations UNION ALL SELECT conv_id, 2 * turn + 1 FROM conversations WHERE role = 'assistant' OR conv_id % 5 = 0)
SELECT CASE WHEN conv_id % 3 = 0 THEN 'blank_line' WHEN conv_id % 3 = 1 THEN 'invalid_json' ELSE 'invalid_record' END AS code, count(*) AS findings
FROM l WHERE line_index = 0 GROUP BY 1""",
)
def _(spark, sf_dir):
    """Transcripts whose first line is blank, cut short, or not an object."""
    n = F.col("session_id").cast("long") % 3
    raw = F.when(
        F.col("line_index") == 0,
        F.when(n == 0, F.lit("  ")).when(n == 1, F.substring("raw", 1, 20)).otherwise(F.lit("[1]")),
    ).otherwise(F.col("raw"))
    rows = once(cut(conversation_records(spark, sf_dir).withColumn("raw", raw), "records"), "rec", decode("raw"))
    return vf.verify_common(rows).groupBy("code").agg(F.count("*").alias("findings"))


@query("findings_window")
def _(spark, sf_dir):
    rows = window(spark, sf_dir).filter(~(F.col("raw").contains("function_call_output") & (F.col("line_index") % 8 == 6)))
    return vf.verify_window(rows).groupBy("code").agg(F.count("*").alias("findings"))


@query(
    "tail_items",
    """WITH i AS (SELECT conv_id, turn, role, unnest(CASE WHEN role = 'assistant' THEN [0, 1, 2] ELSE [0] END) AS n FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn <= 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, n DESC) AS k FROM i), l AS (SELECT * FROM r WHERE k <= 5)
SELECT conv_id::VARCHAR AS session_id, count(*) AS items FROM l WHERE n = 0 OR EXISTS (SELECT 1 FROM l m WHERE m.conv_id = l.conv_id AND m.turn = l.turn AND m.n = 3 - l.n) GROUP BY 1""",
)
def _(spark, sf_dir):
    return vf.tail_items(window(spark, sf_dir), 5).groupBy("session_id").agg(F.count("*").alias("items"))


@query(
    "applied_elision",
    """SELECT conv_id::VARCHAR AS session_id, 2 * turn + 1 AS line_index, strlen('[output elided by palimpsest: ' || strlen(text) || ' bytes]') AS stub_bytes
FROM conversations WHERE role = 'assistant' AND strlen(text) > 256""",
)
def _(spark, sf_dir):
    """Every eligible result replaced by its stub, then read back as items."""
    from palimpsest import fixed
    from palimpsest.plans.apply import apply_elision

    rows = branch(spark, sf_dir)
    edits = nm.items_branch(rows).filter("elidable_bytes IS NOT NULL").select(
        *KEYS, "line_index", F.lit(fixed.STUB).alias("stub")
    )
    done = cut(apply_elision(rows, cut(edits, "edits")).filter("changed"), "applied")
    again = nm.branch_results(once(done, "rec", decode("raw")))
    return again.select("session_id", "line_index", F.octet_length("text").cast("long").alias("stub_bytes"))


@query(
    "message_history",
    "SELECT conv_id::VARCHAR AS session_id, count(*) FILTER (role IN ('user', 'assistant')) + count(*) FILTER (role = 'assistant') + count(*) FILTER (role <> 'assistant' AND conv_id % 5 = 0 AND turn = 0) AS messages FROM conversations GROUP BY conv_id",
)
def _(spark, sf_dir):
    from palimpsest.operators.requests import message_history

    return message_history(branch(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("messages"))


@query(
    "import_native",
    """SELECT 'request_finished' AS kind, count(*) AS rows FROM conversations WHERE role = 'assistant' UNION ALL
SELECT 'tool_observed', 2 * count(*) FROM conversations WHERE role = 'assistant'""",
)
def _(spark, sf_dir):
    from palimpsest.sources.observations import import_native

    rows, _unsupported, _changed = import_native(branch(spark, sf_dir))
    return rows.groupBy("kind").agg(F.count("*").alias("rows"))


@query("live_slots")
def _(spark, sf_dir):
    from palimpsest.operators.retention import slots

    rows = branch(spark, sf_dir)
    items = cut(nm.items_branch(rows), "items")
    return slots(rows, items).groupBy("session_id", "origin").agg(
        F.count("*").alias("slots"), F.sum(F.octet_length("text")).alias("bytes")
    )

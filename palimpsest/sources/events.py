"""The compaction event log: scan, diagnostics, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.operators.evidence import valid_event
from palimpsest.session import cut

_LONG, _TEXT = T.LongType(), T.StringType()


def _fields(*pairs):
    return [T.StructField(name, kind) for name, kind in pairs]


OBSERVATION_TYPE = T.StructType(
    _fields(
        ("source_sha256", _TEXT), ("source_identity_sha256", _TEXT),
        ("snapshot_manifest_sha256", _TEXT), ("context_state", _TEXT), ("context_tokens", _LONG),
        ("estimated_context_tokens", _LONG), ("lifetime_scope", _TEXT),
        ("lifetime_input_tokens", _LONG), ("lifetime_cached_tokens", _LONG),
    )
)
EVENT_TYPE = T.StructType(
    _fields(
        ("schema", _TEXT), ("ts", _LONG), ("provider", _TEXT), ("session_id", _TEXT),
        ("strategy", _TEXT), ("action", _TEXT), ("outcome", _TEXT), ("trigger_tokens", _LONG),
        ("context_tokens_before", _LONG), ("context_tokens_after", _LONG),
        ("est_reclaimed_tokens", _LONG), ("items_covered", _LONG), ("duration_ms", _LONG),
        ("error_code", _TEXT), ("source_identity_sha256", _TEXT), ("binary_sha256", _TEXT),
        ("config_sha256", _TEXT), ("decision_cohort", _TEXT), ("rollout_percent", T.IntegerType()),
        ("experiment_sha256", _TEXT), ("snapshot_before_sha256", _TEXT),
        ("snapshot_after_sha256", _TEXT), ("before_observation", OBSERVATION_TYPE),
        ("after_observation", OBSERVATION_TYPE), ("retention_total", _LONG),
        ("retention_retained", _LONG), ("retention_lexical", _LONG),
    )
)


def read_log_lines(spark: SparkSession, rotated: str | None, live: str) -> DataFrame:
    """Lines of the rotated log (generation 1), then of the live log (generation 0).

    Logs are read whole per file so that lines keep their number; the writer rotates a
    log at a bounded size.
    """
    out = None
    for generation, path in ((1, rotated), (0, live)):
        if path is None:
            continue
        text = spark.read.text(path, wholetext=True)
        lines = text.select(
            F.lit(generation).alias("generation"), F.posexplode(F.split("value", "\n"))
        ).select("generation", (F.col("pos") + 1).cast("long").alias("line_number"), F.col("col").alias("raw"))
        out = lines if out is None else out.unionByName(lines)
    return out


def diagnose(raw: DataFrame, schema_name: str = fixed.EVENT_SCHEMA) -> DataFrame:
    """Each log line with its event and the reason it is not one.

    ``raw`` has generation, line_number and raw.  Blank lines are left out.
    """
    big = F.octet_length("raw") > fixed.MAX_LOG_LINE_BYTES
    kept = raw.filter(big | F.col("raw").rlike(r"[^ \t\r\f\n]"))
    read = kept.select(
        "generation", "line_number", big.alias("big"),
        # Of a line that is JSON its first character tells this; the schema of the whole value would be costly.
        F.col("raw").rlike(r"^[ \t\r\n]*\{").alias("opens"),
        F.when(~big, F.try_parse_json("raw")).alias("json"),
        F.when(~big, F.from_json("raw", EVENT_TYPE)).alias("event"),
    )
    json = F.col("json")
    parsed = read.select(
        "generation", "line_number", "big", "event",
        json.isNotNull().alias("is_json"),
        (json.isNotNull() & F.col("opens")).alias("is_object"),
        v.string(json, "$.schema").alias("named"),
        v.count(json, "$.ts").alias("ts"),
        *[v.string(json, f"$.{n}").alias(n) for n in ("provider", "session_id", "action", "outcome")],
    )
    known = F.col("provider").isin(fixed.BRANCH, fixed.WINDOW)
    session = F.col("session_id")
    reason = (
        F.when(F.col("big"), "oversized_record")
        .when(~F.col("is_json"), "invalid_json")
        .when(~F.col("is_object"), "invalid_fields")
        .when(F.coalesce(F.col("named") != schema_name, F.lit(False)), "unsupported_schema")
        .when(F.coalesce(~known, F.lit(False)), "unsupported_provider")
        .when(~F.coalesce(valid_event(schema_name, "event."), F.lit(False)), "invalid_fields")
    )
    # One table of judged lines feeds the rows, the coverage and the histogram.
    judged = cut(parsed.withColumn("reason", reason), "log")
    return judged.select(
        "generation",
        "line_number",
        F.struct((-F.col("generation")).alias("g"), F.col("line_number").alias("l")).alias("log_order"),
        "event",
        "ts",
        F.when(F.col("provider").isNotNull(), F.when(known, F.col("provider")).otherwise("unsupported")).alias("provider"),
        F.when(session.rlike(r"^[A-Za-z0-9._-]{1,256}$"), session).alias("session_id"),
        F.when(F.col("action").isin(fixed.EVENT_ACTIONS), F.col("action")).alias("action"),
        F.when(F.col("outcome").isin(fixed.EVENT_OUTCOMES), F.col("outcome")).alias("outcome"),
        "reason",
        (F.col("is_json") & F.col("is_object")).alias("readable"),
    )


def read_events(raw: DataFrame, schema_name: str = fixed.EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """The valid events in log order, and one row of counts of what was left out."""
    rows = diagnose(raw, schema_name)
    events = rows.filter(F.col("reason").isNull()).select(
        "event.*", "generation", "line_number", "log_order"
    )
    status = rows.groupBy().agg(
        F.count_if(F.col("reason").isNull()).alias("valid_records"),
        F.count_if(F.col("reason") == "oversized_record").alias("oversized_records"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "oversized_record")).alias(
            "invalid_records"
        ),
    )
    return events, status


def event_diagnostics(
    raw: DataFrame,
    session_prefix: str | None = None,
    since_ts: int | None = None,
    tail: int = 100,
    schema_name: str = fixed.EVENT_SCHEMA,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last matching rows, one row of coverage, and the count of each reason."""
    rows = diagnose(raw, schema_name)
    match = F.lit(True)
    if session_prefix is not None:
        match = match & F.coalesce(F.startswith("session_id", F.lit(session_prefix)), F.lit(False))
    if since_ts is not None:
        match = match & F.coalesce(F.col("ts") >= since_ts, F.lit(False))
    marked = rows.withColumn("_match", match)
    shown = marked.filter("_match").orderBy(F.col("log_order").desc()).limit(tail).drop(
        "_match", "event"
    )
    coverage = marked.groupBy().agg(
        F.count("*").alias("scanned_records"),
        F.count_if("readable").alias("readable_records"),
        F.count_if(F.col("reason").isNull()).alias("valid_records"),
        F.count_if(F.col("reason") == "oversized_record").alias("oversized_records"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "oversized_record")).alias(
            "invalid_records"
        ),
        F.count_if("_match").alias("matched_records"),
    )
    coverage = coverage.withColumns(
        {
            "exported_rows": F.least("matched_records", F.lit(tail)),
            "omitted_rows": F.greatest(F.col("matched_records") - tail, F.lit(0)),
        }
    )
    reasons = marked.filter(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count("*").alias("rows")
    )
    return shown, coverage, reasons


def parse_since(text: str) -> int:
    """Seconds of a duration such as ``7d``, ``12h``, ``30m``, ``45s`` or ``45``."""
    unit = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}
    if text and text[-1] in unit:
        return int(text[:-1]) * unit[text[-1]]
    return int(text)


def filter_events(
    events: DataFrame, now_ts: int, since: str | None = None, session_prefix: str | None = None
) -> DataFrame:
    """Events not older than ``since`` whose session id starts with the prefix."""
    if since is not None:
        events = events.filter(F.col("ts") >= now_ts - parse_since(since))
    if session_prefix is not None:
        events = events.filter(F.startswith("session_id", F.lit(session_prefix)))
    return events


def events_tail(events: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` events of the log, and the applied count with its estimated reduction."""
    last = events.orderBy(F.col("log_order").desc()).limit(n)
    applied = F.col("outcome") == "applied"
    totals = events.groupBy().agg(
        F.count("*").alias("events"),
        F.count_if(applied).alias("applied"),
        F.coalesce(F.sum(F.when(applied, F.col("est_reclaimed_tokens"))), F.lit(0)).alias("reclaimed"),
    )
    return last, totals

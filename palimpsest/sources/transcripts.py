"""Transcript files: scan, provider sniff, discovery, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.operators.ordered import newest, once
from palimpsest.session import cut


def decode(raw: str | Column) -> Column:
    """A record as VARIANT; NULL for invalid JSON and for repeated keys."""
    return F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw)


def read_transcripts(
    spark: SparkSession, paths: str | list[str], max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of transcript files, the files, and the files refused for their size.

    Files are read in blocks, by lines, so a file of any size is spread over tasks. Lines are
    numbered inside their block, and blocks by the lines before them. Only a caller that names
    ``max_bytes`` has larger files refused.
    """
    known = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    fits = F.lit(True) if max_bytes is None else F.col("file_bytes") <= max_bytes
    refused = known.filter(~fits).select(
        "path", "file_bytes", F.lit("file_over_limit").alias("reason")
    )
    # Ids rise in the order of lines inside a block. They are written once, so that all readers see the same.
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", r"\r\z", "").alias("raw"),
    )
    lines = cut(lines.filter(fits).drop("file_bytes"), "lines")
    blocks = lines.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    rows = lines.join(blocks, ["path", "_block"]).select(
        "path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_index"), "raw"
    )
    counted = blocks.groupBy("path").agg(F.sum("_lines").alias("_records"))
    files = known.filter(fits).join(counted, "path", "left").select(
        "path", "file_bytes", "modified_at", F.coalesce("_records", F.lit(0)).cast("int").alias("records")
    )
    return rows, files, refused


def sniff_provider(rows: DataFrame) -> DataFrame:
    """Provider of each file from the first telling record among its first 24."""
    rows = once(rows.filter(F.col("line_index") < 24), "rec", decode("raw"))
    rec = F.col("rec")
    named = v.string(rec, "$.type")
    window = named.isin("session_meta", "response_item", "turn_context", "event_msg", "compacted")
    branch = named.isin("user", "assistant", "system", "summary", "attachment", "last-prompt", "mode") & (
        v.string(rec, "$.sessionId").isNotNull() | v.get(rec, "$.uuid").isNotNull()
        | v.get(rec, "$.message").isNotNull() | v.get(rec, "$.leafUuid").isNotNull()
    )
    told = F.when(window, fixed.WINDOW).when(branch, fixed.BRANCH)
    return (
        rows.select("path", "line_index", told.alias("provider"))
        .filter(F.col("provider").isNotNull())
        .groupBy("path")
        .agg(F.min_by("provider", "line_index").alias("provider"))
    )


def records(rows: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Decoded records with provider and session id: (provider, session_id, path, line_index, raw, rec).

    The session id is the one the file names; a file that names none goes by its stem.
    """
    told = sniff_provider(rows) if providers is None else providers
    parsed = once(rows.join(told, "path"), "rec", decode("raw"))
    payload_id = F.coalesce(v.string(F.col("rec"), "$.payload.id"), v.string(F.col("rec"), "$.payload.session_id"))
    named = F.when(
        F.col("provider") == fixed.BRANCH, v.string(F.col("rec"), "$.sessionId")
    ).otherwise(F.when(v.string(F.col("rec"), "$.type") == "session_meta", payload_id))
    # A few distinct names per file; one aggregate row per file is joined back.
    ids = (
        parsed.select("path", "line_index", named.alias("_named"))
        .filter(F.col("_named").isNotNull())
        .groupBy("path")
        .agg(F.min_by("_named", "line_index").alias("_named"))
    )
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return parsed.join(ids, "path", "left").select(
        "provider", F.coalesce("_named", stem).alias("session_id"), "path", "line_index", "raw", "rec"
    )


def changed_sessions(decoded: DataFrame) -> DataFrame:
    """Window-dialect files that name more than one session id: refused by the importer."""
    rec = F.col("rec")
    named = F.coalesce(v.string(rec, "$.payload.id"), v.string(rec, "$.payload.session_id"))
    meta = decoded.filter((F.col("provider") == fixed.WINDOW) & (v.string(rec, "$.type") == "session_meta"))
    ids = meta.groupBy("path").agg(F.min(named).alias("_a"), F.max(named).alias("_b"))
    return ids.filter(F.col("_a") != F.col("_b")).select("path")


def discover_sessions(
    decoded: DataFrame,
    files: DataFrame,
    as_of,
    max_age_secs: int = 0,
    live: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sessions newest first, with age and activity, and a scan status per provider.

    ``max_age_secs`` of 0 keeps all.  Sessions named in ``live`` have age 0.
    """
    one = decoded.groupBy("provider", "session_id", "path").agg(F.count("*").alias("records"))
    age = F.greatest(F.unix_seconds(F.lit(as_of)) - F.unix_seconds("modified_at"), F.lit(0))
    aged = one.join(files.select("path", "modified_at"), "path").withColumn("age_secs", age)
    if live is not None:
        named = live.select("session_id", F.lit(True).alias("_live")).distinct()
        aged = aged.join(named, "session_id", "left").withColumn(
            "age_secs", F.when(F.col("_live"), F.lit(0)).otherwise(F.col("age_secs"))
        ).drop("_live")
    chosen = F.lit(True) if max_age_secs == 0 else F.col("age_secs") <= max_age_secs
    status = aged.groupBy("provider").agg(
        F.count("*").alias("scanned"), F.count_if(chosen).alias("selected")
    )
    kept = aged.filter(chosen).withColumn("active", F.col("age_secs") <= fixed.HOT_SECS)
    return kept.orderBy("age_secs", "path"), status


def latest_sessions(sessions: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` sessions of each provider."""
    return newest(sessions, ["provider"], [F.col("age_secs"), F.col("path")], k).drop("_rank")

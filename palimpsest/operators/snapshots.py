"""Snapshot history: ingest, listing, search, paging, comparison, pruning, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashes import is_sha256
from palimpsest.operators.ordered import newest
from palimpsest.plans.card import parse_card

STREAM = ["provider", "path", "session_id"]
LABELS = ["pre-compact", "post-compact", "pre-undo"]


def read_snapshot_index(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid index rows with their append order, and counts of valid, invalid and repeated rows.

    ``raw``: line_index, raw (one JSON object per line).
    """
    schema = (
        "ts long, sha256 string, path string, session_id string, provider string, bytes long, "
        "strategy string, record_count long, source_sha256 string"
    )
    rows = raw.filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", schema)).select(
        F.col("line_index").alias("append_order"), "e.*"
    )
    ok = F.coalesce(
        is_sha256("sha256") & F.col("ts").isNotNull() & F.col("path").isNotNull()
        & F.col("session_id").isNotNull() & F.col("provider").isNotNull(),
        F.lit(False),
    )
    marked = rows.withColumn("_ok", ok)
    valid = marked.filter("_ok").drop("_ok")
    same = [c for c in valid.columns if c != "append_order"]
    distinct = valid.select(*same).distinct().groupBy().agg(F.count("*").alias("_distinct"))
    totals = marked.groupBy().agg(
        F.count_if("_ok").alias("valid"), F.count_if(~F.col("_ok")).alias("invalid")
    )
    one = F.lit(1).alias("_one")
    counts = totals.select("*", one).join(distinct.select("*", one), "_one").select(
        "valid", "invalid", (F.col("valid") - F.col("_distinct")).alias("duplicates")
    )
    return valid, counts


def ingest_snapshots(records: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record bodies not stored yet, once each, and the list of records of every snapshot.

    ``records``: snapshot_sha, record_index, raw.  Copies inside the batch meet in one
    aggregate, so a body repeated without bound is one row per task before the shuffle.
    """
    hashed = records.withColumn("record_sha", F.sha2("raw", 256))
    bodies = hashed.groupBy("record_sha").agg(F.first("raw").alias("raw"))
    return (
        bodies.join(stored.select("record_sha"), "record_sha", "left_anti"),
        hashed.select("snapshot_sha", "record_index", "record_sha"),
    )


def snapshots(index: DataFrame, session_prefix: str | None = None) -> DataFrame:
    """Index rows newest first, of sessions that start with the prefix."""
    if session_prefix is not None:
        index = index.filter(F.startswith("session_id", F.lit(session_prefix)))
    return index.orderBy(F.col("ts").desc(), F.col("append_order").desc())


def latest_per_path(index: DataFrame, only: str | None = None) -> DataFrame:
    """The latest snapshot of each path; with ``only`` the latest of that label."""
    if only is not None:
        index = index.filter(F.col("strategy") == only)
    else:
        index = index.filter(F.col("strategy").isNull() | ~F.col("strategy").isin(LABELS))
    return newest(index, ["provider", "path"], [F.col("append_order").desc()], 1).drop("_rank")


def occurrences(text: str | Column, query: str) -> Column:
    """How often a literal occurs, without overlap."""
    text = F.col(text) if isinstance(text, str) else text
    left = F.replace(text, F.lit(query), F.lit(""))
    return F.floor((F.octet_length(text) - F.octet_length(left)) / len(query.encode())).cast("long")


def string_values(rec: Column) -> Column:
    """All string values of a JSON document given as text, decoded, keys left out."""
    quoted = F.filter(
        F.regexp_extract_all(rec, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), 0),
        lambda q: ~F.endswith(q, F.lit(":")),
    )
    return F.transform(quoted, lambda q: F.try_variant_get(F.try_parse_json(q), "$", "string"))


def search_records(
    records: DataFrame, query: str, limit: int = 50, by: list[str] | None = None, text: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records whose decoded strings hold a literal: the first ``limit`` per snapshot, and totals.

    ``records``: snapshot_sha, record_index, raw.  With ``text`` that column is searched.
    """
    by = by or ["snapshot_sha"]
    if text is None:
        found = F.aggregate(
            string_values(F.col("raw")), F.expr("0L"), lambda n, t: n + F.coalesce(occurrences(t, query), F.expr("0L"))
        )
        # A record without the literal's escaped or plain form has no match to count.
        parsed = F.try_parse_json("raw").isNotNull()
    else:
        found, parsed = occurrences(text, query), F.lit(True)
    counted = records.withColumns(
        {"match_count": F.when(parsed, found), "record_bytes": F.octet_length("raw").cast("long")}
    )
    hits = counted.filter(F.col("match_count") > 0)
    top = newest(
        hits.select(*by, "record_index", "match_count", "record_bytes"), by, [F.col("record_index")], limit
    ).drop("_rank")
    totals = counted.groupBy(*by).agg(
        F.count_if(F.col("match_count") > 0).alias("matched_records"),
        F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"),
        F.count_if(F.col("match_count").isNull()).alias("unsearchable_records"),
    ).withColumn("truncated", F.col("matched_records") > limit)
    return top, totals


def record_page(records: DataFrame, start: int, size: int) -> DataFrame:
    """A byte page of each record, cut back to whole characters, with the next offset."""
    raw = F.encode("raw", "UTF-8")
    total = F.octet_length("raw")

    def lead(at: Column) -> Column:
        """The last offset at or before ``at`` that starts a character."""
        tries = [
            F.when(~F.hex(F.substring(raw, at + 1 - back, F.lit(1))).rlike("^[89AB]"), at - back)
            for back in range(4)
        ]
        return F.when(at >= total, total).otherwise(F.coalesce(*tries, at))

    begin = lead(F.lit(start))
    end = lead(F.least(begin + size, total))
    return records.withColumns({"_b": begin}).withColumns({"_e": lead(F.least(F.col("_b") + size, total))}).select(
        *[c for c in records.columns if c != "raw"],
        F.decode(F.substring(raw, F.col("_b") + 1, F.col("_e") - F.col("_b")), "UTF-8").alias("text"),
        F.col("_b").cast("long").alias("start_byte"),
        F.when(F.col("_e") < total, F.col("_e").cast("long")).alias("next_byte"),
    )


def recall(cards: DataFrame, query: str | None = None, session: str = "*") -> DataFrame:
    """State cards of snapshots, best match first, then newest.

    ``cards``: snapshot_sha, ts, provider, session_id, record_index, text.
    """
    if session not in ("*", ""):
        cards = cards.filter(F.startswith("session_id", F.lit(session)))
    one = cards.groupBy("snapshot_sha", "record_index").agg(
        F.min_by(F.struct("ts", "provider", "session_id", "text"), "ts").alias("c")
    ).select("snapshot_sha", "record_index", "c.*")
    parsed = one.withColumn("card", parse_card("text")).filter(F.col("card").isNotNull())
    lists = ["concepts", "decisions", "files_touched", "errors", "open_tasks"]
    hay = F.lower(F.concat_ws(
        "\n",
        *[F.coalesce(F.col("card")[n], F.lit("")) for n in ("goal", "summary")],
        *[F.array_join(F.col("card")[n], "\n") for n in lists],
        *[F.coalesce(F.col("card")[n], F.lit("")) for n in ("current_work", "context")],
    ))
    score = F.lit(0).cast("long") if query is None else occurrences(hay, query.lower())
    scored = parsed.withColumn("score", score)
    if query is not None:
        scored = scored.filter(F.col("score") > 0)
    return scored.drop("text").orderBy(F.col("score").desc(), F.col("ts").desc())


def diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records in one snapshot and not in the other, and the count of each type per side.

    ``a`` and ``b``: record_index, record_sha, type.  One aggregate by hash finds both sides.
    """
    both = a.withColumn("_side", F.lit("a")).unionByName(b.withColumn("_side", F.lit("b")))
    sides = both.groupBy("record_sha").agg(
        F.count_if(F.col("_side") == "a").alias("_a"), F.count_if(F.col("_side") == "b").alias("_b")
    )
    # A repeated body is as many removed or added records as it has copies.
    changes = sides.filter((F.col("_a") == 0) | (F.col("_b") == 0)).select(
        "record_sha",
        F.when(F.col("_b") == 0, "removed").otherwise("added").alias("change"),
        (F.col("_a") + F.col("_b")).alias("records"),
    )
    types = both.groupBy(F.col("_side").alias("side"), "type").agg(F.count("*").alias("records"))
    return changes, types


def prune_plan(index: DataFrame, refs: DataFrame, keep: int, pinned: DataFrame | None = None):
    """What keeping the newest ``keep`` snapshots per stream would drop.

    ``index``: STREAM, append_order, sha256.  ``refs``: snapshot_sha, record_sha, bytes.
    Returns the dropped index rows, the unreachable records with their bytes, and totals.
    """
    kept = newest(index, STREAM, [F.col("append_order").desc()], keep).drop("_rank")
    roots = kept.select(F.col("sha256").alias("snapshot_sha"))
    if pinned is not None:
        roots = roots.unionByName(pinned.select(F.col("sha256").alias("snapshot_sha")))
    dropped = index.join(kept.select("append_order"), "append_order", "left_anti")
    live = refs.join(roots.distinct(), "snapshot_sha", "left_semi").select("record_sha").distinct()
    bodies = refs.groupBy("record_sha").agg(F.max("bytes").alias("bytes"))
    unreachable = bodies.join(live, "record_sha", "left_anti")
    totals = unreachable.groupBy().agg(
        F.count("*").alias("records_removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_reclaimed")
    )
    return dropped, unreachable, totals


def index_accounting(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, distinct sources and objects, bytes; and entries by origin."""
    origin = F.when(F.col("strategy").isNull(), "snapshot").otherwise(F.col("strategy"))
    totals = index.groupBy().agg(
        F.count("*").alias("entries"),
        F.count_distinct(F.struct(*STREAM)).alias("streams"),
        F.count_distinct("sha256").alias("objects"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return totals, index.groupBy(origin.alias("origin")).agg(F.count("*").alias("entries"))


def history(index: DataFrame) -> DataFrame:
    """One row per session: snapshots, extent, latest size, and how many carry each label."""
    return index.groupBy("provider", "session_id").agg(
        F.count("*").alias("snapshots"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("bytes", "append_order").alias("latest_bytes"),
        F.count_if(F.col("strategy") == "pre-compact").alias("pre_compact"),
        F.count_if(F.col("strategy") == "post-compact").alias("post_compact"),
    )


def verify_records(stored: DataFrame) -> DataFrame:
    """Stored records whose hash is not that of their body."""
    return stored.filter(F.sha2("raw", 256) != F.col("record_sha"))


def compaction_pairs(index: DataFrame, markers: DataFrame, cap: int = 5) -> DataFrame:
    """Adjacent snapshots across a compaction, newest first, at most ``cap`` per session.

    A pair is native where the count of provider markers rises, or a rewrite where the
    earlier snapshot carries the pre-compact label.  ``markers``: sha256, markers.
    """
    from palimpsest.operators.ordered import block, previous

    counted = index.join(markers, "sha256", "left").withColumn("markers", F.coalesce("markers", F.lit(0)))
    # Index rows are appended, so the append order is a dense position.
    seen = previous(
        counted, STREAM, [block("append_order"), F.col("append_order")],
        {"before_sha": F.col("sha256"), "before_markers": F.col("markers"), "before_label": F.col("strategy")},
    ).filter(F.col("before_sha").isNotNull() & (F.col("before_sha") != F.col("sha256")))
    how = F.when(F.col("markers") > F.col("before_markers"), "provider_native").when(
        F.col("before_label") == "pre-compact", "surgery_next"
    )
    pairs = seen.withColumn("how", how).filter(F.col("how").isNotNull())
    return newest(pairs, STREAM, [F.col("append_order").desc()], cap).select(
        *STREAM, "append_order", "before_sha", F.col("sha256").alias("after_sha"), "how"
    )

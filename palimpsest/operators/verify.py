"""Structural findings of transcripts: damaged records, broken ancestry, unpaired calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.operators.normalize import (
    CALL_KINDS, LINE, OUTPUT_KINDS, call_id, live_lines, supported_item, window_entries,
)
from palimpsest.operators.ordered import line_levels, newest
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut


def _finding(rows: DataFrame, code: str, severity: str = "error") -> DataFrame:
    line = F.col("line_index") if "line_index" in rows.columns else F.lit(None).cast("long")
    return rows.select(
        *KEYS, line.alias("line_index"), F.lit(severity).alias("severity"), F.lit(code).alias("code")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def verify_common(records: DataFrame) -> DataFrame:
    """Blank, damaged, ambiguous and torn records."""
    rec = F.col("rec")
    blank = F.trim("raw") == ""
    # A record whose repeated keys alone make it unreadable parses leniently.
    lenient = F.from_json("raw", "map<string,string>").isNotNull() & F.col("raw").rlike(r"^\s*\{.*\}\s*$")
    flat = records.select(
        *LINE,
        blank.alias("_blank"),
        (~blank & rec.isNotNull() & (~v.is_object(rec) | v.string(rec, "$.type").isNull())).alias("_odd"),
        (~blank & rec.isNull()).alias("_bad"),
        F.coalesce(lenient, F.lit(False)).alias("_lenient"),
    )
    bad = flat.filter(F.col("_bad") & ~F.col("_lenient"))
    sizes = flat.groupBy(*KEYS).agg(F.max("line_index").alias("_last"))
    many = bad.groupBy(*KEYS).agg(F.count("*").alias("_n")).join(sizes, KEYS)
    torn = (F.col("_n") == 1) & (F.col("line_index") == F.col("_last"))
    damaged = bad.select(*LINE).join(many, KEYS).withColumn("_torn", torn)
    return _union([
        _finding(flat.filter("_blank"), "blank_line", "warning"),
        _finding(flat.filter("_odd"), "invalid_record"),
        _finding(flat.filter(F.col("_bad") & F.col("_lenient")), "ambiguous_json"),
        _finding(damaged.filter("_torn"), "partial_tail", "warning"),
        _finding(damaged.filter(~F.col("_torn")), "invalid_json"),
    ])


def _present(c: Column) -> Column:
    return c.isNotNull()


def unanswered(calls: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Calls without a result on a later line.  The last result of an id decides."""
    last = results.groupBy(*keys, "call_id").agg(F.max("line_index").alias("_answer"))
    return calls.join(last, keys + ["call_id"], "left").filter(
        F.col("_answer").isNull() | (F.col("_answer") <= F.col("line_index"))
    )


def unasked(results: DataFrame, calls: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Results without a call on an earlier line.  The last listed call of an id decides."""
    last = calls.groupBy(*keys, "call_id").agg(F.max("line_index").alias("_asked"))
    return results.join(last, keys + ["call_id"], "left").filter(
        F.col("_asked").isNull() | (F.col("_asked") >= F.col("line_index"))
    )


def verify_branch(records: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Links, the chain head, and tool pairing on the live branch."""
    live = cut(live_lines(records), "live") if live is None else live
    rec, kind = F.col("rec"), v.string(F.col("rec"), "$.type")
    uuid, parent = v.string(rec, "$.uuid"), v.string(rec, "$.parentUuid")
    raw_uuid, raw_parent = v.get(rec, "$.uuid"), v.get(rec, "$.parentUuid")
    flat = cut(records.filter(v.is_object(rec)).select(
        *LINE, kind.alias("_type"), uuid.alias("uuid"), parent.alias("parent"),
        (_present(raw_uuid) & v.link_id(rec, "$.uuid").isNull()).alias("_bad_uuid"),
        (_present(raw_uuid) & _present(raw_parent) & (v.kind(raw_parent) != "VOID")
         & v.link_id(rec, "$.parentUuid").isNull()).alias("_bad_parent"),
        v.string(rec, "$.leafUuid").alias("leaf"),
    ), "links")
    first = flat.filter(F.col("uuid").isNotNull()).groupBy(*KEYS, "uuid").agg(
        F.min("line_index").alias("_first")
    )
    again = flat.join(first, KEYS + ["uuid"]).filter(F.col("line_index") > F.col("_first"))
    parents = first.select(*KEYS, F.col("uuid").alias("parent"), F.col("_first").alias("_parent_line"))
    children = flat.filter(F.col("uuid").isNotNull() & F.col("parent").isNotNull())
    orphans = children.join(parents, KEYS + ["parent"], "left").filter(
        F.col("_parent_line").isNull() | (F.col("_parent_line") >= F.col("line_index"))
    )
    prompt = flat.filter(F.col("_type") == "last-prompt")
    heads = prompt.filter(F.col("leaf").isNotNull()).groupBy(*KEYS).agg(
        F.max("line_index").alias("line_index"), F.max_by("leaf", "line_index").alias("uuid")
    )
    on = live.filter(F.col("state") == "live").select(*LINE)
    lit = on.select(*KEYS).distinct().withColumn("_has", F.lit(True))

    def side(role: str, shape: str, path: str) -> DataFrame:
        blocks = records.filter((kind == role) & (v.string(rec, "$.message.role") == role)).select(
            *LINE, F.posexplode(v.items(rec, "$.message.content")).alias("position", "block")
        )
        b = F.col("block")
        named = blocks.filter(v.string(b, "$.type") == shape).select(
            *LINE, "position", v.string(b, path).alias("call_id")
        ).filter(F.col("call_id").isNotNull())
        marked = named.join(on.withColumn("_on", F.lit(True)), LINE, "left").join(lit, KEYS, "left")
        return marked.filter(F.col("_has").isNull() | F.col("_on")).select(*LINE, "position", "call_id")

    calls = cut(side("assistant", "tool_use", "$.id"), "calls")
    results = cut(side("user", "tool_result", "$.tool_use_id"), "results")
    opened = calls.groupBy(*KEYS, "call_id").agg(
        F.min(F.struct("line_index", "position")).alias("_first")
    )
    twice = calls.join(opened, KEYS + ["call_id"]).filter(
        F.struct("line_index", "position") > F.col("_first")
    )
    return _union([
        _finding(flat.filter("_bad_uuid"), "invalid_uuid"),
        _finding(flat.filter("_bad_parent"), "invalid_parent_uuid"),
        _finding(prompt.filter(F.coalesce(F.col("leaf") == "", F.lit(True))), "invalid_chain_head"),
        _finding(orphans, "broken_parent_chain"),
        _finding(again, "duplicate_uuid"),
        _finding(heads.join(first.select(*KEYS, "uuid"), KEYS + ["uuid"], "left_anti"), "missing_chain_head"),
        _finding(twice, "duplicate_tool_call_id"),
        _finding(unanswered(calls, results), "orphaned_tool_use"),
        _finding(unasked(results, calls), "orphaned_tool_result", "warning"),
    ])


def verify_window(records: DataFrame) -> DataFrame:
    """Ordinals, compaction records, and tool pairing in the latest window."""
    rec, kind = F.col("rec"), v.string(F.col("rec"), "$.type")
    rows = records.filter(v.is_object(rec))
    raw, number = v.get(rec, "$.ordinal"), v.count(rec, "$.ordinal")
    ordinals = cut(rows.select(*LINE, raw.isNotNull().alias("_has"), number.alias("_n")), "ordinals")
    from palimpsest.operators.ordered import previous

    known = ordinals.filter(F.col("_n").isNotNull())
    before = previous(known, KEYS, line_levels(), {"_before": F.col("_n")})
    entries = cut(
        window_entries(rows).select(
            *LINE, "segment", "position",
            v.string(F.col("item"), "$.type").alias("_kind"),
            v.is_object(F.col("item")).alias("_object"),
            supported_item(F.col("item")).alias("_ok"),
            call_id(F.col("item")).alias("call_id"),
        ),
        "entries",
    )
    last = rows.select(*LINE, (kind == "compacted").alias("_c"))
    segments = last.groupBy(*KEYS).agg(F.coalesce(F.count_if("_c"), F.lit(0)).alias("_last"))
    inside = entries.join(segments, KEYS).filter(
        (F.col("segment") == F.col("_last")) & F.coalesce("_object", F.lit(False))
    )
    place = F.struct("line_index", "position")
    calls = inside.filter(F.col("_kind").isin(CALL_KINDS) & F.col("call_id").isNotNull())
    outputs = inside.filter(F.col("_kind").isin(OUTPUT_KINDS) & F.col("call_id").isNotNull())
    by_id = KEYS + ["call_id"]
    span = calls.groupBy(*by_id).agg(F.min(place).alias("_first"), F.max(place).alias("_last_call"))
    seen = outputs.groupBy(*by_id).agg(F.min(place).alias("_first_out"), F.max(place).alias("_last_out"))
    open_calls = span.join(seen, by_id, "left").filter(
        F.col("_last_out").isNull() | (F.col("_last_out") < F.col("_last_call"))
    ).select(*KEYS, F.col("_last_call.line_index").alias("line_index"))
    early = outputs.join(span, by_id, "left").filter(F.col("_first").isNull() | (F.col("_first") > place))
    return _union([
        _finding(before.filter(F.col("_n") < F.col("_before")), "non_monotonic_ordinal", "warning"),
        _finding(ordinals.filter(F.col("_has") & F.col("_n").isNull()), "invalid_ordinal"),
        _finding(rows.filter((kind == "compacted") & v.items(rec, "$.payload.replacement_history").isNull()), "malformed_compacted"),
        _finding(rows.filter((kind == "response_item") & ~v.is_object(v.get(rec, "$.payload"))), "invalid_response_item"),
        _finding(inside.filter(~F.col("_ok")), "unsupported_response_item", "warning"),
        _finding(calls.join(span, by_id).filter(place > F.col("_first")), "duplicate_tool_call_id"),
        _finding(early, "orphaned_tool_result", "warning"),
        _finding(outputs.join(seen, by_id).filter(place > F.col("_first_out")), "duplicate_tool_result", "warning"),
        _finding(open_calls, "unpaired_tool_call", "warning"),
    ])


def verify(records: DataFrame) -> DataFrame:
    """Findings of files of both dialects."""
    branch = records.filter(F.col("provider") == fixed.BRANCH)
    window = records.filter(F.col("provider") == fixed.WINDOW)
    return _union([verify_common(records), verify_branch(branch), verify_window(window)])


def empty_files(files: DataFrame) -> DataFrame:
    """Files without a record."""
    return files.filter(F.col("records") == 0).select(
        "path", F.lit("warning").alias("severity"), F.lit("empty").alias("code")
    )


def tail_items(records: DataFrame, n: int) -> DataFrame:
    """The last ``n`` supported items after the latest compaction, whole call pairs only."""
    rec, kind = F.col("rec"), v.string(F.col("rec"), "$.type")
    flat = records.select(
        *LINE, kind.alias("_type"), v.get(rec, "$.payload").alias("item"),
        (rec.isNull() | (kind == "compacted")).alias("_stop"),
    )
    stops = flat.filter("_stop").groupBy(*KEYS).agg(F.max("line_index").alias("_stop_line"))
    after = flat.join(stops, KEYS, "left").filter(
        (F.col("_type") == "response_item")
        & (F.col("_stop_line").isNull() | (F.col("line_index") > F.col("_stop_line")))
    )
    item = F.col("item")
    last = newest(after.filter(supported_item(item)), KEYS, [F.col("line_index").desc()], n).select(
        *LINE, v.string(item, "$.type").alias("kind"), call_id(item).alias("call_id"), "item"
    )
    paired = F.col("kind").isin(CALL_KINDS + OUTPUT_KINDS)
    pairs = last.filter(paired & F.col("call_id").isNotNull()).groupBy(*KEYS, "call_id").agg(
        F.count_if(F.col("kind").isin(CALL_KINDS)).alias("_calls"),
        F.count_if(F.col("kind").isin(OUTPUT_KINDS)).alias("_outs"),
        F.max(F.when(F.col("kind").isin(CALL_KINDS), F.col("line_index"))).alias("_at"),
        F.max(F.when(F.col("kind").isin(OUTPUT_KINDS), F.col("line_index"))).alias("_to"),
    ).filter((F.col("_calls") == 1) & (F.col("_outs") == 1) & (F.col("_at") < F.col("_to")))
    whole = last.filter(paired).join(pairs.select(*KEYS, "call_id"), KEYS + ["call_id"], "left_semi")
    return last.filter(~paired).unionByName(whole)

"""Records of both dialects as items and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.functions.hashes import fingerprint
from palimpsest.functions.tokens import tokens_of_bytes
from palimpsest.operators.ordered import exclusive_sums, last_known, line_levels, previous
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut
from palimpsest.sources.tables import ITEM_COLUMNS

LINE = KEYS + ["line_index"]
CALL_KINDS = ["function_call", "custom_tool_call", "local_shell_call"]
OUTPUT_KINDS = ["function_call_output", "custom_tool_call_output"]


def _rec() -> Column:
    return F.col("rec")


def _type() -> Column:
    return v.string(_rec(), "$.type")


def _first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(n))))


def _call_label(name: Column, args: Column) -> Column:
    short = F.when(F.length(args) > 80, F.concat(_first_chars(args, 80), F.lit("..."))).otherwise(args)
    return F.concat(name, F.lit("("), short, F.lit(")"))


def _text_or_json(value: Column) -> Column:
    return F.coalesce(v.string(value), F.to_json(value))


# --- live branch ---------------------------------------------------------------------------

def branch_links(records: DataFrame) -> DataFrame:
    """Links and flags of branch records, without their content."""
    rec, kind = _rec(), _type()
    uuid, parent = v.link_id(rec, "$.uuid"), v.link_id(rec, "$.parentUuid")
    raw_uuid, raw_parent = v.get(rec, "$.uuid"), v.get(rec, "$.parentUuid")
    bad_parent = raw_parent.isNotNull() & (v.kind(raw_parent) != "VOID") & parent.isNull()
    bad_link = raw_uuid.isNotNull() & (uuid.isNull() | bad_parent)
    boundary = F.coalesce(v.string(rec, "$.subtype") == "compact_boundary", F.lit(False))
    unlinked = raw_uuid.isNull() & (kind.isin("user", "assistant") | boundary)
    leaf = v.link_id(rec, "$.leafUuid")
    prompt = kind == "last-prompt"
    blank = F.trim("raw") == ""
    linked = raw_uuid.isNotNull() & ~bad_link
    return records.filter(~blank).select(
        *LINE,
        F.when(linked, uuid).alias("uuid"),
        F.when(linked, parent).alias("parent_uuid"),
        F.when(linked & kind.isin("user", "assistant", "attachment"), uuid).alias("fallback"),
        F.when(prompt, leaf).alias("leaf"),
        (~v.is_object(rec)).alias("invalid"),
        F.coalesce(bad_link | unlinked | (prompt & leaf.isNull()), F.lit(False)).alias("ambiguous"),
    )


def _linked_runs(links: DataFrame) -> DataFrame:
    """Links by file number with their run: link after link, each the child of the one before. Only the first of a run may be ``_bad``."""
    known = links.select("_file", F.col("uuid").alias("parent_uuid"), F.col("line_index").alias("_up"))
    rows = links.join(known, ["_file", "parent_uuid"], "left")
    good = F.col("parent_uuid").isNull() | F.coalesce(F.col("_up") < F.col("line_index"), F.lit(False))
    rows = cut(rows.select("_file", "line_index", "_up", (~good).alias("_bad")), "links")
    rows = previous(rows, ["_file"], line_levels(), {"_before": F.col("line_index")})
    follows = ~F.col("_bad") & F.coalesce(F.col("_up") == F.col("_before"), F.lit(False))
    return last_known(rows, ["_file"], line_levels(), {"_run": F.when(~follows, F.col("line_index"))})


def live_lines(records: DataFrame) -> DataFrame:
    """Live lines of branch files with the state of each file.

    A file's live lines lead from its leaf through parents, each on an earlier line, to a record without a parent. Records that follow one another
    as child and parent are one run, found block by block; of a run, the lines up to the one it is entered at are live. From
    run to run, pointer doubling reaches 2**k runs in round k: a file takes as many rounds as the binary
    logarithm of its forks, whatever its length, and no task needs to hold it. Rounds are cut, so a lost executor costs a re-read.
    A file without live lines has one row with line -1.
    """
    links = cut(branch_links(records), "branch-links")
    twice = links.filter("uuid is not null").groupBy(*KEYS, "uuid").agg(F.count("*").alias("_n")).filter("_n > 1").select(*KEYS).distinct()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_index")))
    files = links.groupBy(*KEYS).agg(
        F.bool_or("invalid").alias("_invalid"), F.bool_or("ambiguous").alias("_ambiguous"), F.count("uuid").alias("_links"),
        F.coalesce(last("leaf"), last("fallback")).alias("_leaf"),
    ).join(twice.withColumn("_twice", F.lit(True)), KEYS, "left")
    state = (
        F.when(F.col("_invalid"), "invalid_record").when(F.col("_ambiguous"), "invalid_ancestry")
        .when(F.col("_leaf").isNull(), F.when(F.col("_links") > 0, "invalid_ancestry").otherwise("none"))
        .when(F.col("_twice"), "invalid_ancestry")
    )
    files = cut(files.select(*KEYS, "_leaf", state.alias("state"), F.monotonically_increasing_id().alias("_file")), "files")
    open_files = files.filter("state is null")
    own = links.filter("uuid is not null").join(open_files.select(*KEYS, "_file", "_leaf"), KEYS)
    rows = cut(_linked_runs(own.select("_file", "line_index", "uuid", "parent_uuid")), "runs")
    leaf = own.filter(F.col("uuid") == F.col("_leaf")).select("_file", "line_index")
    met = cut(rows.join(leaf, ["_file", "line_index"]).select("_file", "_run", F.col("line_index").alias("_entry")), "met")
    start = rows.filter((F.col("line_index") == F.col("_run")) & ~F.col("_bad") & F.col("_up").isNotNull()).select("_file", "_run", F.col("_up").alias("_entry"))
    goal = rows.select("_file", F.col("line_index").alias("_entry"), F.col("_run").alias("_next"))
    jumps = cut(start.join(goal, ["_file", "_entry"]), "jumps")
    while True:
        further = cut(met.select("_file", "_run").join(jumps, ["_file", "_run"]).select("_file", F.col("_next").alias("_run"), "_entry"), "further")
        if further.isEmpty():
            break
        met = met.unionByName(further)
        second = jumps.select("_file", F.col("_run").alias("_next"), F.col("_next").alias("_to"), F.col("_entry").alias("_at"))
        jumps = cut(jumps.join(second, ["_file", "_next"]).select("_file", "_run", F.col("_to").alias("_next"), F.col("_at").alias("_entry")), "jumps")
    live = cut(rows.join(met, ["_file", "_run"]).filter(F.col("line_index") <= F.col("_entry")).select("_file", "line_index", "_bad"), "live-lines")
    sound = live.groupBy("_file").agg(F.bool_or("_bad").alias("_bad"))
    judged = files.join(sound, "_file", "left").withColumn(
        "state", F.coalesce("state", F.when(F.col("_bad") == F.lit(False), "live").otherwise("invalid_ancestry"))
    )
    lines = judged.filter("state = 'live'").select("_file", *KEYS, "state").join(live.select("_file", "line_index"), "_file")
    without = judged.filter("state <> 'live'").select(*KEYS, F.lit(-1).cast("long").alias("line_index"), "state")
    return lines.select(*KEYS, "line_index", "state").unionByName(without)


# --- branch dialect ------------------------------------------------------------------------

def branch_calls(records: DataFrame) -> DataFrame:
    """Tool-use blocks of assistant records: id, name, label."""
    rec = _rec()
    blocks = records.filter(_type() == "assistant").select(
        *LINE, F.posexplode(v.items(rec, "$.message.content")).alias("position", "block")
    )
    block = F.col("block")
    name = F.coalesce(v.string(block, "$.name"), F.lit("?"))
    args = F.coalesce(_text_or_json(v.get(block, "$.input")), F.lit("null"))
    return blocks.filter(v.string(block, "$.type") == "tool_use").select(
        *LINE, "position", v.string(block, "$.id").alias("call_id"), name.alias("name"),
        _call_label(name, args).alias("label"),
    ).filter(F.col("call_id").isNotNull())


def branch_results(records: DataFrame) -> DataFrame:
    """Tool-result blocks of user records: id, content, eligible bytes."""
    blocks = records.filter(_type() == "user").select(
        *LINE, F.posexplode(v.items(_rec(), "$.message.content")).alias("position", "block")
    )
    block = F.col("block")
    content = v.get(block, "$.content")
    return blocks.filter(v.string(block, "$.type") == "tool_result").select(
        *LINE, "position", v.string(block, "$.tool_use_id").alias("call_id"),
        v.payload_text(content).alias("text"),
        v.eligible_bytes(content).alias("bytes"),
        F.to_json(content).alias("content_json"),
    )


def label_results(results: DataFrame, calls: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Results with the name and label of the latest earlier call of their id."""
    place = keys + ["line_index", "position"]
    sides = results.select(*place, "call_id").filter(F.col("call_id").isNotNull()).join(
        calls.select(*keys, "call_id", F.col("line_index").alias("_at"), F.col("position").alias("_pos"),
                     "name", "label"),
        keys + ["call_id"],
    ).filter(F.col("_at") <= F.col("line_index"))
    latest = sides.groupBy(*place).agg(
        F.max_by(F.struct("name", "label"), F.struct("_at", "_pos")).alias("_call")
    )
    return results.join(latest, place, "left").select(
        results["*"], F.col("_call.name").alias("name"), F.col("_call.label").alias("label")
    )


def _duplicate_calls(calls: DataFrame) -> DataFrame:
    return (
        calls.groupBy(*KEYS, "call_id").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > 1).select(*KEYS).distinct()
    )


def items_branch(records: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Items of branch files.  Rows off the live branch keep identity and lose the rest."""
    live = cut(live_lines(records), "live") if live is None else live
    on = live.filter(F.col("state") == "live").select(*LINE, F.lit(True).alias("_live"))
    alive = on.select(*KEYS).distinct().withColumn("_has_live", F.lit(True))
    rec, kind = _rec(), _type()
    calls = branch_calls(records).join(on.select(*LINE), LINE, "left_semi")
    results = label_results(branch_results(records), calls)
    ordered = F.array_sort(F.collect_list(F.struct(
        "position", "call_id", "name", "label", "text", "bytes", "content_json"
    )))
    per_line = results.groupBy(*LINE).agg(ordered.alias("_r"))
    eligible = F.filter("_r", lambda r: r.bytes > 0)
    parts = F.transform("_r", lambda r: F.concat(
        F.coalesce(r.label, F.lit("?")), F.lit(" => "), _tail(r.text, 120)
    ))
    ids = F.transform(F.filter(eligible, lambda r: r.call_id.isNotNull()), lambda r: r.call_id)
    names = F.array_sort(F.array_distinct(F.transform(
        F.filter(eligible, lambda r: r["name"].isNotNull()), lambda r: r["name"]
    )))
    result_rows = per_line.select(
        *LINE,
        F.aggregate("_r", F.expr("0L"), lambda n, r: n + r.bytes).alias("_bytes"),
        F.size(eligible).alias("_parts"),
        ids.alias("_ids"),
        F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise("tool_result").alias("_label"),
        _first_chars(F.array_join(parts, "; "), 240).alias("_summary"),
        F.when(F.size(eligible) > 0, fingerprint(F.transform(eligible, lambda r: r.content_json))).alias("_hash"),
    )
    prompt = v.payload_text(v.get(rec, "$.message.content"))
    base = records.filter(kind.isin("user", "assistant", "system", "attachment")).select(
        *LINE,
        kind.alias("_type"),
        tokens_of_bytes(F.octet_length(v.json(v.get(rec, "$.message")))).alias("_est"),
        F.when(prompt != "", _first_chars(prompt, 200)).alias("_prompt"),
        v.string(rec, "$.uuid").alias("uuid"),
        v.string(rec, "$.parentUuid").alias("parent_uuid"),
        v.link_id(rec, "$.uuid").isNotNull().alias("_linked"),
    )
    twice = _duplicate_calls(calls).withColumn("_twice", F.lit(True))
    joined = (
        base.join(result_rows, LINE, "left").join(on, LINE, "left")
        .join(alive, KEYS, "left").join(twice, KEYS, "left")
    )
    is_result = (F.col("_type") == "user") & F.coalesce(F.col("_bytes") > 256, F.lit(False))
    size = F.when(is_result, F.col("_bytes"))
    has_live = F.coalesce("_has_live", F.lit(False))
    is_live = F.coalesce("_live", F.lit(False))
    lost = (
        F.coalesce("_twice", F.lit(False)) | ~has_live | (F.col("_linked") & ~is_live)
        | (is_result & ~F.col("_linked"))
    )
    label = F.when(is_result, F.col("_label")).otherwise(F.col("_type"))
    suffix = F.when(has_live, " (dead branch)").otherwise(" (unresolved branch)")
    none = F.expr("cast(array() as array<string>)")
    shown_kind = (
        F.when(is_result, "tool_result")
        .when(F.col("_type") == "attachment", "meta").otherwise(F.col("_type"))
    )
    return joined.select(
        *LINE,
        shown_kind.alias("kind"),
        F.when(lost, 0).otherwise(F.col("_est")).cast("long").alias("est_tokens"),
        F.when(~lost, size).alias("elidable_bytes"),
        F.when(is_result & ~lost, F.col("_parts")).otherwise(0).cast("int").alias("elidable_parts"),
        F.when(lost, F.concat(label, suffix)).otherwise(label).alias("label"),
        F.when(is_result, F.col("_summary")).when(F.col("_type") == "user", F.col("_prompt")).alias("summary"),
        "uuid",
        "parent_uuid",
        F.when(is_result & ~lost, F.col("_ids")).otherwise(none).alias("tool_use_ids"),
        F.when(is_result & ~lost, F.col("_hash")).alias("payload_sha256"),
    ).select(*ITEM_COLUMNS)


def usage_components(records: DataFrame) -> DataFrame:
    """Usage of each assistant record: four components, complete total, subtotal, reason."""
    usage = v.get(_rec(), "$.message.usage")
    names = {
        "input": ("input_tokens", False),
        "cache_read": ("cache_read_input_tokens", True),
        "cache_creation": ("cache_creation_input_tokens", True),
        "output": ("output_tokens", True),
    }
    rows = records.filter(_type() == "assistant").select(*LINE, usage.alias("_u"))
    u = F.col("_u")
    whole = v.is_object(u)
    columns, flags = {}, {"null": [], "malformed": [], "missing": []}
    for out, (name, optional) in names.items():
        raw = v.get(u, f"$.{name}")
        n = v.count(u, f"$.{name}")
        columns[out] = F.when(whole, F.when(raw.isNull() & F.lit(optional), F.lit(0)).otherwise(n)).cast("long")
        flags["null"].append(F.coalesce(v.kind(raw) == "VOID", F.lit(False)))
        flags["malformed"].append(raw.isNotNull() & (F.coalesce(v.kind(raw), F.lit("")) != "VOID") & n.isNull())
        flags["missing"].append(raw.isNull() & F.lit(not optional))

    def anyof(name: str) -> Column:
        return F.greatest(F.lit(False), *flags[name])

    said = (
        F.when(u.isNull(), "missing_component")
        .when(~whole, "malformed_component")
        .when(anyof("malformed"), "malformed_component")
        .when(anyof("null"), "null_component")
        .when(anyof("missing"), "missing_component")
    )
    parts = [F.col(n) for n in names]

    def add(cols: list[Column]) -> Column:
        total = cols[0]
        for c in cols[1:]:
            total = F.try_add(total, c)
        return total

    known = F.greatest(F.lit(False), *[c.isNotNull() for c in parts])
    rows = rows.withColumns(columns).withColumn("_said", said)
    subtotal = F.when(known, add([F.coalesce(c, F.expr("0L")) for c in parts]))
    total = add(parts)
    input_total = add([F.coalesce(F.col(n), F.expr("0L")) for n in ("input", "cache_read", "cache_creation")])
    rows = rows.withColumns({"subtotal": subtotal, "_total": total, "_inclusive": input_total})
    complete = F.col("_total").isNotNull() & F.col("_said").isNull()
    reason = F.when(
        ~complete,
        F.when(known & F.col("subtotal").isNull(), "overflow").otherwise(
            F.coalesce("_said", F.lit("missing_component"))
        ),
    )
    return rows.select(
        *LINE, *names, "subtotal",
        F.when(complete, F.col("_total")).alias("context_tokens"),
        reason.alias("reason"),
        F.coalesce("_inclusive", F.expr("0L")).alias("lifetime_input"),
        F.least(F.coalesce("cache_read", F.expr("0L")), F.coalesce("_inclusive", F.expr("0L"))).alias("lifetime_cached"),
        (~complete | F.col("_inclusive").isNull()).alias("partial"),
    )


def usage_branch(records: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Usage of branch files: context of the newest live reading, additive lifetime totals."""
    live = cut(live_lines(records), "live") if live is None else live
    on = live.filter(F.col("state") == "live").select(*LINE)
    parts = usage_components(records)
    lifetime = parts.groupBy(*KEYS).agg(
        F.sum(F.col("lifetime_input").cast("decimal(38,0)")).alias("lifetime_input_tokens"),
        F.sum(F.col("lifetime_cached").cast("decimal(38,0)")).alias("lifetime_cached_tokens"),
        F.bool_or("partial").alias("_partial"),
    )
    sample = parts.join(on, LINE, "left_semi").groupBy(*KEYS).agg(
        F.max("line_index").alias("_sample"),
        F.max_by(F.struct("context_tokens", "reason", "subtotal"), "line_index").alias("_read"),
    )
    resets = (
        records.filter(v.string(_rec(), "$.subtype") == "compact_boundary")
        .join(on, LINE, "left_semi").groupBy(*KEYS).agg(F.max("line_index").alias("_reset"))
    )
    state = live.groupBy(*KEYS).agg(F.first("state").alias("_state"))
    joined = state.join(lifetime, KEYS, "left").join(sample, KEYS, "left").join(resets, KEYS, "left")
    broken = F.col("_state").isin("invalid_record", "invalid_ancestry")
    reset = F.col("_reset").isNotNull() & F.coalesce(F.col("_reset") > F.col("_sample"), F.lit(True))
    context = (
        F.when(reset, "reset").when(broken, "unknown").when(F.col("_sample").isNull(), "absent")
        .when(F.col("_read.context_tokens").isNotNull(), "reported").otherwise("unknown")
    )
    return joined.withColumn("context_state", context).select(
        *KEYS,
        "context_state",
        F.when(F.col("context_state") == "reported", F.col("_read.context_tokens")).alias("reported_context"),
        F.when(F.col("context_state") == "unknown", F.coalesce(F.when(broken, F.col("_state")), F.col("_read.reason"))).alias("context_reason"),
        F.when((F.col("context_state") == "unknown") & ~broken, F.col("_read.subtotal")).alias("measured_subtotal"),
        F.when(broken | F.coalesce("_partial", F.lit(False)), "partial")
        .when(F.col("lifetime_input_tokens").isNull(), "absent").otherwise("full").alias("lifetime_scope"),
        F.col("lifetime_input_tokens").cast("long").alias("lifetime_input_tokens"),
        F.least("lifetime_cached_tokens", "lifetime_input_tokens").cast("long").alias("lifetime_cached_tokens"),
        F.lit(None).cast("long").alias("model_context_window"),
        F.lit(None).cast("long").alias("recorded_tokens"),
    )


def context_hint() -> Column:
    """Best signal of context: reported, else a recorded total, else the measured subtotal."""
    return F.coalesce(
        "reported_context",
        F.when((F.col("context_state") == "unknown") & (F.col("recorded_tokens") > 0), F.col("recorded_tokens")),
        "measured_subtotal",
    )


# --- window dialect ------------------------------------------------------------------------

def call_id(payload: Column) -> Column:
    """Call id of an item: the first of three keys that is present."""
    first = F.coalesce(*[v.get(payload, p) for p in ("$.call_id", "$.tool_call_id", "$.id")])
    return v.link_id(first, "$")


def output_text(payload: Column) -> Column:
    kind, output = v.string(payload, "$.type"), v.get(payload, "$.output")
    blocks = F.filter(v.items(output), lambda b: v.string(b, "$.type") == "input_text")
    joined = F.concat_ws("", F.transform(blocks, lambda b: F.coalesce(v.string(b, "$.text"), F.lit(""))))
    return F.when(kind == "function_call_output", v.string(output)).when(
        kind == "custom_tool_call_output", F.when(v.items(output).isNotNull(), joined)
    )


def supported_item(payload: Column) -> Column:
    """An item of a shape this package may rewrite."""
    kind = v.string(payload, "$.type")
    content, output = v.get(payload, "$.content"), v.get(payload, "$.output")
    known = F.array(*[F.lit(k) for k in (
        "type", "output", "call_id", "tool_call_id", "id", "internal_chat_message_metadata_passthrough"
    )])
    plain = F.size(F.array_except(F.json_object_keys(F.to_json(payload)), known)) == 0
    message = v.string(payload, "$.role").isin("user", "assistant", "system", "developer") & (
        (F.size(v.items(content)) == 0) | v.supported_content(content)
    )
    inputs = F.forall(v.items(output), lambda b: F.coalesce(v.string(b, "$.type") == "input_text", F.lit(False)))
    ok = (
        F.when(kind == "message", message)
        .when(kind.isin(CALL_KINDS), call_id(payload).isNotNull())
        .when(kind == "function_call_output", call_id(payload).isNotNull() & plain & v.string(output).isNotNull())
        .when(kind == "custom_tool_call_output",
              call_id(payload).isNotNull() & plain & v.supported_content(output) & F.coalesce(inputs, F.lit(False)))
        .when(kind.isin("reasoning", "agent_message"), True)
    )
    return F.coalesce(ok, F.lit(False))


def _item_bytes(payload: Column) -> Column:
    size = F.octet_length(output_text(payload)).cast("long")
    output = v.get(payload, "$.output")
    return F.when(supported_item(payload) & v.supported_content(output) & (size > 256), size)


def _item_kind(payload: Column) -> Column:
    kind, role = v.string(payload, "$.type"), v.string(payload, "$.role")
    return (
        F.when(kind == "message",
               F.when(role == "user", "user").when(role == "assistant", "assistant")
               .when(role.isin("system", "developer"), "system").otherwise("meta"))
        .when(kind == "agent_message", "assistant")
        .when(kind.isin(CALL_KINDS), "tool_call")
        .when(kind.isin(OUTPUT_KINDS), "tool_result")
        .when(kind == "reasoning", "reasoning")
        .otherwise("meta")
    )


def with_segment(records: DataFrame) -> DataFrame:
    """Window records with the number of compactions at or before them."""
    marked = records.withColumn("_cut", (F.coalesce(_type() == "compacted", F.lit(False))).cast("long"))
    counted = exclusive_sums(marked, KEYS, line_levels(), {"_earlier": F.col("_cut")})
    return counted.withColumn("segment", F.col("_earlier") + F.col("_cut")).drop("_cut", "_earlier")


def window_entries(records: DataFrame) -> DataFrame:
    """Items of the log and of replacement histories: LINE, segment, position, item, in_history."""
    rows = with_segment(records.filter(_type().isin("response_item", "compacted")))
    plain = rows.filter(_type() == "response_item").select(
        *LINE, "segment", F.lit(0).alias("position"), v.get(_rec(), "$.payload").alias("item"),
        F.lit(False).alias("in_history"),
    )
    history = rows.filter(_type() == "compacted").select(
        *LINE, "segment",
        F.posexplode(v.items(_rec(), "$.payload.replacement_history")).alias("position", "item"),
        F.lit(True).alias("in_history"),
    )
    return plain.unionByName(history)


def items_window(records: DataFrame) -> DataFrame:
    """Items of window files.  Rows before the last compaction keep identity and lose the rest."""
    entries = cut(window_entries(records), "entries")
    item = F.col("item")
    name = F.coalesce(v.string(item, "$.name"), F.when(v.get(item, "$.name").isNull(), v.string(item, "$.command")), F.lit("?"))
    args = F.coalesce(_text_or_json(F.coalesce(v.get(item, "$.arguments"), v.get(item, "$.input"))), F.lit(""))
    keyed = KEYS + ["segment"]
    calls = entries.filter(v.string(item, "$.type").isin(CALL_KINDS)).select(
        *LINE, "segment", "position", call_id(item).alias("call_id"), name.alias("name"),
        _call_label(name, args).alias("label"),
    ).filter(F.col("call_id").isNotNull())
    plain = entries.filter(~F.col("in_history")).withColumn("call_id", call_id(item))
    named = label_results(plain.select(*LINE, "segment", "position", "call_id"), calls, keyed)
    rows = plain.join(
        named.select(*LINE, F.col("name").alias("_name"), F.col("label").alias("_call")), LINE, "left"
    )
    kind, text = _item_kind(item), output_text(item)
    size = _item_bytes(item)
    prompt = v.payload_text(v.get(item, "$.content"))
    summary = F.when(kind == "user", F.when(prompt != "", _first_chars(prompt, 200))).when(
        kind == "tool_result",
        F.when(text != "", _first_chars(
            F.concat(F.coalesce("_call", F.lit("?")), F.lit(" => "), _tail(text, 180)), 240)),
    )
    none = F.expr("cast(array() as array<string>)")
    log_items = rows.select(
        *LINE, "segment",
        kind.alias("kind"),
        F.when(kind == "meta", 0).otherwise(tokens_of_bytes(F.octet_length(v.json(item)))).cast("long").alias("est_tokens"),
        size.alias("elidable_bytes"),
        F.when(size.isNotNull(), 1).otherwise(0).alias("elidable_parts"),
        F.coalesce("_name", v.string(item, "$.type"), F.lit("")).alias("label"),
        summary.alias("summary"),
        F.when((kind == "tool_result") & F.col("call_id").isNotNull(), F.array("call_id")).otherwise(none).alias("tool_use_ids"),
        F.when(size.isNotNull(), fingerprint(F.array(F.to_json(v.get(item, "$.output"))))).alias("payload_sha256"),
    )
    ids = records.select(
        *LINE,
        F.coalesce(v.string(_rec(), "$.id"), F.when(v.get(_rec(), "$.id").isNull(), v.string(_rec(), "$.payload.id"))).alias("uuid"),
        v.string(_rec(), "$.parent_id").alias("parent_uuid"),
    )
    histories = entries.filter("in_history").groupBy(*LINE).agg(
        F.bool_and(supported_item(item)).alias("_ok"),
        F.sum(size).alias("_bytes"),
        F.count(size).alias("_parts"),
        F.array_sort(F.collect_list(F.when(size.isNotNull(), F.struct("position", F.to_json(v.get(item, "$.output")).alias("o"))))).alias("_outs"),
    )
    compacted = (
        with_segment(records.filter(_type().isin("response_item", "compacted"))).filter(_type() == "compacted")
        .join(histories, LINE, "left")
    )
    raw_history = v.get(_rec(), "$.payload.replacement_history")
    live_bytes = F.when(F.col("_ok") & (F.col("_bytes") > 0), F.col("_bytes"))
    cards = compacted.select(
        *LINE, "segment",
        F.lit("tool_result").alias("kind"),
        tokens_of_bytes(F.when(raw_history.isNull(), 0).otherwise(F.octet_length(v.json(raw_history)))).alias("est_tokens"),
        live_bytes.alias("elidable_bytes"),
        F.when(live_bytes.isNotNull(), F.col("_parts")).otherwise(0).cast("int").alias("elidable_parts"),
        F.lit("compacted").alias("label"),
        F.lit(None).cast("string").alias("summary"),
        none.alias("tool_use_ids"),
        F.when(live_bytes.isNotNull(), fingerprint(F.transform("_outs", lambda o: o.o))).alias("payload_sha256"),
    )
    everything = log_items.unionByName(cards).join(ids, LINE, "left")
    last = everything.groupBy(*KEYS).agg(F.max("segment").alias("_last"))
    bad = ambiguous_windows(records, entries).withColumn("_bad", F.lit(True))
    joined = everything.join(last, KEYS).join(bad, KEYS, "left")
    # Items of the last compaction's segment are live; a compaction starts its own segment.
    lost = (F.col("segment") < F.col("_last")) | F.coalesce("_bad", F.lit(False))
    return joined.select(
        *LINE, "kind",
        F.when(lost, 0).otherwise(F.col("est_tokens")).cast("long").alias("est_tokens"),
        F.when(~lost, F.col("elidable_bytes")).alias("elidable_bytes"),
        F.when(lost, 0).otherwise(F.col("elidable_parts")).cast("int").alias("elidable_parts"),
        "label", "summary", "uuid", "parent_uuid",
        F.when(lost, none).otherwise(F.col("tool_use_ids")).alias("tool_use_ids"),
        F.when(~lost, F.col("payload_sha256")).alias("payload_sha256"),
    ).select(*ITEM_COLUMNS)


def ambiguous_windows(records: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Window files whose identity is ambiguous: their items count nothing."""
    rec = _rec()
    ordinal = v.get(rec, "$.ordinal")
    bad = (
        ((F.trim("raw") != "") & ~v.is_object(rec))
        | (ordinal.isNotNull() & v.count(rec, "$.ordinal").isNull())
        | (F.coalesce(_type() == "compacted", F.lit(False)) & v.items(rec, "$.payload.replacement_history").isNull())
    )
    broken = records.filter(bad).select(*KEYS)
    entries = window_entries(records) if entries is None else entries
    last = entries.groupBy(*KEYS).agg(F.max("segment").alias("_last"))
    item = F.col("item")
    shape = F.when(v.string(item, "$.type").isin(CALL_KINDS), "call").when(
        v.string(item, "$.type").isin(OUTPUT_KINDS), "output"
    )
    twice = (
        entries.join(last, KEYS).filter(F.col("segment") == F.col("_last"))
        .select(*KEYS, call_id(item).alias("call_id"), shape.alias("_shape"))
        .filter(F.col("call_id").isNotNull() & F.col("_shape").isNotNull())
        .groupBy(*KEYS, "call_id", "_shape").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    )
    return broken.unionByName(twice.select(*KEYS)).distinct()


def usage_window(records: DataFrame) -> DataFrame:
    """Usage of window files: the last report of each cumulative counter wins."""
    rec, kind = _rec(), _type()
    record = kind == "token_usage_record"
    event = (kind == "event_msg") & (v.string(rec, "$.payload.type") == "token_count")
    last = F.when(record, v.get(rec, "$.payload.usage")).when(event, v.get(rec, "$.payload.info.last_token_usage"))
    total = F.when(record, v.get(rec, "$.payload.thread_token_usage")).when(
        event, v.get(rec, "$.payload.info.total_token_usage")
    )
    room = F.when(record, v.count(rec, "$.payload.model_context_window")).when(
        event, v.count(rec, "$.payload.info.model_context_window")
    )
    rows = records.filter(record | event | (kind == "compacted")).select(
        *LINE, (kind == "compacted").alias("_reset"), last.alias("_l"), total.alias("_t"), room.alias("_room")
    )
    low, high = F.col("_l"), F.col("_t")

    def malformed(value: Column, *names: str) -> Column:
        return F.greatest(F.lit(False), *[
            v.get(value, f"$.{n}").isNotNull() & v.count(value, f"$.{n}").isNull() for n in names
        ])

    context = F.try_add(v.count(low, "$.input_tokens"), F.coalesce(v.count(low, "$.output_tokens"), F.expr("0L")))
    read = rows.select(
        *LINE,
        context.alias("_context"),
        v.count(high, "$.input_tokens").alias("_input"),
        v.count(high, "$.cached_input_tokens").alias("_cached"),
        F.when(F.col("_room") > 0, F.col("_room")).alias("_room"),
        F.when(F.col("_reset"), "reset")
        .when(malformed(low, "input_tokens", "output_tokens"), "unknown")
        .when(context.isNotNull(), "reported").alias("_state"),
        F.when(malformed(high, "input_tokens", "cached_input_tokens"), "partial")
        .when(v.count(high, "$.input_tokens").isNotNull(), "full").alias("_scope"),
    )
    line = F.col("line_index")

    def newest_of(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), line))

    known = last_known(read, KEYS, line_levels(), {"_input_now": F.col("_input")})
    sums = known.groupBy(*KEYS).agg(
        F.max_by(F.struct("_state", "_context"), F.when(F.col("_state").isNotNull(), line)).alias("_c"),
        newest_of("_input").alias("_input"),
        F.max_by(F.struct("_cached", "line_index"), F.when(F.col("_cached").isNotNull(), line)).alias("_cached"),
        newest_of("_room").alias("_room"),
        newest_of("_scope").alias("_scope"),
    )
    # Cached input is clipped to the input known at its report and at every later one.
    clips = (
        known.join(sums.select(*KEYS, F.col("_cached.line_index").alias("_from")), KEYS)
        .filter(line >= F.col("_from")).groupBy(*KEYS)
        .agg(F.min(F.coalesce("_input_now", F.expr("0L"))).alias("_clip"))
    )
    files = records.select(*KEYS).distinct()
    bad = ambiguous_windows(records).withColumn("_bad", F.lit(True))
    joined = files.join(sums, KEYS, "left").join(clips, KEYS, "left").join(bad, KEYS, "left")
    broken = F.coalesce("_bad", F.lit(False))
    state = F.when(broken, "unknown").otherwise(F.coalesce("_c._state", F.lit("absent")))
    return joined.withColumn("context_state", state).select(
        *KEYS,
        "context_state",
        F.when(F.col("context_state") == "reported", F.col("_c._context")).alias("reported_context"),
        F.lit(None).cast("string").alias("context_reason"),
        F.lit(None).cast("long").alias("measured_subtotal"),
        F.when(broken, "partial").otherwise(F.coalesce("_scope", F.lit("absent"))).alias("lifetime_scope"),
        F.coalesce("_input", F.expr("0L")).alias("lifetime_input_tokens"),
        F.least(F.coalesce("_cached._cached", F.expr("0L")), F.coalesce("_clip", F.expr("0L"))).alias("lifetime_cached_tokens"),
        F.col("_room").alias("model_context_window"),
        F.lit(None).cast("long").alias("recorded_tokens"),
    )


def items(records: DataFrame) -> DataFrame:
    """Items of files of both dialects."""
    branch = records.filter(F.col("provider") == fixed.BRANCH)
    window = records.filter(F.col("provider") == fixed.WINDOW)
    return items_branch(branch).unionByName(items_window(window))


def usage(records: DataFrame) -> DataFrame:
    branch = records.filter(F.col("provider") == fixed.BRANCH)
    window = records.filter(F.col("provider") == fixed.WINDOW)
    return usage_branch(branch).unionByName(usage_window(window))

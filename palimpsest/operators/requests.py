"""Request histories: rebuild, request points, repeated reads, prefixes, calibration, carried words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.functions.hashes import position_digest
from palimpsest.operators.ordered import exclusive_sums, line_levels, newest, previous
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut

LINE = KEYS + ["line_index"]


def dialect_of(path: str | Column) -> Column:
    """API dialect of a request path; NULL for probes and other paths."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    return (
        F.when(F.endswith(bare, F.lit("/messages")), "anthropic")
        .when(F.endswith(bare, F.lit("/chat/completions")), "chat_completions")
        .when(F.endswith(bare, F.lit("/responses")), "responses")
    )


def message_history(records: DataFrame) -> DataFrame:
    """Messages of branch files: assistant records of one message id in a row become one.

    Starts after the last compaction, on the chain of the file's first record.  Returns
    LINE (of the first record), role, message_id, blocks, text, reported_input.
    """
    rec, kind = F.col("rec"), v.string(F.col("rec"), "$.type")
    side = F.coalesce(F.try_variant_get(rec, "$.isSidechain", "boolean"), F.lit(False))
    boundary = (kind == "system") & (v.string(rec, "$.subtype") == "compact_boundary")
    flat = records.select(
        *LINE, kind.alias("_kind"), side.alias("_side"), F.coalesce(boundary, F.lit(False)).alias("_cut"),
        v.get(rec, "$.message").alias("message"),
    )
    facts = flat.groupBy(*KEYS).agg(
        F.max(F.when(F.col("_cut"), F.col("line_index"))).alias("_from"),
        F.min_by("_side", F.when(F.col("_kind").isin("user", "assistant"), F.col("line_index"))).alias("_own"),
    )
    message = F.col("message")
    kept = flat.join(facts, KEYS).filter(
        F.col("_kind").isin("user", "assistant")
        & (F.col("_side") == F.coalesce("_own", F.lit(False)))
        & (F.col("_from").isNull() | (F.col("line_index") > F.col("_from")))
        & message.isNotNull()
    ).select(
        *LINE,
        F.coalesce(v.string(message, "$.role"), F.col("_kind")).alias("role"),
        v.string(message, "$.id").alias("message_id"),
        v.get(message, "$.content").alias("content"),
        reported_input("anthropic", v.get(message, "$.usage")).alias("reported_input"),
    )
    # Records between two of one assistant message do not split it unless they are messages.
    seen = previous(kept, KEYS, line_levels(), {"_role": F.col("role"), "_id": F.col("message_id")})
    same = (F.col("role") == "assistant") & (F.col("_role") == "assistant") & (F.col("message_id") == F.col("_id"))
    started = seen.withColumn("_start", (~F.coalesce(same, F.lit(False))).cast("long"))
    numbered = exclusive_sums(started, KEYS, line_levels(), {"_n": F.col("_start")}).withColumn(
        "message_index", F.col("_n") + F.col("_start") - 1
    )
    parts = F.array_sort(F.collect_list(F.struct("line_index", F.to_json("content").alias("content"))))
    return numbered.groupBy(*KEYS, "message_index").agg(
        F.min("line_index").alias("line_index"),
        F.first("role").alias("role"),
        F.first("message_id").alias("message_id"),
        F.min_by("reported_input", "line_index").alias("reported_input"),
        F.transform(parts, lambda p: p.content).alias("contents"),
    )


def reported_input(dialect: str, usage: Column) -> Column:
    """Input tokens a usage object reports; NULL without a number."""
    if dialect == "chat_completions":
        return v.count(usage, "$.prompt_tokens")
    if dialect == "responses":
        return v.count(usage, "$.input_tokens")
    total = v.count(usage, "$.input_tokens")
    for name in ("cache_creation_input_tokens", "cache_read_input_tokens"):
        raw = v.get(usage, f"$.{name}")
        absent = raw.isNull() | (v.kind(raw) == "VOID")
        total = F.try_add(total, F.when(absent, F.expr("0L")).otherwise(v.count(usage, f"$.{name}")))
    return total


def request_points(messages: DataFrame, keys: list[str], position: str = "message_index") -> DataFrame:
    """Messages after which a request was sent: input, then a model turn or the end.

    ``messages``: keys, position, assistant.
    """
    back = line_levels(position, newest_first=True)
    seen = previous(messages, keys, back, {"_next": F.col("assistant")})
    return seen.filter(~F.col("assistant") & F.coalesce("_next", F.lit(True))).drop("_next")


def read_key(name: Column, args: Column) -> Column:
    """What makes two reads the same: the url, the file with its range, or the whole input."""
    url, path = v.string(args, "$.url"), v.string(args, "$.file_path")
    return (
        F.when(url.isNotNull(), F.to_json(F.array(name, F.lit("url"), url)))
        .when(
            path.isNotNull(),
            F.concat_ws(" ", F.to_json(F.array(name, F.lit("file"), path)),
                        v.json(v.get(args, "$.offset")), v.json(v.get(args, "$.limit"))),
        )
        .otherwise(F.to_json(F.array(name, F.lit("input"), v.json(args))))
    )


def repeated_reads(calls: DataFrame, results: DataFrame, keys: list[str], position: str = "line_index") -> DataFrame:
    """Repeated reads per session, and those whose earlier result is present.

    ``calls``: keys, position, call_id, read_key.  ``results``: keys, call_id.  A repeat
    is covered where an earlier call of its key has its result.
    """
    answered = results.select(*keys, "call_id").distinct().withColumn("_has", F.lit(True))
    marked = calls.join(answered, keys + ["call_id"], "left")
    by_key = keys + ["read_key"]
    firsts = marked.groupBy(*by_key).agg(
        F.min(position).alias("_first"),
        F.min(F.when(F.col("_has"), F.col(position))).alias("_kept"),
    )
    seen = marked.join(firsts, by_key)
    again = F.col(position) > F.col("_first")
    return seen.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.count_if(again).alias("repeated_reads"),
        F.count_if(again & F.coalesce(F.col("_kept") < F.col(position), F.lit(False))).alias(
            "repeated_reads_covered"
        ),
    )


MARKERS = ["cache_control", "signature"]


def _plain_content(content: Column, nested: bool) -> Column:
    """Content as text without markers; a string is one text block. With ``nested``, contents of tool results too."""

    def block(b: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(b, "$", "map<string,variant>"))
        told = F.coalesce(v.string(b, "$.type") == "tool_result", F.lit(False))

        def field(e: Column) -> Column:
            value = v.json(e["value"])
            if nested:
                inner = told & (e["key"] == "content")
                value = F.when(inner, _plain_content(e["value"], False)).otherwise(value)
            return F.concat(F.to_json(F.array(e["key"])), F.lit(":"), value)

        kept = F.filter(fields, lambda e: ~e["key"].isin(MARKERS))
        return F.coalesce(F.array_join(F.array_sort(F.transform(kept, field)), ","), v.json(b))

    only = F.concat(F.lit('["text"]:'), v.json(content), F.lit(',["type"]:"text"'))
    listed = F.array_join(F.transform(v.items(content), block), "\n")
    return F.when(v.string(content).isNotNull(), only).otherwise(F.coalesce(listed, v.json(content)))


def message_digest(role: Column, content: Column) -> Column:
    """Digest of a message without its cache markers and signatures.

    Equal messages have equal digests, also where one gives a text as a string and the other
    as its only block; the value itself is opaque.
    """
    return F.sha2(F.concat_ws("\n", role, _plain_content(content, True)), 256)


def prefix_digests(messages: DataFrame, keys: list[str], position: str = "message_index") -> DataFrame:
    """Add ``prefix_digest``: equal exactly for equal lists up to and with this message.

    A sum of position-bound digests in place of a chained hash, so a long history is
    summed in blocks.
    """
    one, two = position_digest(position, "digest")
    parts = messages.withColumns({"_p1": one, "_p2": two})
    # Sixty-bit terms stay in range as longs when halved by block; sum them apart.
    mod = F.lit(1 << 31)
    split = {
        "_a": (F.col("_p1") % mod).cast("long"), "_b": F.floor(F.col("_p1") / mod).cast("long"),
        "_c": (F.col("_p2") % mod).cast("long"), "_d": F.floor(F.col("_p2") / mod).cast("long"),
    }
    rows = parts.withColumns(split)
    summed = exclusive_sums(
        rows, keys, line_levels(position), {f"_s{n}": F.col(n) for n in ("_a", "_b", "_c", "_d")}
    )
    total = [F.col(f"_s{n}") + F.col(n) for n in ("_a", "_b", "_c", "_d")]
    return summed.withColumn(
        "prefix_digest", F.sha2(F.concat_ws(":", *[t.cast("string") for t in total]), 256)
    ).select(*messages.columns, "prefix_digest")


def cache_estimate(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Cache reads and writes of each request in order.

    ``requests``: keys, request_index, est_tokens, fixed_tokens, length, prefix_digest (of
    its whole list) and previous_prefix (digest of its list cut to the previous length).
    The earlier estimate is read back where the list extends the one before.
    """
    seen = previous(
        requests, keys, line_levels("request_index"),
        {"_est": F.col("est_tokens"), "_digest": F.col("prefix_digest")},
    )
    extends = F.coalesce(F.col("previous_prefix") == F.col("_digest"), F.lit(False))
    read = F.when(extends, F.col("_est")).otherwise(F.least("fixed_tokens", "est_tokens"))
    return seen.withColumn("cache_read", read).withColumn(
        "cache_write", F.greatest(F.col("est_tokens") - F.col("cache_read"), F.lit(0))
    ).drop("_est", "_digest")


def request_stats(requests: DataFrame, keys: list[str], order: str = "request_index") -> DataFrame:
    """Peak, last and total sizes, requests over threshold, compactions and their gaps."""
    hit = requests.filter("compacted").select(*keys, order)
    gaps = previous(hit, keys, line_levels(order), {"_before": F.col(order)}).withColumn(
        "gap", F.col(order) - F.col("_before")
    ).groupBy(*keys).agg(
        F.count("*").alias("compactions"),
        F.min("gap").alias("min_compaction_gap"),
        F.count_if(F.col("gap") == 1).alias("back_to_back"),
    )
    sums = requests.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.max("est_tokens").alias("peak_tokens"),
        F.max_by("est_tokens", order).alias("last_tokens"),
        F.sum("est_tokens").alias("total_tokens"),
        F.count_if(F.col("est_tokens") > F.col("threshold_tokens")).alias("over_threshold"),
    )
    return sums.join(gaps, keys, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("compactions", "back_to_back")}
    )


def rank_value(rows: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The value at rank n/2 (the upper of two middle ones) with least and greatest.

    Ratios are integers of few values, so they are counted by value and the counts are
    summed; no group of rows is gathered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # Two digits of the value order the sums in two levels.
    levels = [F.floor(F.col(value) / 8192).cast("long"), F.col(value)]
    below = exclusive_sums(counts, keys, levels, {"_below": F.col("_n")})
    total = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )
    at = F.floor(F.col("_all") / 2)
    return below.join(total, keys).filter(
        (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
    ).select(*keys, F.col("_all").alias("measured"), "least", F.col(value).alias(out), "greatest")


def ratio_permille(reported: str = "reported_tokens", est: str = "est_tokens") -> Column:
    """Reported over estimated tokens in thousandths, rounded down."""
    return F.when(F.col(est) > 0, F.floor(F.col(reported) * 1000 / F.col(est)).cast("long"))


# --- calibration ---------------------------------------------------------------------------

LOW, HIGH, MIN_EST, MIN_SAMPLES = 250, 4000, 1000, 5


def _step(mean: np.ndarray, sample: int) -> np.ndarray:
    up = mean + ((sample - mean) >> 3)
    down = mean - ((mean - sample) >> 3)
    return np.where(sample >= mean, up, down)


def calibrate(requests: DataFrame, keys: list[str], order: str = "request_index", block: int = 4096, fan: int = 64) -> DataFrame:
    """The running ratio of each key after all its requests.

    ``requests``: keys, order (dense), est_tokens, reported_tokens.  The mean moves an
    eighth of the way to each sample with integer steps, so order matters.  A block of
    samples maps any starting mean (250..4000) to an ending one; blocks are mapped apart,
    and maps are composed as a tree, so no task holds more than a block or ``fan`` maps of a key.
    """
    sample = F.floor(F.col("reported_tokens") * 1000 / F.col("est_tokens")).cast("long")
    usable = requests.filter(F.col("est_tokens") >= MIN_EST).withColumn("_sample", sample).filter(
        F.col("_sample").between(LOW, HIGH)
    ).select(*[F.col(k).cast("string").alias(k) for k in keys], order, "_sample",
             F.floor(F.col(order) / block).cast("long").alias("_block"))
    shape = ", ".join(f"{k} string" for k in keys)

    def map_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        means = np.arange(LOW, HIGH + 1, dtype=np.int64)
        samples = pdf["_sample"].to_numpy()
        fresh = int(samples[0])
        for s in samples:
            means = _step(means, int(s))
        for s in samples[1:]:
            fresh = int(_step(np.array(fresh), int(s)))
        # The map is a step function: store where it changes.
        edges = np.flatnonzero(np.diff(means)) + 1
        at = np.concatenate(([0], edges))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({
            **head, "_block": [int(pdf["_block"].iloc[0])], "_n": [len(samples)], "_fresh": [fresh],
            "_from": [(at + LOW).tolist()], "_to": [means[at].tolist()],
        })

    schema = f"{shape}, _block long, _n long, _fresh long, _from array<long>, _to array<long>"
    maps = usable.groupBy(*keys, "_block").applyInPandas(map_block, schema)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("_block").itertuples(index=False, name=None))
        at = {c: i for i, c in enumerate(pdf.columns)}
        starts, means, fresh = (np.asarray(rows[0][at[c]]) for c in ("_from", "_to", "_fresh"))
        for r in rows[1:]:
            edges, ends = np.asarray(r[at["_from"]]), np.asarray(r[at["_to"]])
            means, fresh = (ends[np.searchsorted(edges, x, side="right") - 1] for x in (means, fresh))
            kept = np.concatenate(([True], np.diff(means) != 0))
            starts, means = starts[kept], means[kept]
        head = {k: [rows[0][at[k]]] for k in keys}
        n = sum(int(r[at["_n"]]) for r in rows)
        return pd.DataFrame({**head, "_block": [int(rows[0][at["_up"]])], "_n": [n], "_fresh": [int(fresh)], "_from": [starts.tolist()], "_to": [means.tolist()]})

    # Maps of neighbouring blocks compose to one map, ``fan`` at a time, until each key has one.
    while True:
        maps = cut(maps, "maps")
        if (maps.agg(F.max("_block").alias("b")).first()["b"] or 0) == 0:
            break
        maps = maps.withColumn("_up", F.floor(F.col("_block") / fan).cast("long")).groupBy(*keys, "_up").applyInPandas(compose, schema)
    ratio = F.when(F.col("_n") < MIN_SAMPLES, 1000).otherwise(F.least(F.greatest("_fresh", F.lit(1000)), F.lit(2000)))
    return maps.select(*keys, F.col("_n").alias("samples"), F.col("_fresh").alias("mean_permille"), ratio.cast("long").alias("ratio_permille"))


def calibrated_threshold(threshold: str | Column, ratio: str | Column) -> Column:
    threshold = F.col(threshold) if isinstance(threshold, str) else threshold
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    held = F.least(F.greatest(ratio, F.lit(1000)), F.lit(2000))
    return F.floor(threshold * 1000 / held).cast("long")


# --- one compaction step of a request ------------------------------------------------------

def bound_suffix(parts: DataFrame, keys: list[str], budget: int, order: str = "part_index") -> DataFrame:
    """The longest run of newest parts whose characters, plus two each, fit the budget."""
    cost = F.length("text") + 2
    summed = exclusive_sums(
        parts.withColumn("_cost", cost.cast("long")), keys, line_levels(order, newest_first=True),
        {"_newer": F.col("_cost")},
    )
    return summed.filter(F.col("_newer") + F.col("_cost") <= budget).drop("_newer", "_cost")


def cliff_messages(messages: DataFrame, keys: list[str], keep_turns: int, parts: DataFrame | None = None) -> DataFrame:
    """What one step keeps of a list: the head, one summary, and the newest turns.

    ``messages``: keys, message_index, assistant, text.  Returns each kept message with
    ``role`` head, summary or tail; sessions that would not shrink are left out.
    """
    seen = previous(messages, keys, line_levels("message_index"), {"_was": F.col("assistant")})
    starts = seen.filter(F.col("assistant") & ~F.coalesce("_was", F.lit(False))).select(*keys, "message_index")
    extent = starts.groupBy(*keys).agg(
        F.min("message_index").alias("_head"), F.count("*").alias("_turns")
    )
    tail = newest(starts, keys, [F.col("message_index").desc()], max(keep_turns, 1)).groupBy(*keys).agg(
        F.min("message_index").alias("_tail")
    )
    sizes = messages.groupBy(*keys).agg(F.count("*").alias("_all"))
    plan = extent.join(tail, keys).join(sizes, keys).filter(F.col("_turns") > keep_turns)
    if keep_turns == 0:
        plan = plan.withColumn("_tail", F.col("_all"))
    plan = plan.filter(F.col("_tail") - F.col("_head") > 1)
    joined = messages.join(plan, keys)
    index = F.col("message_index")
    kept = joined.filter((index < F.col("_head")) | (index >= F.col("_tail"))).select(
        *keys, "message_index", F.when(index < F.col("_head"), "head").otherwise("tail").alias("role"), "text"
    )
    old = joined.filter((index >= F.col("_head")) & (index < F.col("_tail")))
    summary = old.groupBy(*keys).agg(
        F.min("message_index").alias("message_index"),
        F.lit("summary").alias("role"),
        F.concat(F.count("*").cast("string"), F.lit(" earlier messages")).alias("text"),
    )
    return kept.unionByName(summary)


def truncate(text: str | Column, limit: int) -> Column:
    """At most ``limit`` characters with an ellipsis; 0 keeps all."""
    text = F.col(text) if isinstance(text, str) else text
    if limit == 0:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def summarize_messages(contents: Column, command_chars: int = 150, result_chars: int = 500) -> Column:
    """Lines that stand for a message: its text, its calls as ``[tool] args``, short results."""
    def line(b: Column) -> Column:
        kind = v.string(b, "$.type")
        call = F.concat(
            F.lit("["), F.coalesce(v.string(b, "$.name"), F.lit("?")), F.lit("] "),
            truncate(v.json(v.get(b, "$.input")), command_chars),
        )
        result = v.payload_text(v.get(b, "$.content"))
        return (
            F.when(kind == "text", F.when(F.trim(v.string(b, "$.text")) != "", v.string(b, "$.text")))
            .when(kind == "tool_use", call)
            .when((kind == "tool_result") & (F.length(result) <= result_chars), result)
        )

    blocks = F.coalesce(v.items(contents), F.expr("cast(array() as array<variant>)"))
    return F.when(v.string(contents).isNotNull(), F.array(v.string(contents))).otherwise(
        F.array_compact(F.transform(blocks, line))
    )


def excerpt(text: str | Column, limit: int) -> Column:
    """Head and tail of a long text with the number of characters left out between."""
    text = F.col(text) if isinstance(text, str) else text
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(
            F.substring(text, 1, half),
            F.lit("\n[excerpt: "), (F.length(text) - limit).cast("string"),
            F.lit(" original characters omitted]\n"),
            F.right(text, F.lit(limit - half)),
        )
    )


def retain_evidence(
    results: DataFrame, keys: list[str], max_bytes: int, max_chars: int, item_chars: int, order: str = "line_index"
) -> DataFrame:
    """The newest results that fit: one per content, within bytes, characters and 128 entries.

    ``results``: keys, order, text.  Copies keep the newest, found by an aggregate.
    """
    shown = excerpt("text", min(item_chars, max_chars // 2))
    sized = results.withColumns({"excerpt": shown, "content_digest": F.sha2("text", 256)})
    latest = sized.groupBy(*keys, "content_digest").agg(
        F.max(order).alias(order), F.max_by("excerpt", order).alias("excerpt")
    ).withColumns(
        {"bytes": F.octet_length("excerpt").cast("long"), "chars": F.length("excerpt").cast("long")}
    )
    fitting = latest.filter((F.col("bytes") <= max_bytes) & (F.col("chars") <= max_chars))
    top = newest(fitting, keys, [F.col(order).desc()], 128)
    # At most 128 rows per key are left, so a plain window sums them.
    from pyspark.sql.window import Window

    run = Window.partitionBy(*keys).orderBy("_rank")
    summed = top.withColumns({"_b": F.sum("bytes").over(run), "_c": F.sum("chars").over(run)})
    return summed.filter((F.col("_b") <= max_bytes) & (F.col("_c") <= max_chars)).drop("_rank", "_b", "_c")


# --- request metadata ----------------------------------------------------------------------

def attribute_session(headers: DataFrame, keys: list[str]) -> DataFrame:
    """The one session id a request's headers name; NULL when they disagree or are unusable.

    ``headers``: keys, name, value.
    """
    name = F.lower("name")
    grouped = headers.groupBy(*keys).agg(
        F.bool_or(name == "thread-id").alias("_thread"),
        F.bool_or(name == "session-id").alias("_bare"),
        *[
            f
            for tag, names in (("_t", ["thread-id"]), ("_s", ["session_id", "conversation_id"]))
            for f in (
                F.min(F.when(name.isin(names), F.col("value"))).alias(f"{tag}_low"),
                F.max(F.when(name.isin(names), F.col("value"))).alias(f"{tag}_high"),
                F.bool_or(
                    name.isin(names)
                    & ((F.col("value") == "") | (F.octet_length("value") > 512) | F.col("value").rlike(r"[\x00-\x1f\x7f-\x9f]"))
                ).alias(f"{tag}_bad"),
            )
        ],
    )

    def one(tag: str) -> Column:
        return F.when((F.col(f"{tag}_low") == F.col(f"{tag}_high")) & ~F.col(f"{tag}_bad"), F.col(f"{tag}_low"))

    return grouped.select(
        *keys, F.when(F.col("_thread"), one("_t")).when(~F.col("_bare"), one("_s")).alias("session_id")
    )


def session_of_user_id(user_id: str | Column) -> Column:
    """Session id inside a structured user id; NULL when it has another shape."""
    user_id = F.col(user_id) if isinstance(user_id, str) else user_id
    hexes = "[0-9A-Fa-f]"
    uuid = f"{hexes}{{8}}-{hexes}{{4}}-{hexes}{{4}}-{hexes}{{4}}-{hexes}{{12}}"
    plain = F.regexp_extract(user_id, f"^user_{hexes}{{64}}_account_(?:{uuid})?_session_({uuid})$", 1)
    doc = F.try_parse_json(user_id)
    ok = (
        v.string(doc, "$.device_id").rlike(f"^{hexes}{{64}}$")
        & v.string(doc, "$.account_uuid").rlike(f"^({uuid})?$")
        & v.string(doc, "$.session_id").rlike(f"^{uuid}$")
    )
    found = F.when(doc.isNotNull(), F.when(ok, v.string(doc, "$.session_id"))).otherwise(
        F.when(plain != "", plain)
    )
    return F.when(F.octet_length(user_id) <= 4096, found)


def requested_output(body: Column) -> Column:
    """Output tokens a request reserves: the largest of three limits, else 32,000."""
    limits = [v.count(body, f"$.{n}") for n in ("max_tokens", "max_output_tokens", "max_completion_tokens")]
    return F.coalesce(F.greatest(*limits), F.lit(32_000).cast("long"))


def is_context_error(text: str | Column) -> Column:
    """Whether an error text says the context is too long."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    return text.rlike("(?s)" + "|".join(fixed.CONTEXT_ERRORS))


def ledger_activity(ledger: DataFrame) -> DataFrame:
    """Request ledger per dialect: compacted, reused, over budget, shadow, by rung."""
    return ledger.groupBy("dialect").agg(
        F.count("*").alias("requests"),
        F.count_if("compacted").alias("compacted"),
        F.count_if("reused_prefix").alias("reused_prefix"),
        F.count_if("over_budget").alias("over_budget"),
        F.count_if("shadow").alias("shadow"),
        F.sum("est_tokens_in").alias("est_tokens_in"),
        F.sum("est_tokens_out").alias("est_tokens_out"),
        F.max("rung").alias("highest_rung"),
    )


def replay_cost(stats: DataFrame, write_price: float = 1.25, read_price: float = 0.05) -> DataFrame:
    """Cost in input-token equivalents: cheap cache reads and dearer cache writes."""
    return stats.withColumn(
        "cost", F.col("cache_read").cast("double") * read_price + F.col("cache_write").cast("double") * write_price
    )


def pairing_violations(messages: DataFrame, calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and results of block-dialect histories that do not meet in adjacent turns.

    ``messages``: keys, message_index, assistant.  ``calls`` and ``results``: keys,
    message_index, call_id.  Messages of one side in a row are one turn.
    """
    seen = previous(messages, keys, line_levels("message_index"), {"_was": F.col("assistant")})
    flip = (F.col("_was").isNull() | (F.col("_was") != F.col("assistant"))).cast("long")
    numbered = cut(
        exclusive_sums(seen.withColumn("_flip", flip), keys, line_levels("message_index"), {"_t": F.col("_flip")})
        .select(*keys, "message_index", "assistant", (F.col("_t") + F.col("_flip")).alias("_turn")),
        "turns",
    )
    last = numbered.groupBy(*keys).agg(F.max("_turn").alias("_last"))
    place = keys + ["message_index"]
    asked = calls.join(numbered.filter("assistant"), place).select(*keys, "call_id", "_turn")
    told = results.join(numbered.filter(~F.col("assistant")), place).select(*keys, "call_id", "_turn")
    stray = told.join(
        asked.select(*keys, "call_id", (F.col("_turn") + 1).alias("_turn")), keys + ["call_id", "_turn"], "left_anti"
    ).select(*keys, "call_id", F.lit("result_without_call").alias("violation"))
    silent = (
        asked.join(last, keys).filter(F.col("_turn") < F.col("_last"))
        .join(told.select(*keys, "call_id", (F.col("_turn") - 1).alias("_turn")), keys + ["call_id", "_turn"], "left_anti")
        .select(*keys, "call_id", F.lit("call_without_result").alias("violation"))
    )
    return stray.unionByName(silent)

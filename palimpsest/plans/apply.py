"""Apply plans to records: replace payloads with stubs, append a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.operators.normalize import LINE, OUTPUT_KINDS, supported_item
from palimpsest.plans.card import render_card
from palimpsest.plans.policy import KEYS


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    json = F.to_json(F.struct(text.alias("v")))
    return F.substring(json, 6, F.length(json) - 6)


def _stubbed(content: Column, stub: Column) -> Column:
    """Content as JSON with its text replaced by the stub, where that makes it shorter."""
    size = v.eligible_bytes(content)
    text = F.replace(stub, F.lit("{bytes}"), size.cast("string"))
    blocks = F.transform(
        v.items(content),
        lambda b, i: F.concat(
            F.lit('{"text":'), F.when(i == 0, _quoted(text)).otherwise('""'),
            F.lit(',"type":'), _quoted(v.string(b, "$.type")), F.lit("}"),
        ),
    )
    after = F.when(v.string(content).isNotNull(), _quoted(text)).otherwise(
        F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))
    )
    shorter = (size > 0) & (F.octet_length(text) < size) & (
        F.octet_length(after) < F.octet_length(v.json(content))
    )
    return F.when(shorter, after).otherwise(v.json(content))


def _with_field(item: Column, name: str, value: Column) -> Column:
    """An object as JSON with one field's JSON replaced."""
    text = F.to_json(item)
    keys = F.array_sort(F.json_object_keys(text))
    pairs = F.transform(
        keys,
        lambda k: F.concat(
            _quoted(k), F.lit(":"),
            F.when(k == name, value).otherwise(F.to_json(F.try_element_at(
                F.from_json(text, "map<string,variant>"), k))),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def apply_elision(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records with the edited lines rewritten.  Other lines keep their bytes.

    ``edits``: LINE, stub.  Only tool results of supported shape change, and only when
    the result is shorter; line count and linkage stay.
    """
    wanted = edits.select(*LINE, "stub").dropDuplicates(LINE)
    joined = records.join(wanted, LINE, "left")
    rec, stub = F.col("rec"), F.col("stub")
    kind = v.string(rec, "$.type")
    message = v.get(rec, "$.message")

    def block(b: Column) -> Column:
        result = v.string(b, "$.type") == "tool_result"
        has = v.get(b, "$.content").isNotNull()
        return F.when(result & has, _with_field(b, "content", _stubbed(v.get(b, "$.content"), stub))).otherwise(F.to_json(b))

    blocks = F.concat(F.lit("["), F.array_join(F.transform(v.items(message, "$.content"), block), ","), F.lit("]"))
    branch = _with_field(rec, "message", _with_field(message, "content", blocks))
    payload = v.get(rec, "$.payload")

    def output(item: Column) -> Column:
        touch = v.string(item, "$.type").isin(OUTPUT_KINDS) & supported_item(item)
        return F.when(touch, _with_field(item, "output", _stubbed(v.get(item, "$.output"), stub))).otherwise(F.to_json(item))

    history = F.concat(
        F.lit("["), F.array_join(F.transform(v.items(payload, "$.replacement_history"), output), ","), F.lit("]")
    )
    window = F.when(kind == "response_item", _with_field(rec, "payload", output(payload))).when(
        kind == "compacted", _with_field(rec, "payload", _with_field(payload, "replacement_history", history))
    )
    rewritten = F.when(
        (F.col("provider") == fixed.BRANCH) & (kind == "user") & v.items(message, "$.content").isNotNull(), branch
    ).when(F.col("provider") == fixed.WINDOW, window)
    # A record in which nothing got shorter keeps its own bytes.
    fresh = F.when(
        stub.isNotNull() & (F.octet_length(rewritten) < F.octet_length(F.to_json(rec))), rewritten
    )
    return joined.select(
        *LINE, F.coalesce(fresh, F.col("raw")).alias("raw"), fresh.isNotNull().alias("changed")
    )


def append_card(records: DataFrame, plans: DataFrame) -> DataFrame:
    """Records followed by the state card of their plan, as a user message at the tail.

    A branch card hangs off the live leaf and names itself the new leaf.
    """
    last = records.groupBy(*KEYS).agg(
        F.max("line_index").alias("_last"),
        F.max_by(v.string(F.col("rec"), "$.leafUuid"),
                 F.when(v.string(F.col("rec"), "$.type") == "last-prompt", F.col("line_index"))).alias("_leaf"),
        F.max_by(v.string(F.col("rec"), "$.uuid"),
                 F.when(v.string(F.col("rec"), "$.type").isin("user", "assistant"), F.col("line_index"))).alias("_tail"),
    )
    text = render_card("card")
    carded = plans.filter(F.col("card").isNotNull()).join(last, KEYS).withColumn("_text", text)
    own = F.sha2(F.concat_ws("\n", "session_id", "_text"), 256)
    branch = F.to_json(F.struct(
        F.lit("user").alias("type"), own.alias("uuid"), F.coalesce("_leaf", "_tail").alias("parentUuid"),
        F.col("session_id").alias("sessionId"),
        F.struct(F.lit("user").alias("role"), F.col("_text").alias("content")).alias("message"),
    ))
    head = F.to_json(F.struct(F.lit("last-prompt").alias("type"), own.alias("leafUuid"), F.col("session_id").alias("sessionId")))
    window = F.to_json(F.struct(
        F.lit("response_item").alias("type"),
        F.struct(
            F.lit("message").alias("type"), F.lit("user").alias("role"),
            F.array(F.struct(F.lit("input_text").alias("type"), F.col("_text").alias("text"))).alias("content"),
        ).alias("payload"),
    ))
    is_branch = F.col("provider") == fixed.BRANCH
    added = F.array_compact(F.array(
        F.when(is_branch, branch).otherwise(window), F.when(is_branch, head)
    ))
    rows = carded.select(*KEYS, "_last", F.posexplode(added).alias("_n", "raw")).select(
        *KEYS, (F.col("_last") + 1 + F.col("_n")).alias("line_index"), "raw"
    )
    return records.select(*LINE, "raw").unionByName(rows)

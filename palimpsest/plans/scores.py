"""Heuristic keep scores from labels and summaries, without reading payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.text import has_any, tool_name, word_set
from palimpsest.operators.ordered import exclusive_sums, line_levels, newest
from palimpsest.plans.base import whole_text
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut

LOOKBACK = 8
FUTURE_CAP = 12
NEAR = 0.85


def _shared_words(texted: DataFrame, labelled: DataFrame) -> DataFrame:
    """How many words the superseded rows share with the latest of their label; rows whose sizes rule out that it is near are left out.

    No row carries the words of its label's latest one, and none meets it in the task of its label.
    """
    lines, labels = KEYS + ["line_index"], KEYS + ["label"]
    sizes = [F.col("_size"), F.col("_latest_size")]
    close = labelled.filter(
        (F.col("_newest") != F.col("line_index")) & (F.col("_size") > 0) & (F.least(*sizes).cast("double") / F.greatest(*sizes) >= NEAR)
    )
    latest = labelled.select(*labels, F.col("_latest_line").alias("line_index")).distinct()
    said = texted.join(latest, labels + ["line_index"], "left_semi").select(*labels, F.explode("_words").alias("word"))
    words = texted.join(close.select(*lines), lines, "left_semi").select(*lines, "label", F.explode("_words").alias("word"))
    return words.join(said, labels + ["word"]).groupBy(*lines).agg(F.count("*").alias("_shared"))


def heuristic_scores(items: DataFrame, sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep probability of each candidate row.

    Words are one row each, told apart by 96 bits of hashes of session and word, as they are sorted, joined and counted often. A word's later uses
    are capped at twelve, so only its newest thirteen uses need an order. What is known of a session meets rows, never their words.
    """
    lines = KEYS + ["line_index"]
    words = ["_word", "_mark"]
    coded = [F.xxhash64(*KEYS, "word").alias("_word"), F.hash("word").alias("_mark")]
    scoped = items.join(sessions.select(*KEYS), KEYS, "left_semi").select(
        *lines,
        "kind",
        "label",
        "summary",
        "uuid",
        "parent_uuid",
        F.concat("label", F.lit(" "), F.coalesce(whole_text(items), F.lit(""))).alias("_text"),
    )
    said = (
        F.col("kind").isin("user", "assistant")
        & F.col("summary").isNotNull()
        & ~F.startswith("summary", F.lit(fixed.CARD_MARKER))
    )
    # Whole texts are read once; what follows needs their words and two facts.
    texted = cut(scoped.select(
        *lines, "label", "uuid", "parent_uuid", F.coalesce(said, F.lit(False)).alias("_said"),
        has_any("_text", fixed.SCORE_ERROR_MARKERS).alias("_error"), word_set("_text").alias("_words"),
    ).withColumns({"_size": F.size("_words"), "_row": F.monotonically_increasing_id()}), "words")
    goal_words = (
        newest(texted.filter("_said"), KEYS, [F.col("line_index").desc()], LOOKBACK)
        .select(*KEYS, F.explode("_words").alias("word"))
        .select(*coded)
        .distinct()
        .withColumn("_goal", F.lit(1))
    )
    tail = newest(texted.select(*lines, "parent_uuid"), KEYS, [F.col("line_index").desc()], LOOKBACK)
    facts = (
        texted.groupBy(*KEYS)
        .agg(F.count("*").alias("_docs"), F.max("line_index").alias("_max_line"))
        .join(tail.groupBy(*KEYS).agg(F.collect_set("parent_uuid").alias("_parents")), KEYS)
        .join(candidates.groupBy(*KEYS).agg(F.count("*").alias("_n")), KEYS)
    )

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select(*KEYS, "_row", "line_index", F.explode("_words").alias("word")).select("_row", "line_index", *coded)

    uses = spread(texted)
    df = uses.groupBy(*words).agg(F.count("*").alias("_df"))
    late = newest(uses.select(*words, "line_index"), words, [F.col("line_index").desc()], FUTURE_CAP + 1).groupBy(*words).agg(
        F.sort_array(F.collect_list("line_index"), asc=False).alias("_late")  # thirteen at most
    )
    known = df.join(late, words).join(goal_words, words, "left")
    place = F.array_position("_late", F.col("line_index"))
    per_row = spread(texted.join(candidates.select(*lines), lines, "left_semi")).join(known, words).groupBy("_row").agg(
        F.count("*").alias("_word_count"),
        F.sum(F.log("_df")).alias("_log_df"),
        F.sum(F.when(place == 0, FUTURE_CAP).otherwise(place - 1)).alias("_future"),
        F.sum(F.coalesce("_goal", F.lit(0))).alias("_overlap"),
    )

    rows = exclusive_sums(
        candidates.select(*lines), KEYS, line_levels(), {"_position": F.lit(1)}
    ).join(texted.drop("_words"), lines)
    labels = KEYS + ["label"]
    newest_label = rows.groupBy(*labels).agg(F.max("line_index").alias("_newest"))
    latest = (
        texted.groupBy(*labels)
        .agg(F.max("line_index").alias("_latest_line"), F.max_by("_size", "line_index").alias("_latest_size"))
        .join(newest_label, labels)
    )
    labelled = cut(rows.join(latest, labels), "labelled")
    joined = (
        labelled.join(_shared_words(texted, labelled), lines, "left")
        .join(facts, KEYS)
        .join(per_row, "_row", "left")
    )

    count = F.coalesce("_word_count", F.lit(0))
    docs = F.col("_docs").cast("double")
    max_idf = F.greatest(F.log(docs), F.lit(1.0))

    def unit(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    idf = F.when(count == 0, 0.0).otherwise(unit((count * F.log(docs) - F.col("_log_df")) / (count.cast("double") * max_idf)))
    future = unit(
        F.coalesce("_future", F.lit(0)).cast("double") / F.greatest(count, F.lit(1)) / 12.0
    )
    overlap = F.when(count == 0, 0.0).otherwise(F.col("_overlap").cast("double") / count)
    tool = tool_name("label")
    importance = (
        F.when(tool.isin(fixed.DURABLE_TOOLS), 1.0)
        .when(tool.isin(fixed.TRANSIENT_TOOLS), 0.0)
        .otherwise(0.5)
    )
    superseded = F.col("_newest") != F.col("line_index")
    shared = F.coalesce("_shared", F.lit(0))
    near = shared.cast("double") / (F.col("_size") + F.col("_latest_size") - shared) >= NEAR
    near = superseded & (F.col("_size") > 0) & near
    of_tail = F.coalesce(F.array_contains("_parents", F.col("uuid")), F.lit(False))
    place = F.when(F.col("_max_line") == 0, 0.0).otherwise(
        F.col("line_index").cast("double") / F.col("_max_line")
    )
    score = (
        F.col("_position").cast("double") / F.col("_n") * 0.18
        + importance * 0.12
        + F.when(F.col("_error"), 0.25).otherwise(0.0)
        + future * 0.12
        + overlap * 0.12
        + place * 0.10
        + idf * 0.12
        + F.when(of_tail, 0.10).otherwise(0.0)
        - F.when(superseded, 0.15).otherwise(0.0)
        - F.when(near, 0.12).otherwise(0.0)
    )
    return joined.select(*lines, unit(score).alias("keep_probability"))

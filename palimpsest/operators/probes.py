"""Probes: short verbatim strings lifted from text, and how many survive a rewrite."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions.stats import wilson95
from palimpsest.operators.ordered import newest
from palimpsest.session import cut

KINDS = fixed.PROBE_KINDS
LINES_AT_ONCE = 500
_PATH = re.compile(r"[A-Za-z0-9_\-./~+@]+")
_NAME = re.compile(r"[A-Za-z0-9_\-.]+")
_WORD = re.compile(rf"[A-Za-z0-9_]{{{fixed.MIN_IDENTIFIER_BYTES},}}")  # shorter runs are passed over whole
_DOTTED = re.compile(r"\.[A-Za-z0-9]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ARGS = re.compile(r"[ A-Za-z0-9_\-./~+=:%@]*")
_EXT = re.compile(r"^[A-Za-z0-9].*\.([A-Za-z0-9]{1,8})$", re.S)
_EXTENSIONS = frozenset(fixed.PROBE_FILE_EXTENSIONS)


def _ends(token: str, known: bool) -> bool:
    found = _EXT.match(token)
    return bool(found) and (not known or found.group(1).lower() in _EXTENSIONS)


def _clip(text: str) -> str:
    """At most 64 bytes, on a character boundary."""
    return text.encode()[: fixed.MAX_PROBE_BYTES].decode("utf-8", "ignore")


def _starts(line: str, key: str) -> Iterator[int]:
    at = line.find(key)
    while at >= 0:
        yield at
        at = line.find(key, at + len(key))


def _lower_ascii(text: str) -> str:
    return text.translate(_LOWER)


def _of_line(line: str) -> Iterator[tuple[int, str]]:
    """Candidate probes of a line as (kind number, text), in the order they are looked for."""
    for m in _PATH.finditer(line) if "/" in line else ():
        token = m.group().rstrip(".")
        if len(token) >= 3 and "/" in token:
            anchored = token.startswith(("/", "~/", "./"))
            if anchored or _ends(token.rsplit("/", 1)[-1], False):
                yield 0, token
    for word in fixed.PROBE_COMMANDS:
        for at in _starts(line, word):
            if at > 0 and _PATH.match(line[at - 1]):
                continue
            end = at + len(word)
            if line[end : end + 1] != " ":
                continue
            run = _ARGS.match(line, end).end()
            text = _clip(line[at:run]).rstrip(" .")
            if len(text[len(word) :].strip()) >= 2:
                yield 1, text
    lowered = _lower_ascii(line)
    for key in fixed.PROBE_DECISIONS:
        for at in _starts(lowered, key):
            yield 2, _clip(line[at : at + fixed.MAX_PROBE_BYTES]).rstrip(" .")
    for key in fixed.PROBE_ERRORS:
        for at in _starts(line, key):
            yield 3, _clip(line[at : at + fixed.MAX_PROBE_BYTES]).rstrip(" .")
    for m in _NAME.finditer(line) if _DOTTED.search(line) else ():
        token = m.group().rstrip(".")
        if _ends(token, True):
            yield 4, token
    for m in _WORD.finditer(line):
        token = m.group()
        mixed = "_" in token or (token != token.upper() and token != token.lower())
        quoted = line[m.start() - 1 : m.start()] == '"' and line[m.end() : m.end() + 1] == '"'
        if not token[0].isdigit() and mixed and not quoted:
            yield 5, token


def probe_candidates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every candidate probe of every line: keys, line_index, kind number, position, text.

    Reads whole lines, in Arrow batches of which a few lines at a time become Python objects.
    """
    shape = ", ".join(f"{k} string" for k in keys) + ", line_index long, kind int, position int, text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LINES_AT_ONCE):
                rows = []
                for *head, line_index, line in zip(*(c.to_pylist() for c in batch.slice(start, LINES_AT_ONCE).columns)):
                    at = [0] * len(KINDS)
                    for kind, text in _of_line(line or ""):
                        text = _clip(text)
                        if len(text.encode()) >= 3:
                            rows.append((*head, line_index, kind, at[kind], text))
                            at[kind] += 1
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = [*keys, "line_index", "kind", "position", "text"]
    kinds = [*[pa.string()] * len(keys), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    read = [*[F.col(k).cast("string").alias(k) for k in keys], F.col("line_index").cast("long").alias("line_index"), "text"]
    return lines.select(*read).mapInArrow(scan, shape)


def _pick(keys: list[str]):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        """The caps as text is read: first use of a text, four per line and kind, a cap per kind."""
        pdf = pdf.sort_values(["line_index", "kind", "position"], kind="stable")
        seen: set[str] = set()
        bags: list[list[tuple[int, str]]] = [[] for _ in KINDS]
        on_line: dict[tuple[int, int], int] = {}
        for line, kind, text in zip(pdf["line_index"], pdf["kind"], pdf["text"]):
            bag = bags[kind]
            if len(bag) >= fixed.PROBE_KIND_CAPS[kind]:
                continue
            if on_line.get((line, kind), 0) >= fixed.PROBES_PER_LINE or text in seen:
                continue
            seen.add(text)
            bag.append((line, text))
            on_line[line, kind] = on_line.get((line, kind), 0) + 1
        turns = max((len(b) for b in bags), default=0)
        order = [(k, *bags[k][i]) for i in range(turns) for k in range(len(KINDS)) if i < len(bags[k])]
        chosen = sorted(order[: fixed.MAX_PROBES], key=lambda p: (p[1], p[0]))
        out = pd.DataFrame(
            [(KINDS[k], line, text) for k, line, text in chosen], columns=["kind", "line_index", "text"]
        )
        for key in keys:
            out[key] = pdf[key].iloc[0]
        out["probe_index"] = range(len(out))
        return out[[*keys, "probe_index", "kind", "line_index", "text"]]

    return pick


def extract_probes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The probes of each session: at most 64, mixed over six kinds.

    The caps follow reading order, so a session's candidates are walked in order; the
    walk is bounded without changing its result.  All caps together take 100 texts, so
    at most 100 can be lost to another kind: past the 124th line that brings a kind a
    new text that kind is full.  On one line the first 104 texts decide.  A text passed
    over met a full line each time, and a kind fills six lines at most, so its first
    seven uses decide.
    """
    taken = sum(fixed.PROBE_KIND_CAPS)
    most = max(fixed.PROBE_KIND_CAPS)
    kind = keys + ["kind"]
    found = cut(
        probe_candidates(lines, keys).groupBy(*kind, "line_index", "text").agg(
            F.min("position").alias("position")
        ),
        "candidates",
    )
    uses = newest(
        found, kind + ["text"], [F.col("line_index")], most // fixed.PROBES_PER_LINE + 1
    )
    fresh_lines = uses.filter(F.col("_rank") == 1).select(*kind, "line_index").distinct()
    enough = most + taken
    reach = (
        newest(fresh_lines, kind, [F.col("line_index")], enough).groupBy(*kind)
        .agg(F.max("line_index").alias("_last"), F.count("*").alias("_lines"))
        .select(*kind, F.when(F.col("_lines") == enough, F.col("_last")).alias("_last"))
    )
    near = uses.drop("_rank").join(reach, kind).filter(
        F.col("_last").isNull() | (F.col("line_index") <= F.col("_last"))
    )
    bounded = newest(
        near.drop("_last"), kind + ["line_index"], [F.col("position")], fixed.PROBES_PER_LINE + taken
    ).drop("_rank")
    shape = ", ".join(f"{k} string" for k in keys) + ", probe_index long, kind string, line_index long, text string"
    return bounded.groupBy(*keys).applyInPandas(_pick(keys), shape)


def survival(probes: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with ``survived``: whether any line of the rewritten text holds them.

    ``after``: keys, text.  A session has at most 64 probes, so its probes are gathered
    into one row and sent to the lines; lines are not gathered.
    """
    packed = probes.groupBy(*keys).agg(F.collect_list(F.struct("probe_index", "text")).alias("_probes"))
    hits = (
        after.join(packed, keys)
        .select(*keys, F.explode(F.filter("_probes", lambda p: F.contains(F.col("text"), p.text))).alias("p"))
        .select(*keys, F.col("p.probe_index").alias("probe_index"))
        .distinct()
        .withColumn("survived", F.lit(True))
    )
    return probes.join(hits, keys + ["probe_index"], "left").withColumn(
        "survived", F.coalesce("survived", F.lit(False))
    )


def score_probes(observed: DataFrame, keys: list[str], tail_start: DataFrame | None = None) -> DataFrame:
    """Recall overall and in the protected tail.

    ``observed``: probes with ``survived`` (NULL when not measured).  ``tail_start``: keys,
    tail_line.
    """
    if tail_start is not None:
        observed = observed.join(tail_start, keys, "left")
    else:
        observed = observed.withColumn("tail_line", F.lit(None).cast("long"))
    measured = F.col("survived").isNotNull()
    tail = F.coalesce(F.col("line_index") >= F.col("tail_line"), F.lit(False))
    hit = F.coalesce("survived", F.lit(False))
    missed = F.when(measured & ~hit, F.struct("probe_index", "text"))
    sums = observed.groupBy(*keys).agg(
        F.count("*").alias("probes_requested"),
        F.count_if(measured).alias("probes_total"),
        F.count_if(hit).alias("probes_recalled"),
        F.count_if(measured & tail).alias("tail_probes_total"),
        F.count_if(hit & tail).alias("tail_probes_recalled"),
        F.bool_and(measured | ~tail).alias("_tail_complete"),
        F.array_sort(F.collect_list(missed)).alias("_missed"),
        *[F.count_if(measured & (F.col("kind") == k)).alias(f"{k}_total") for k in KINDS],
        *[F.count_if(hit & (F.col("kind") == k)).alias(f"{k}_recalled") for k in KINDS],
    )
    low, high = wilson95("probes_recalled", "probes_total")
    total, complete = F.col("probes_total"), F.col("probes_total") == F.col("probes_requested")
    return sums.withColumns(
        {
            "recall": F.when(total > 0, F.col("probes_recalled") / total).otherwise(0.0),
            "recall_available": total > 0,
            "complete": complete,
            "recall_low": low,
            "recall_high": high,
            "tail_intact": F.col("_tail_complete") & complete & (F.col("tail_probes_total") > 0)
            & (F.col("tail_probes_total") == F.col("tail_probes_recalled")),
            "missed_probes": F.transform(F.slice("_missed", 1, fixed.MAX_MISSED), lambda m: m.text),
        }
    ).drop("_missed", "_tail_complete")


def survival_from_probabilities(probes: DataFrame, probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Probes judged by supplied probabilities: kept at one half; out of range is not measured."""
    p = F.col("probability")
    ok = p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)
    return probes.join(
        probabilities.select(*keys, "probe_index", "probability"), keys + ["probe_index"], "left"
    ).withColumn("survived", F.when(ok, p >= 0.5)).drop("probability")


def tail_start(items: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """First line of the protected tail, or the last line without enough elidable rows."""
    elidable = items.filter(F.col("elidable_bytes").isNotNull())
    tail = newest(elidable.select(*keys, "line_index"), keys, [F.col("line_index").desc()], keep)
    cuts = tail.groupBy(*keys).agg(F.min("line_index").alias("_cut"))
    last = items.groupBy(*keys).agg(F.max("line_index").alias("_last"))
    return last.join(cuts, keys, "left").select(*keys, F.coalesce("_cut", "_last").alias("tail_line"))


def live_text(records: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Text of live lines; a compaction record counts by its replacement history."""
    from palimpsest.functions import variant as v

    live = items.filter(F.col("est_tokens") > 0).select(*keys, "line_index")
    rec = F.col("rec")
    compacted = (F.col("provider") == fixed.WINDOW) & (v.string(rec, "$.type") == "compacted")
    history = F.coalesce(F.to_json(v.get(rec, "$.payload.replacement_history")), F.lit(""))
    return records.join(live, keys + ["line_index"], "left_semi").select(
        *keys, "line_index",
        F.when(F.coalesce(compacted, F.lit(False)), history).otherwise(F.col("raw")).alias("text"),
    )

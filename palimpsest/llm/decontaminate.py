"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of ten words (an item of fewer words is one window). Windows are sets of three-word
shingles, ordered from rare to frequent by their counts over all documents. A document that holds a window holds all of its
shingles, so the rarest is the only prefix token needed. Documents meet windows on that token; a candidate that would begin before
the text or end after it falls to the positional and length bounds; the rest are verified word for word.

The benchmark is the query set: its windows are taken in blocks of ``BLOCK``, whose index is broadcast; each block is
a pass over the documents, whose hits so far are cut to a table between passes.

Inputs: null and empty texts have no words and no hits; null or empty items have no windows. Texts are taken whole.
Repeated items and documents give the same answer each. An empty table gives an empty result; an empty benchmark gives
no hits. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.text import ALNUM, Words, chunks, utf8
from palimpsest.session import cut

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000
FILTER_BITS = 22


def windows(benchmark: DataFrame, *, id: str, text: str) -> DataFrame:
    """(window, items): each different window's words, joined by blanks, and the items that hold it."""

    def run(batches):
        for batch in chunks(batches, "text"):
            words = Words(*utf8(batch.column(1)), ALNUM)
            ids, found = [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(words.ptr[i]), int(words.ptr[i + 1])
                size = min(WINDOW, b - a)
                for at in range(a, b - size + 1 if size else a):
                    ids.append(item)
                    found.append(words.text(at, size))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    rows = benchmark.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, window binary").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Lookup:
    """Positions in a sorted list of hashes: a table of bits first, then a binary search for the few that pass."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self._slot(self.sorted)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of hashes that are listed, and where in the list each is."""
        at = np.flatnonzero(self.bits[self._slot(hashes)])
        if not len(self.sorted) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        good = self.sorted[place] == hashes[at]
        return at[good], place[good]


class Index:
    """A block of windows with their shingles; ``choose`` keeps of each window the rarest."""

    def __init__(self, rows: list):
        self.text = [bytes(r["window"]) for r in rows]
        self.items = [list(r["items"]) for r in rows]
        joined = pa.array([t.decode() for t in self.text], pa.large_string())
        words = Words(*utf8(joined), ALNUM)
        self.size = np.diff(words.ptr)
        self.unit = np.minimum(self.size, SHINGLE)
        self.hash = words.run(words.ptr[:-1], self.size)
        per = self.size - self.unit + 1
        self.of = np.repeat(np.arange(len(rows)), per)
        self.offset = np.arange(len(self.of)) - np.repeat(np.cumsum(per) - per, per)
        self.shingle = words.run(words.ptr[:-1][self.of] + self.offset, self.unit[self.of])

    def choose(self, counts: dict[int, int]) -> None:
        rarity = np.array([counts.get(int(h), 0) for h in self.shingle.view(np.int64)])
        order = np.lexsort((self.offset, self.shingle, rarity, self.of))
        first = order[np.unique(self.of[order], return_index=True)[1]]
        self.prefixes = {}
        for unit in sorted(set(self.unit.tolist())):
            rows = first[self.unit[self.of[first]] == unit]
            rows = rows[np.argsort(self.shingle[rows], kind="stable")]
            lookup = Lookup(self.shingle[rows])
            start = np.searchsorted(self.shingle[rows], lookup.sorted)
            end = np.searchsorted(self.shingle[rows], lookup.sorted, side="right")
            self.prefixes[unit] = lookup, start, end - start, self.of[rows], self.offset[rows]
        del self.of, self.offset, self.shingle


def shingle_counts(docs: DataFrame, text: str, index: Index) -> dict[int, int]:
    """How often each of the index's shingles occurs in all documents."""
    units = {u: index.shingle[index.unit[index.of] == u] for u in sorted(set(index.unit.tolist()))}
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        tables = [(u, Lookup(h)) for u, h in shared.value.items()]
        totals = [np.zeros(len(t.sorted), np.int64) for _, t in tables]
        for batch in chunks(batches, "text"):
            words = Words(*utf8(batch.column(0)), ALNUM)
            for (unit, t), total in zip(tables, totals, strict=True):
                _, place = t.find(words.runs(unit))  # runs across two texts hardly change an order
                total += np.bincount(place, minlength=len(total))
        for (_, t), total in zip(tables, totals, strict=True):
            met = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(t.sorted[met].view(np.int64)), pa.array(total[met])], names=["shingle", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"]: r["n"] for r in found.collect()}  # at most the shingles of one block


def _occurrences(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every window that occurs; runs across texts are not yet excluded."""
    starts, found = [], []
    for unit, (lookup, first, many, of, offset) in index.prefixes.items():
        at, place = lookup.find(words.runs(unit))
        if not len(at):
            continue
        n = many[place]
        rows = np.repeat(first[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts.append(np.repeat(at, n) - offset[rows])
        found.append(of[rows])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(found)


def _hits(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    start, window = _occurrences(words, index)
    last = words.ptr[np.searchsorted(words.ptr, np.maximum(start, 0), side="right").clip(1, len(words.ptr) - 1)]
    ok = (start >= 0) & (start + index.size[window] <= last)
    start, window = start[ok], window[ok]
    same = words.run(start, index.size[window]) == index.hash[window] if len(start) else np.zeros(0, bool)
    start, window = start[same], window[same]
    exact = [words.text(a, n) == index.text[w] for a, n, w in zip(start.tolist(), index.size[window].tolist(), window.tolist(), strict=True)]
    exact = np.array(exact, bool)
    return start[exact], window[exact]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str], item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``keep`` columns with ``n_words``, ``hits`` ((start, end) in words, merged) and ``items`` (sorted)."""
    spark = docs.sparkSession
    block_rows = cut(windows(benchmark, id=item_id, text=item_text), "windows")
    blocks = max(1, -(-block_rows.count() // BLOCK))
    block_rows = block_rows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    span = "array<struct<start:int,end:int>>"
    state = docs.select(
        *keep, F.lit(0).alias("__n"), F.array().cast(span).alias("__hits"), F.array().cast("array<string>").alias("__items"), docs[text].alias("__text")
    )
    schema = T.StructType(state.schema.fields)
    for block in range(blocks):
        index = Index(block_rows.where(F.col("block") == block).orderBy("window").collect())
        index.choose(shingle_counts(docs, text, index))
        shared = spark.sparkContext.broadcast(index)
        state = state.mapInArrow(_pass(shared, schema.names), schema)
        if block + 1 < blocks:
            state = cut(state, "hits")
    return state.select(*keep, F.col("__n").alias("n_words"), F.col("__hits").alias("hits"), F.col("__items").alias("items"))


def _pass(shared, names):
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        index = shared.value
        for batch in chunks(batches, "__text"):
            words = Words(*utf8(batch.column(batch.num_columns - 1)), ALNUM)
            start, window = _hits(words, index)
            row = np.searchsorted(words.ptr, start, side="right") - 1
            hits, items = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            for i in np.unique(row).tolist():
                mine = row == i
                spans = [(h["start"], h["end"]) for h in hits[i]]
                a = start[mine] - words.ptr[i]
                spans += zip(a.tolist(), (a + index.size[window[mine]]).tolist(), strict=True)
                hits[i] = [{"start": x, "end": y} for x, y in merged(spans)]
                items[i] = sorted({*items[i], *(t for w in set(window[mine].tolist()) for t in index.items[w])})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-4], pa.array(np.diff(words.ptr), pa.int32()), pa.array(hits, pair), pa.array(items, pa.list_(pa.string())), batch.column(batch.num_columns - 1)],
                names=names,
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out

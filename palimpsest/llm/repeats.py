"""Passages of more than 50 words that stand elsewhere word for word, wherever lines begin and end.

A window is a run of ``PASSAGE`` words between blanks, letters of ASCII lower-cased; it may cross lines. Its anchor is the
smallest hash among its runs of ``ANCHOR`` words. Equal windows have equal anchors, so a window can be repeated only if
its anchor occurs twice. Anchors are few and are counted first; those met twice set bits of a filter of fixed size, and the windows
whose anchor passes are counted by their own hash. What passes without being repeated falls in that count. No two texts are compared.

Of equal windows, the one with the smallest (document, word) stays. Windows that follow each other, with their copy in the
same document, are one passage. Where one passage begins before the last one ends, it is cut to begin after it. A removed
word's copy stands earlier, so some copy of it always stays.

Inputs: texts of fewer words have no passage; rows with a null id are left out; rows with one id count as one text. Texts
are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import BLANKS, Words, chunks, utf8
from palimpsest.session import cut

PASSAGE = 51
ANCHOR = 16
FILTER_BITS = 27


def _sliding(values: np.ndarray, size: int, least) -> np.ndarray:
    """The least (``np.minimum``) or largest value of each ``size`` neighbours, from each one on."""
    span = 1
    while 2 * span <= size:
        values = least(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return least(values[:-rest], values[rest:]) if rest else values


class Windows:
    """All windows of some texts: first word, text row, and anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets, BLANKS)
        per = np.maximum(np.diff(words.ptr) - PASSAGE + 1, 0)
        self.row = np.repeat(np.arange(len(per)), per)
        self.first = np.arange(len(self.row)) - np.repeat(np.cumsum(per) - per, per) + words.ptr[:-1][self.row]
        self.grams = words.runs(ANCHOR)
        self.least = _sliding(self.grams, PASSAGE - ANCHOR + 1, np.minimum) if len(self.first) else self.grams[:0]

    def anchors(self) -> np.ndarray:
        """A hash for each place that is the anchor of some window."""
        if not len(self.first):
            return self.grams[:0]
        near = PASSAGE - ANCHOR
        of = np.zeros(len(self.grams) + near, np.uint64)
        of[self.first + near] = self.least[self.first]
        # A gram is the anchor of a window it lies in if none of its windows' least is above the others' but its own.
        return self.grams[_sliding(of, near + 1, np.maximum) == self.grams]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _repeated_anchors(frame: DataFrame) -> np.ndarray:
    """A filter that every anchor passes that occurs twice."""

    def run(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(Windows(*utf8(batch.column(1))).anchors().view(np.int64))], names=["anchor"])

    twice = frame.mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    slot = F.shiftrightunsigned("anchor", 64 - FILTER_BITS)
    bits = twice.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in bits.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return words


def _windows(frame: DataFrame, shared) -> DataFrame:
    """(hash, doc, at, span) of each window whose anchor passes: word and line, first and last code point, two to a number."""

    def run(batches):
        bits = shared.value
        for batch in chunks(batches, "text"):
            data, offsets = utf8(batch.column(1))
            windows = Windows(data, offsets)
            words, slot = windows.words, _slot(windows.least[windows.first])
            good = np.flatnonzero((bits[slot >> 6] >> (slot & 63)) & 1)
            first, row = windows.first[good], windows.row[good]
            if not len(first):
                continue
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            ends = np.flatnonzero(data == 10)
            start, end = words.starts[first], words.ends[first + PASSAGE - 1]
            line = np.searchsorted(ends, start) - np.searchsorted(ends, offsets[row])
            base = points[offsets[row]]
            at = ((first - words.ptr[row]) << 32) | line
            span = ((points[start] - base) << 32) | (points[end] - base)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.run(first, PASSAGE).view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at), pa.array(span)],
                names=["hash", "doc", "at", "span"],
            )

    return frame.mapInArrow(run, "hash long, doc long, at long, span long")


_RUNS = "doc long, place int, start int, end int, kept_in long, copies long, removed boolean"


def _passages(batches):
    """Runs of windows (doc, at, span, kept_in, copies, removed), sorted by doc and at, as passages."""
    held, before = None, None  # the run that may go on; the document and end of the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, at, span, kept, copies = (batch.column(i).to_numpy() for i in range(5))
        removed = batch.column(5).to_numpy(zero_copy_only=False)
        word, start, end = at >> 32, span >> 32, span & 0xFFFFFFFF
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + 1) | (kept[1:] != kept[:-1]) | (removed[1:] != removed[:-1])
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(doc)) - 1
        most, furthest = np.maximum.reduceat(copies, firsts), np.maximum.reduceat(end, firsts)
        done = []
        for a, z, n, to in zip(firsts.tolist(), lasts.tolist(), most.tolist(), furthest.tolist(), strict=True):
            run = [int(doc[a]), int(at[a] & 0xFFFFFFFF), int(start[a]), to, int(kept[a]), n, bool(removed[a]), int(word[z])]
            if a == 0 and held and held[0] == run[0] and word[0] <= held[7] + 1 and held[4] == run[4] and held[6] == run[6]:
                held[3], held[5], held[7] = max(held[3], to), max(held[5], n), run[7]
                continue
            if held:
                done.append(held)
            held = run
        out, before = _apart(done, before)
        yield out
    if held:
        yield _apart([held], before)[0]


def _apart(runs: list, before) -> tuple[pa.RecordBatch, tuple | None]:
    out = []
    for doc, place, start, end, kept, copies, removed, _ in runs:
        if before and before[0] == doc:
            start = max(start, before[1] + 1)
            end = max(end, before[1])
        if start < end:
            out.append((doc, place, start, end, kept, copies, removed))
        before = doc, end
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "place", "start", "end", "kept_in", "copies", "removed"]), before


def repeated_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each passage that stands elsewhere too: (id, paragraph, start, end, kept_in, copies, removed).

    ``paragraph`` is the line where its first window begins; ``start`` and ``end`` are code points; ``copies`` is the
    largest count of a window in it. The copy that stays has a row as well, with ``removed`` false.
    """
    frame = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_repeated_anchors(frame))
    rows = cut(_windows(frame, shared), "windows")
    kept = rows.groupBy("hash").agg(F.min(F.struct("doc", "at")).alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    met = rows.join(kept, "hash").select(
        "doc", "at", "span", F.col("keep.doc").alias("kept_in"), "copies", (F.struct("doc", "at") != F.col("keep")).alias("removed")
    )
    runs = met.repartition("doc").sortWithinPartitions("doc", "at").mapInArrow(_passages, _RUNS)
    return cut(runs, "passages").select(F.col("doc").alias(id), F.col("place").alias("paragraph"), "start", "end", "kept_in", "copies", "removed")

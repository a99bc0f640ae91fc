"""Passages that repeat within or across documents: MinHash banding of paragraphs, exact verification, components.

A paragraph is a line of ``MIN_WORDS`` words or more; it stands for its set of distinct five-word shingles. Shorter lines have no
shingle; they, and passages that cross lines or lie inside unlike ones, are found word for word by ``repeats``. Bands are
tuned from the wanted similarity: the fewest hashes for which a pair at that similarity collides with a probability of
``RECALL`` and a pair at half of it seldom does. Paragraphs with equal sets are one class. Classes that collide in a band are
verified by the exact Jaccard similarity of their sets (0.8 or more), each pair once, and linked ones form components. Sets of
fewer than ``LEAST`` shingles can be similar to equal ones only, and need no bands. Of
a component, the paragraph with the smallest (document, position) stays, and all others are to be removed.

Inputs: null, empty and short texts have no paragraph. Texts are taken whole. Rows with a null id are left out; equal
rows have equal paragraphs, which repeat each other: both count as copies, and their span has one row. An empty table gives an empty result. Other columns are
ignored here and kept by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import SKETCH_BITS, among, linked_groups, meet, parities
from palimpsest.llm.text import BLANKS, Words, chunks, mix, pack, utf8
from palimpsest.session import cut

WORDS = 5
MIN_WORDS = WORDS
SIMILARITY = 80  # per cent
RECALL = 0.999
LEAST = -(-SIMILARITY // (100 - SIMILARITY))  # n of n + 1 shared shingles are enough from here on


def tune_bands(similarity: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach the recall, with collisions at half the similarity below one in two."""
    found = []
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= 0.5:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


BANDS, ROWS = tune_bands(SIMILARITY / 100, RECALL)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


class Lines:
    """The lines of some texts that are paragraphs: text row, place in the text, byte bounds, and shingle sets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        ends = np.flatnonzero(data == 10)
        bounds = np.unique(np.concatenate([offsets, ends + 1])).astype(np.int64)
        words = Words(data, bounds, BLANKS)
        row = np.searchsorted(offsets, bounds[:-1], side="right") - 1
        first = np.searchsorted(bounds, offsets[:-1])
        long = np.flatnonzero(np.diff(words.ptr) >= MIN_WORDS)
        self.row = row[long]
        self.place = long - first[self.row]
        self.start = bounds[:-1][long]
        stop = bounds[1:][long]
        self.end = stop - (data[stop - 1] == 10) if len(long) else stop
        whole = words.runs(WORDS)
        sizes = (np.diff(words.ptr)[long] - WORDS + 1).astype(np.int64)
        of = np.repeat(np.arange(len(long)), sizes)
        shingle = whole[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + words.ptr[:-1][long][of]]
        order = np.lexsort((shingle, of))
        of, shingle = of[order], shingle[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
        #: All sets end to end, each sorted; ``ptr`` has the first member of each.
        self.of, self.flat = of[new], shingle[new]
        self.ptr = np.searchsorted(self.of, np.arange(len(long) + 1))
        self.ids = (np.add.reduceat(mix(self.flat), self.ptr[:-1]) if len(long) else self.flat).view(np.int64)
        # Code points before a byte: bytes that do not continue another.
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        base = points[offsets[self.row]]
        self.from_point, self.to_point = points[self.start] - base, points[self.end] - base

    def bands(self) -> list[np.ndarray]:
        """A token for each band of each set: its minima hashed together with the band's number; none for sets below ``LEAST``."""
        n = len(self.ids)
        if not n:
            return []
        out = np.zeros((n, BANDS), np.uint64)
        for b in range(BANDS):
            token = np.full(n, b + 1, np.uint64)
            for seed in _SEEDS[b * ROWS : (b + 1) * ROWS]:
                token = mix(token * np.uint64(31) + np.minimum.reduceat((self.flat ^ seed) * seed, self.ptr[:-1]))
            out[:, b] = token
        banded = np.diff(self.ptr) >= LEAST
        return [x if good else x[:0] for x, good in zip(out.view(np.int64), banded.tolist(), strict=True)]

    def sets(self) -> list[np.ndarray]:
        return [self.flat[a:b] for a, b in zip(self.ptr[:-1].tolist(), self.ptr[1:].tolist(), strict=True)]


def _may_link(n, at, m, of):
    """Sets of which one is too small cannot be similar enough."""
    return (n * 100 >= m * SIMILARITY) & (m * 100 >= n * SIMILARITY)


def _paragraphs(frame: DataFrame) -> DataFrame:
    def run(batches):
        for batch in chunks(batches, "text"):
            lines = Lines(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(lines.row)), pa.array(lines.place, pa.int32()), pa.array(lines.from_point, pa.int32()),
                    pa.array(lines.to_point, pa.int32()), pa.array(lines.ids), pa.array(np.diff(lines.ptr), pa.int32()),
                    pack(lines.bands(), pa.int64()), pack(parities(lines.flat, lines.ptr), pa.int64()),
                ],
                names=["doc", "place", "start", "end", "id", "n", "bands", "bits"],
            )

    return frame.mapInArrow(run, "doc long, place int, start int, end int, id long, n int, bands array<long>, bits array<long>")


def _sets(batches):
    for batch in chunks(batches, "text"):
        lines = Lines(*utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(lines.ids), pa.array([s.tobytes() for s in lines.sets()], pa.binary())], names=["id", "shingles"])


def _similar(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def repeated_paragraphs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each paragraph that another repeats: (id, paragraph, start, end, kept_in, copies, removed).

    ``start`` and ``end`` are code points of the text; ``kept_in`` is the document whose copy stays; ``removed`` is
    false for that copy only.
    """
    spark = docs.sparkSession
    frame = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    found = cut(_paragraphs(frame), "paragraphs")
    # A class of equal sets is an aggregate, partly taken before the shuffle. Its bands are alike in all members.
    classes = cut(found.groupBy("id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.min("doc").alias("doc")), "classes")
    rows = classes.select("id", "n", F.explode("bands").alias("token"), F.lit(0).alias("at")).select("token", "id", "n", "at")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counted = rows.groupBy(F.shiftrightunsigned("token", 64 - SKETCH_BITS).alias("place")).agg(F.count("*").alias("n"))
    for batch in counted.toArrow().to_batches():
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared = cut(meet(rows, spark.sparkContext.broadcast(counts), _may_link), "banded")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        where = classes.join(wanted, "id", "left_semi").select(F.col("doc").alias("id")).distinct()
        sets = among(frame, where, _sets, "id long, shingles binary", "doc").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
        sets = cut(sets, "sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        return _similar(both)

    groups = linked_groups(shared, classes.select("id", "n", "bits"), SIMILARITY, _may_link, verify)
    members = found.select("doc", "place", "start", "end", "id").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    members = cut(members.drop("component", "id"), "members")
    kept = members.groupBy("group").agg(F.min(F.struct("doc", "place")).alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    return members.join(kept, "group").select(
        F.col("doc").alias(id), F.col("place").alias("paragraph"), "start", "end", F.col("keep.doc").alias("kept_in"), "copies",
        (F.struct("doc", "place") != F.col("keep")).alias("removed"),
    ).distinct()


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns, with the paragraphs to be removed, and their line ends, taken out of the text."""
    gone = repeated_paragraphs(docs, id=id, text=text).where("removed")
    per = gone.groupBy(F.col(id).alias("__id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__gone"))
    both = docs.join(per, F.col(id).cast("long") == F.col("__id"), "left")
    # Pieces between removed paragraphs: from one's line end to the next one's start.
    size = F.char_length(text)
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))),
        F.transform("__gone", lambda g: F.struct(g["start"].alias("a"), (g["end"] + 1).alias("b"))),
        F.array(F.struct(size.alias("a"), size.alias("b"))),
    )
    pieces = F.zip_with(
        F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1),
        lambda x, y: F.substring(F.col(text), x["b"] + 1, F.greatest(y["a"] - x["b"], F.lit(0))),
    )
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return both.select(*[left.alias(c) if c == text else docs[c] for c in docs.columns])

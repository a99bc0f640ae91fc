"""Set similarity join of documents on word n-grams, by rare-first prefix filtering.

A document's set is its distinct five-word shingles, known by 64-bit hashes. Equal sets are one class from the start.
Shingles are ordered from rare to frequent; rarity is read from a sketch of ``SKETCH`` counters over
all documents, so its size does not grow. Two sets of n and m that share enough (100 i >= 80 u) share one of the first
n - ceil(0.8 n) + 1 shingles of that order (prefix filter). Prefix shingles are the join keys, together with a size class, since
linked sets differ by a quarter at most (length filter). A pair is dropped if too little is left behind the shared shingle
(positional filter), or if the counts of shingles by hash range, compared before the sets are, rule it out
(suffix filter). The parity bits of ``graph`` say nothing of long sets, so these have more of them, and a pair of long sets meets by its bits before
the sets are sent. A pair is verified once, on whole sets.

Shingles that occur once in all prefixes are dropped in a pass over sorted rows (``graph.meet``), which deals frequent ones
over several partitions.

Inputs: null, empty or blank texts have an empty set and link with nothing. Texts with fewer than five words have
one shingle. Texts are taken whole. Ids must be distinct and not null; rows with a null id are left out. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import PARITY_WORDS, SKETCH_BITS, among, linked_groups, meet, parity, place
from palimpsest.llm.text import BLANKS, Words, chunks, mix, pack, shingle_sets, utf8
from palimpsest.session import cut

WORDS = 5
SKETCH = 1 << SKETCH_BITS
RANGES = 16
FLUSH = 1 << 24


def _digest(found: np.ndarray) -> bytes:
    """128 bits for a set; sums of two mixes, so order does not matter."""
    with np.errstate(over="ignore"):
        return np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()


def wide_parity(found: np.ndarray) -> bytes | None:
    """As ``parity``, with a bit or more for each member; null where 512 bits are enough."""
    if len(found) <= 64 * PARITY_WORDS:
        return None
    width = 1 << (len(found) - 1).bit_length()
    at = (found >> np.uint64(20)) & np.uint64(width - 1)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_differ(x: bytes, y: bytes) -> int:
    """How many members two sets differ in, at least; the longer parity is folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def set_digests(docs: DataFrame, *, id: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(id, n, digest, bits, wide) of each document's set, and the sketch of how many documents hold the shingles of each counter."""

    def run(batches):
        seen, since = np.zeros(SKETCH, np.int64), 0
        names = ["id", "n", "digest", "bits", "wide", "place", "seen"]

        def flush():
            at = np.flatnonzero(seen)
            none = lambda kind: pa.nulls(len(at), kind)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.list_(pa.int64())), none(pa.binary()), pa.array(at, pa.int32()), pa.array(seen[at])], names=names)

        for batch in chunks(batches, "text"):
            sets = shingle_sets(Words(*utf8(batch.column(1)), BLANKS), WORDS)
            joined = np.concatenate(sets)
            np.add.at(seen, place(joined), 1) if len(joined) < 64 else seen.__iadd__(np.bincount(place(joined), minlength=SKETCH))
            since += len(joined)
            n = pa.array([len(s) for s in sets], pa.int32())
            none = lambda kind: pa.nulls(len(sets), kind)  # noqa: E731, B023
            wide = pa.array([wide_parity(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, pa.array([_digest(s) for s in sets], pa.binary()), pack([parity(s) for s in sets], pa.int64()), wide, none(pa.int32()), none(pa.int64())], names=names
            )
            if since > FLUSH:
                yield flush()
                seen[:], since = 0, 0
        if since:
            yield flush()

    found = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    both = cut(found.mapInArrow(run, "id long, n int, digest binary, bits array<long>, wide binary, place int, seen long"), "sets")
    sketch = np.zeros(SKETCH, np.int64)
    for r in both.where("place is not null").groupBy("place").agg(F.sum("seen").alias("seen")).toArrow().to_batches():
        sketch[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return both.where("place is null").select("id", "n", "digest", "bits", "wide"), sketch


def prefix_length(n: int) -> int:
    return n - -(-80 * n // 100) + 1


def _prefixes(docs: DataFrame, sketch) -> DataFrame:
    """(id, n, prefix): the rarest shingles of each set, in order."""

    def run(batches):
        counts = sketch.value
        for batch in chunks(batches, "text"):
            out = []
            sets = shingle_sets(Words(*utf8(batch.column(1)), BLANKS), WORDS)
            for s in sets:
                order = np.lexsort((s, counts[place(s)]))[: prefix_length(len(s)) if len(s) else 0]
                out.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pack(out, pa.int64())], names=["id", "n", "prefix"]
            )

    return docs.mapInArrow(run, "id long, n int, prefix array<long>")


def _least_left(n, at, m, of):
    """Length and positional bound on arrays or columns: the shared shingle and what follows it suffice in both sets."""
    return ((n - at) * 180 >= (n + m) * 80) & ((m - of) * 180 >= (n + m) * 80)


def _sets(batches):
    """(id, shingles) with sorted 64-bit shingles, packed."""
    for batch in chunks(batches, "text"):
        sets = shingle_sets(Words(*utf8(batch.column(1)), BLANKS), WORDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _ruled_out(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Of (a, b), the pairs of long sets whose sizes and wide parities allow no link."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = [wide_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(np.array(differ, np.int64) * 180 > (n + m) * 20))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = wide.join(wanted, "id", "left_semi")
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a").join(
        held.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b"
    )
    return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sa, sb), the pairs that share enough: counts by hash range first, then whole sets."""

    def run(batches):
        edges = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(x) + len(y)
                cx, cy = (np.diff(np.searchsorted(s, edges), prepend=0, append=len(s)) for s in (x, y))
                most = int(np.minimum(cx, cy).sum())
                good.append(180 * most >= 80 * n and 180 * len(np.intersect1d(x, y, assume_unique=True)) >= 80 * n)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the size of each document's set, and the smallest id that links reach."""
    spark = docs.sparkSession
    frame = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    digests, counts = set_digests(docs, id=id, text=text)
    sketch = spark.sparkContext.broadcast(counts.astype(np.int64))
    # A group of equal sets is one minimum, taken partly before the shuffle; its members then join it.
    classes = cut(digests.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    prefixes = _prefixes(frame, sketch).where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    rows = prefixes.select("id", "n", F.posexplode("prefix").alias("at", "token")).select("token", "id", "n", "at")
    shared = cut(meet(rows, sketch, _least_left), "shared")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.join(_ruled_out(pairs, digests.where("wide is not null").select("id", "n", "wide")), ["a", "b"], "left_anti"), "pairs-open")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = cut(among(frame, wanted, _sets, "id long, shingles binary"), "shingles")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        return _linked(both)

    groups = linked_groups(shared, digests.select("id", "n", "bits"), 80, _least_left, verify).select(F.col("id").alias("rep"), "component")
    reps = classes.join(groups, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return digests.join(reps, "digest", "left").select(
        F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )

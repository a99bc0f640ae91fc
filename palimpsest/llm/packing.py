"""Packing of token sequences: length patterns fitted to the histogram of lengths, then best fit for the rest.

``pieces`` encodes texts, ends each with one more id, and cuts what is longer than a sequence. ``pack`` gives each piece a
sequence and a place in it. Only the histogram of lengths reaches the driver: at most ``size`` counts, whatever the input.
There, patterns of up to ``DEPTH`` length classes that fill a sequence are enumerated, their repeat counts fitted to the
histogram by non-negative least squares, rounded, and dealt out. What is left over goes into the fullest sequence that
still has room, longest first; both steps handle runs of equal sequences at once, so their work depends on ``size`` alone. The outcome
is a short table from (length, rank among pieces of that length) to (sequence, place). Ranks are counted in Spark in blocks
of about ``BLOCK`` pieces of one length, so a length that a third of all pieces share is no hot group. ``sequences`` sets
the ids of each sequence end to end.

Inputs: null and empty texts have no id of their own and become pieces of one id. Texts are taken whole, of any length; equal rows
and rows with equal or null ids are pieces of their own. An empty table gives an empty result. Columns in ``keep`` come
along, except those named like a result. ``pack`` keeps all columns and takes any table with a length from 1 to ``size``;
lengths that are null or outside are refused. Ties among pieces of one length go by a hash of their row, then by any order: lengths, and so the number
of sequences, do not depend on it.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.text import chunks
from palimpsest.llm.wordtokens import encoder
from palimpsest.session import cut

SIZE = 4096
#: Documents in a pattern at most, and classes of length that patterns are made of.
DEPTH = 3
CLASSES = 256
BLOCK = 8192
RANK_BITS = 48
CHUNK = 1 << 22


# Texts to pieces


def pieces(docs: DataFrame, tokenizer: str, *, keep: list[str], size: int = SIZE, end_id: int = 1, text: str = "text") -> DataFrame:
    """``keep``, piece, start, length, ids (32-bit numbers in a binary): each text's ids and the end id, cut to ``size``."""
    spark = docs.sparkSession
    clash = {"piece", "start", "length", "ids"} & set(keep)
    if clash:
        raise ValueError(f"keep may not hold {sorted(clash)}")
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def run(batches):
        tokens = encoder(shared.value)
        for batch in chunks(batches, "__text", CHUNK):
            ids, offsets = tokens.encode(batch.column(batch.num_columns - 1))
            n = np.diff(offsets) + 1
            parts = -(-n // size)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(size, n[row] - piece * size)
            ended = np.insert(ids, offsets[1:], end_id).astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(length)]) * 4
            # Arrow's plain binary columns hold less than 2 GiB.
            for a, b in _slices(bounds):
                data = pa.py_buffer(ended.view(np.uint8)[bounds[a] : bounds[b]])
                cells = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((bounds[a : b + 1] - bounds[a]).astype(np.int32)), data])
                kept = [c.take(pa.array(row[a:b])) for c in batch.columns[:-1]]
                own = [pa.array(piece[a:b], pa.int32()), pa.array(piece[a:b] * size, pa.int64()), pa.array(length[a:b], pa.int64()), cells]
                yield pa.RecordBatch.from_arrays([*kept, *own], names=[*keep, "piece", "start", "length", "ids"])

    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    return rows.mapInArrow(run, schema)


def _slices(bounds: np.ndarray, limit: int = 1 << 24):
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, to
        at = to


# The histogram to a plan


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set: columns enter while they lower the error, and leave at zero."""
    target = a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-7 * max(1.0, np.abs(target).max(initial=0.0))
    ridge = 1e-9 * max(1.0, (a * a).sum(0).max(initial=0.0))  # patterns may be linearly dependent
    for _ in range(rounds):
        at = np.flatnonzero(passive)
        slope = (b - a[:, at] @ x[at]) @ a
        slope[passive] = -np.inf
        enter = int(slope.argmax())
        if slope[enter] <= tolerance:
            break
        passive[enter] = True
        while True:
            at = np.flatnonzero(passive)
            active = a[:, at]
            solved = np.linalg.solve(active.T @ active + ridge * np.eye(len(at)), target[at])
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            old = x[at]
            steps = old[low] / np.maximum(old[low] - solved[low], 1e-300)
            x[at] = np.maximum(old + steps.min() * (solved - old), 0)
            leaves = at[low & (x[at] <= 1e-12)]
            passive[leaves if len(leaves) else at[low]] = False
            x[~passive] = 0
    return x


def patterns(present: list[int], classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` present classes that fill all places of a sequence, longest first."""
    here, out = set(present), []
    for head in range(depth):
        for some in combinations_with_replacement(sorted(here, reverse=True), head):
            last = classes - sum(some)
            if last in here and (not some or last <= some[-1]):
                out.append((*some, last))
    return out


class _Pool:
    """Lengths of one class that are not placed yet, longest first: (length, next rank, how many)."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = [[length, 0, n] for length, n in sorted(runs, reverse=True)]

    @property
    def left(self) -> int:
        return sum(r[2] for r in self.runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            run = self.runs[0]
            m = min(n, run[2])
            out.append((run[0], run[1], m))
            run[1], run[2], n = run[1] + m, run[2] - m, n - m
            if not run[2]:
                self.runs.pop(0)
        return out


class Plan:
    """Intervals of ranks of each length: piece ``lo + i`` goes to sequence ``base + i // per``, at ``offset + i % per * length``."""

    def __init__(self, counts: dict[int, int], size: int = SIZE, depth: int = DEPTH, classes: int = CLASSES):
        self.size, self.used, self.rows = size, 0, []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        width = -(-size // min(classes, size))
        places = size // width
        self.pools: dict[int, _Pool] = {}
        by_class: dict[int, list] = {}
        for length, n in counts.items():
            by_class.setdefault(-(-length // width), []).append((length, n))
        self.pools = {c: _Pool(runs) for c, runs in by_class.items()}
        self._fit([c for c in self.pools if c <= places], places, depth)
        self._rest()

    def _fit(self, present: list[int], places: int, depth: int) -> None:
        known = patterns(present, places, depth)
        if not known:
            return
        order = {c: i for i, c in enumerate(present)}
        a = np.zeros((len(present), len(known)))
        for j, p in enumerate(known):
            for c in p:
                a[order[c], j] += 1
        b = np.array([self.pools[c].left for c in present], float)
        weight = np.sqrt(np.array(present, float) / places)  # a long piece left over costs more than a short one
        repeats = np.rint(nnls(a * weight[:, None], b * weight))
        for j in np.argsort(-repeats, kind="stable"):
            n = int(repeats[j])
            for c in set(known[j]):
                n = min(n, self.pools[c].left // known[j].count(c))
            if n > 0:
                self._deal(known[j], n)

    def _deal(self, pattern: tuple[int, ...], n: int) -> None:
        """``n`` new sequences with a piece of each class of the pattern; sequences of equal lengths stay one run."""
        open_runs = [(self.used, n, 0)]
        self.used += n
        for c in pattern:
            taken, after = self.pools[c].take(n), []
            for base, m, filled in open_runs:
                while m:
                    length, lo, have = taken[0]
                    k = min(m, have)
                    self.rows.append((length, lo, lo + k, base, filled, 1))
                    after.append((base, k, filled + length))
                    base, m = base + k, m - k
                    taken[0] = (length, lo + k, have - k)
                    if k == have:
                        taken.pop(0)
            open_runs = after
        for base, m, filled in open_runs:
            self.room[self.size - filled].append((base, m))

    def _rest(self) -> None:
        for length, rank, n in sorted((r for p in self.pools.values() for r in map(tuple, p.runs)), reverse=True):
            gap = length
            while n:
                while gap <= self.size and not self.room[gap]:
                    gap += 1
                if gap > self.size:
                    per = self.size // length
                    many = -(-n // per)
                    self.room[self.size].append((self.used, many))
                    self.used += many
                    gap = self.size
                base, m = self.room[gap].pop()
                per = gap // length
                full = min(m, n // per)
                if full:
                    self.rows.append((length, rank, rank + full * per, base, self.size - gap, per))
                    self.room[gap - per * length].append((base, full))
                    rank, n = rank + full * per, n - full * per
                    base, m = base + full, m - full
                if m and n and n < per:
                    self.rows.append((length, rank, rank + n, base, self.size - gap, n))
                    self.room[gap - n * length].append((base, 1))
                    base, m, n = base + 1, m - 1, 0
                if m:
                    self.room[gap].append((base, m))

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return (table[:, 0] << RANK_BITS | table[:, 1], *(table[:, i] for i in (1, 3, 4, 5)))


# Pieces to sequences


def pack(rows: DataFrame, *, size: int = SIZE, length: str = "length") -> DataFrame:
    """``rows`` with sequence_id and offset (long): no sequence holds more than ``size``, none has a gap."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    checked = F.when(F.col(length).between(1, size), F.col(length).cast("long"))
    refused = F.raise_error(F.lit(f"a length is null or not between 1 and {size}")).cast("long")
    kept = cut(rows.select(*[F.col(f"`{c}`") for c in names], F.coalesce(checked, refused).alias("__n")), "pieces")
    counts = {r["__n"]: r["n"] for r in kept.groupBy("__n").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    plan = spark.sparkContext.broadcast(Plan(counts, size).arrays())
    blocks = spark.createDataFrame([(k, -(-n // BLOCK)) for k, n in counts.items()], "__n long, __blocks long")
    dealt = kept.join(F.broadcast(blocks), "__n").withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    dealt = dealt.withColumn("__block", F.pmod("__h", "__blocks"))
    # Where each block's ranks begin: a running sum over counts, one row for a block.
    sizes = dealt.groupBy("__n", "__block").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("__n").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__n", "__block", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__n", "__block").orderBy("__h")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(sizes, ["__n", "__block"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in names], "__n", (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))

    def place(batches):
        keys, lo, base, offset, per = plan.value
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (-2, -1))
            at = np.searchsorted(keys, n << RANK_BITS | rank, side="right") - 1
            i = rank - lo[at]
            own = [pa.array(base[at] + i // per[at], pa.int64()), pa.array(offset[at] + i % per[at] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *own], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:-2]]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame, *, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, starts): the ids of each sequence set end to end, and where its pieces begin."""
    entry = F.sort_array(F.collect_list(F.struct("offset", F.hex(ids).alias("h"))))  # at most ``size`` pieces
    whole = packed.groupBy("sequence_id").agg(entry.alias("p"))
    return whole.select(
        "sequence_id", F.unhex(F.array_join("p.h", "")).alias("ids"), F.col("p.offset").alias("starts")
    )

"""Hard negatives by exact inner product, from lists that clusters of anchors share.

Anchors are put into clusters of like direction by k-means, fitted on at most ``FIT`` anchors. Candidates are dealt into blocks. Where a
cluster meets a block, the block's rows are sorted once by a bound that holds for every anchor of the cluster: a row's
length times the cosine of its angle to the cluster's centre, less the widest angle of an anchor to that centre. Each anchor
walks that list from the top and stops once its k-th best score is above the bound of all that follows: its result
is then certain. The best of all blocks are merged. A first walk finds the positives, the nearest rows of an anchor's own label; a
second one finds, for each positive, the nearest rows of other labels whose score lies between two shares of the positive's.

Anchors meet blocks in rectangles of at most about ``BLOCK`` rows and ``PART`` anchors, so no group grows with the data, and a
label, cluster or vector that many rows share is dealt out like any other.

Vectors hold whole numbers and scores are exact: in double precision where no product sum can leave its range, in whole
numbers of any size otherwise; a score that a long cannot hold raises an error. Order: higher score, then smaller id.

Inputs: rows with a null id, null label, null vector or a null component take no part. Only vectors of the same length are
compared. A zero vector scores 0 with all. Repeated rows are candidates of their own, but an anchor leaves out rows of its own id, and
equal anchors are answered once; anchors of one id that differ are answered each. An empty table, no anchors, or anchors
without positives give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.ann import kmeans
from palimpsest.session import cut

FIT = 20_000
CLUSTER = 128
MAX_CLUSTERS = 256
CELL = 1024
BLOCK = 8192
PART = 4096
STEP = 256
#: What rounding may take off an angle's cosine.
SLACK = 1e-7
_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def lengths_and_units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean lengths and directions; a zero vector has none. Scaled by the largest component, so that squares stay in range."""
    v = v.astype(np.float64)
    top = np.abs(v).max(1, initial=0.0, keepdims=True)
    u = v / np.where(top > 0, top, 1)
    n = np.sqrt((u * u).sum(1, keepdims=True))
    return (n * top)[:, 0], u / np.where(n > 0, n, 1)


class Block:
    """Candidates with their lengths and directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths, self.units = lengths_and_units(vectors)

    def ordered(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by falling bound for anchors of these directions, and the bounds, to be multiplied by an anchor's length."""
        directed = units[(units != 0).any(1)]
        centre = directed.sum(0) if len(directed) else np.zeros(units.shape[1])
        centre = centre / max(np.sqrt((centre * centre).sum()), 1e-300)
        width = np.arccos(np.clip(directed @ centre, -1, 1)).max(initial=0.0)
        angle = np.arccos(np.clip(self.units @ centre, -1, 1))
        bound = self.lengths * (np.cos(np.maximum(angle - width, 0)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, all rows with all rows."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if reach < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return exact.astype(np.int64)  # raises OverflowError beyond a long


class Best:
    """The k best (score, id) of each of some rows."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((rows, k), _LEAST), np.full((rows, k), _LAST)
        self.count = np.zeros(rows, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``rows`` with candidates ``ids``, where allowed."""
        seen = np.where(allowed, scores, _LEAST)
        edge = self.scores[rows, -1]
        if seen.shape[1] > self.k:
            edge = np.maximum(edge, np.partition(seen, seen.shape[1] - self.k, axis=1)[:, seen.shape[1] - self.k])
        r, c = np.nonzero(allowed & (seen >= edge[:, None]))
        if not len(r):
            return
        touched = np.unique(r)
        held = np.arange(self.k)[None, :] < self.count[rows[touched], None]
        old = rows[touched]
        row = np.concatenate([np.repeat(old, held.sum(1)), rows[r]])
        score = np.concatenate([self.scores[old][held], seen[r, c]])
        id_ = np.concatenate([self.ids[old][held], ids[c]])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, id_, place = (x[place < self.k] for x in (row, score, id_, place))
        self.scores[row, place], self.ids[row, place] = score, id_
        self.count[rows[touched]] = np.bincount(row, minlength=len(self.count))[rows[touched]]

    def certain(self, rows: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Whether the k-th best is above all that may follow; an equal score might still have a smaller id."""
        return (self.count[rows] == self.k) & (self.scores[rows, -1].astype(np.float64) > rest)


def walk(block: Block, vectors: np.ndarray, meet, done) -> int:
    """Members of one cluster walk the block's list; returns how many products were taken.

    ``meet(rows, scores, places)`` gets the scores of the members still walking with the next candidates, ``done(rows, rest)`` says
    who may stop when nothing that follows can score above ``rest``.
    """
    lengths, units = lengths_and_units(vectors)
    order, bound = block.ordered(units)
    active, at, step, taken = np.arange(len(vectors)), 0, STEP, 0
    while at < len(order) and len(active):
        some = order[at : at + step]
        meet(active, products(vectors[active], block.vectors[some]), some)
        taken += len(active) * len(some)
        at, step = at + step, min(2 * step, 4096)
        if at < len(order):
            active = active[~done(active, bound[at] * lengths[active])]
    return taken


def find_positives(block: Block, ids, labels, vectors, k: int) -> Best:
    best = Best(len(ids), k)

    def meet(rows, scores, places):
        allowed = (labels[rows, None] == block.labels[places][None, :]) & (ids[rows, None] != block.ids[places][None, :])
        best.add(rows, scores, allowed, block.ids[places])

    walk(block, vectors, meet, best.certain)
    return best


def find_negatives(block: Block, ids, labels, vectors, targets: np.ndarray, n_targets: np.ndarray, k: int, low: int, high: int) -> list[Best]:
    """For each place in ``targets`` (one column for a positive), the k best of other labels within low to high hundredths of it."""
    best = [Best(len(ids), k) for _ in range(targets.shape[1])]

    def meet(rows, scores, places):
        other = (labels[rows, None] != block.labels[places][None, :]) & (ids[rows, None] != block.ids[places][None, :])
        for j, b in enumerate(best):
            use = rows[n_targets[rows] > j]
            if not len(use):
                continue
            part = slice(None) if len(use) == len(rows) else n_targets[rows] > j
            s, t = scores[part], targets[use, j][:, None]
            b.add(use, s, other[part] & (low * t <= 100 * s) & (100 * s <= high * t), block.ids[places])

    def done(rows, rest):
        out = np.ones(len(rows), bool)
        for j, b in enumerate(best):
            below = 100.0 * rest < low * targets[rows, j].astype(np.float64)
            out &= (n_targets[rows] <= j) | below | b.certain(rows, rest)
        return out

    walk(block, vectors, meet, done)
    return best


def _matrix(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _cells(table: pa.Table):
    """The anchors of a group, cluster by cluster."""
    cell = table.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        yield table.take(pa.array(some))


def _clusters(anchors: DataFrame) -> DataFrame:
    """``anchors`` with a cell: a cluster of like direction, dealt out where it has more than about ``CELL`` anchors."""
    spark = anchors.sparkSession
    sample = anchors.select("v", "width", "key").orderBy(F.xxhash64("key"), "key").limit(FIT).collect()  # bounded by FIT
    widths = [r["width"] for r in sample]
    common = max(set(widths), key=lambda w: (widths.count(w), -w)) if sample else 0
    x = lengths_and_units(np.array([r["v"] for r in sample if r["width"] == common], np.float64).reshape(-1, max(common, 1)))[1] if common else np.zeros((0, 1))
    k = min(MAX_CLUSTERS, len(x) // CLUSTER)
    shared = spark.sparkContext.broadcast(kmeans(x, k) if k > 1 else x[:1])

    def assign(batches):
        centres = shared.value
        for batch in batches:
            width = batch.column(batch.schema.get_field_index("width")).to_numpy()
            near = np.zeros(len(width), np.int32)
            fits = np.flatnonzero(width == common)
            if len(fits) and common:
                v = batch.column(batch.schema.get_field_index("v")).take(pa.array(fits)).flatten().to_numpy()
                near[fits] = (lengths_and_units(v.reshape(len(fits), common))[1] @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "cluster"])

    found = cut(anchors.mapInArrow(assign, T.StructType([*anchors.schema.fields]).add("cluster", "integer")), "anchors")
    sizes = found.groupBy("width", "cluster").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    dealt = found.join(sizes, ["width", "cluster"])
    return dealt.withColumn("cell", F.xxhash64("cluster", F.pmod(F.xxhash64("key", F.lit(1)), "cells"))).drop("cluster", "cells")


def mine(
    vectors: DataFrame, is_anchor: Column, *, id: str = "vec_id", vector: str = "vector", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    ``positives`` nearest rows of its label, the ``negatives`` nearest rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"), is_anchor.alias("asks"))
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole).withColumn("width", F.size("v"))
    rows = cut(rows.withColumn("key", F.xxhash64("id", "label", "v")), "vectors")
    n, n_anchors = rows.count(), rows.where("asks").count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-n_anchors // PART))
    anchors = cut(_clusters(rows.where("asks").drop("asks").dropDuplicates(["id", "label", "v"])), "cells")
    left = rows.select(
        "width", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "label", "v",
    )
    keys = ["width", "block", "part"]

    def meeting(asking: DataFrame, *more: str):
        return left.groupBy(*keys).cogroup(
            asking.select(
                "width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                F.pmod(F.xxhash64("cell", F.lit(3)), F.lit(parts)).cast("int").alias("part"), "cell", "id", "key", "label", "v", *more,
            ).groupBy(*keys)
        )

    def block_of(table: pa.Table) -> tuple[Block, int]:
        width = table.column("width")[0].as_py()
        return Block(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"), width)), width

    def first(table: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and asking.num_rows:
            block, width = block_of(table)
            for cell in _cells(asking):
                ids, labels = cell.column("id").to_numpy(), cell.column("label").to_numpy()
                b = find_positives(block, ids, labels, _matrix(cell.column("v"), width), positives)
                r, c = np.nonzero(np.arange(positives)[None, :] < b.count[:, None])
                out.append((ids[r], cell.column("key").to_numpy()[r], b.ids[r, c], b.scores[r, c]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(columns, names=["anchor_id", "key", "positive_id", "positive_score"])

    found = meeting(anchors).applyInArrow(first, "anchor_id long, key long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    one = F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score")))  # ``positives`` entries at most
    chosen = top.groupBy(F.col("anchor_id").alias("id"), "key").agg(one.alias("p"))
    chosen = chosen.select("id", "key", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("targets"))
    asking = cut(anchors.join(chosen, ["id", "key"]), "asking")

    def second(table: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and asking.num_rows:
            block, width = block_of(table)
            for cell in _cells(asking):
                ids, labels = cell.column("id").to_numpy(), cell.column("label").to_numpy()
                lists, named = cell.column("targets").to_pylist(), cell.column("positive_ids").to_pylist()
                n_targets = np.array([len(x) for x in lists])
                targets, names = (np.array([x + [0] * (positives - len(x)) for x in y], np.int64) for y in (lists, named))
                for j, b in enumerate(find_negatives(block, ids, labels, _matrix(cell.column("v"), width), targets, n_targets, negatives, low, high)):
                    r, c = np.nonzero(np.arange(negatives)[None, :] < b.count[:, None])
                    out.append((ids[r], cell.column("key").to_numpy()[r], np.full(len(r), j), names[r, j], targets[r, j], b.ids[r, c], b.scores[r, c]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
        return pa.table(columns, names=["anchor_id", "key", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id long, key long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = meeting(asking, "positive_ids", "targets").applyInArrow(second, schema)
    order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

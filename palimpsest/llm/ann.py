"""Approximate nearest neighbours by cosine, with a tree of k-means centres.

The tree is fitted on at most ``FIT`` vectors, chosen by a hash of their ids; every vector is indexed, in the leaf that a
descent to the nearest centres ends in. A query walks the tree best bin first: a priority queue holds the centres met
so far, the most similar is opened next, and leaves come out in the order in which to visit them. How many leaves to visit
is calibrated: ``CALIBRATE`` queries are answered by brute force over all vectors, and visits are widened until
the leaves visited hold a share of ``RECALL`` of the true neighbours.

Vectors and queries meet per leaf. A leaf of many vectors is dealt out in blocks of about ``BLOCK`` rows, and its queries in
blocks as well, so that no group grows with the data. Equal vectors are one: of each, the ids that can be
among the nearest are kept (k + 1), and equal queries are answered once.

Scores are cosines in double precision, summed the same way for every pair; ties go to the smaller id.

Inputs: vectors that are null, empty, zero, or hold a null or non-finite component, rows with a null id, and vectors of another
length than most take no part, neither as query nor as candidate. Repeated ids are separate rows; a query leaves out
candidates of its own id. An empty table gives an empty result. Columns not named are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut

FIT = 20_000
LEAF = 400
MAX_LEAVES = 512
CALIBRATE = 200
RECALL = 0.97
BLOCK = 4096
QUERY_BLOCK = 1024
SLACK = 1e-9


def _tamed(x: np.ndarray) -> np.ndarray:
    """Rows whose squares might leave the range of doubles, divided by their largest component; others as they are."""
    top = np.abs(x).max(1, initial=0.0, keepdims=True)
    odd = (top > 0) & ((top < 1e-140) | (top > 1e140))
    return np.where(odd, x / np.where(odd, top, 1), x) if odd.any() else x


def unit(x: np.ndarray) -> np.ndarray:
    x = _tamed(x)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by cosine, from evenly spaced members on; fewer if clusters run empty."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = unit(sums[np.bincount(near, minlength=len(centres)) > 0])
    return centres


class Tree:
    """Nodes by number; node 0 is the root. Inner nodes have children's numbers and centres, leaves have neither."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self._grow(x, leaves)
        self.leaf = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not len(c))}

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.children)
        self.children.append(np.zeros(0, int))
        self.centres.append(np.zeros((0, x.shape[1])))
        k = min(16, leaves, len(x) // 4)
        if k >= 2:
            centres = kmeans(x, k)
            if len(centres) >= 2:
                near = (x @ centres.T).argmax(1)
                self.centres[at] = centres
                self.children[at] = np.array([self._grow(x[near == j], round(leaves * (near == j).mean())) for j in range(len(centres))])
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(self.children[node]):
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centres[node].T).argmax(1)
            todo += [(int(c), rows[near == j]) for j, c in enumerate(self.children[node]) if (near == j).any()]
        return out

    def walk(self, q: np.ndarray, limit: int) -> list[int]:
        """The first ``limit`` leaves for a unit vector, best bin first."""
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < limit:
            _, node = heapq.heappop(queue)
            if not len(self.children[node]):
                out.append(self.leaf[node])
                continue
            for near, child in zip((self.centres[node] @ q).tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (-near, child))
        return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each summed alike whatever stands beside it."""
    a, b = _tamed(a), _tamed(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest candidates of each query: a matrix product finds them, exact cosines rank them."""
    out = []
    rows = unit(vectors)
    for a in range(0, len(queries), 256):
        near = unit(queries[a : a + 256]) @ rows.T
        if near.shape[1] > k:
            edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            q, r = np.nonzero(near >= edge[:, None] - SLACK)
        else:
            q, r = np.nonzero(np.ones_like(near, bool))
        score = cosines(queries[a + q], vectors[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        out.append(pd.DataFrame({"query_id": query_ids[a + q[top]], "vec_id": ids[r[top]], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _usable(rows: DataFrame) -> DataFrame:
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark keeps k per query and task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its k nearest other rows."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")))
    rows = cut(rows.withColumn("key", F.xxhash64("v")), "vectors")
    # Of equal vectors, the k + 1 smallest ids can be among anyone's nearest.
    same = Window.partitionBy("key", "v").orderBy("id")
    kept = cut(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).select("id", "v"), "candidates")
    asked = rows.where("asks").groupBy("key", "v").agg(F.min("id").alias("query_id"))
    asked = cut(asked, "queries")
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(FIT).collect()  # bounded by FIT
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = unit(np.array([r["v"] for r in sample], np.float64))
    count = kept.count()
    tree = Tree(x, int(min(MAX_LEAVES, max(1, count // LEAF), max(1, len(x) // 8))))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        tree = shared.value
        for batch in batches:
            leaf = tree.assign(unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    indexed = cut(kept.mapInArrow(assign, "id long, v array<double>, leaf int"), "indexed")
    visits = _calibrate(indexed, asked, tree, k)

    def walk(batches):
        tree = shared.value
        for batch in batches:
            q = unit(_matrix(batch.column(1))) if batch.num_rows else []
            leaves = [tree.walk(v, visits) for v in q]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "v", "leaves"])

    walks = asked.select("query_id", "v").mapInArrow(walk, "query_id long, v array<double>, leaves array<int>")
    walks = cut(walks.select("query_id", "v", F.explode("leaves").alias("leaf")), "visits")
    # Leaves are bounded in number, so both counts are small tables.
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = walks.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    plan = F.broadcast(cut(sizes.join(asks, "leaf"), "leaves"))
    left = indexed.join(plan, "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v"
    )
    right = walks.join(plan, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "v"
    )

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best(rows["id"].to_numpy(), np.stack(rows["v"]), queries["query_id"].to_numpy(), np.stack(queries["v"]), k + 1)

    keys = ["leaf", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    top = cut(_top(found, k + 1).select("query_id", "vec_id", "score"), "top")
    # Back to every asking row: equal queries share an answer, each without itself.
    heads = rows.where("asks").select("key", "v", F.col("id").alias("asker"))
    answered = heads.join(asked.select("key", "v", "query_id"), ["key", "v"]).select("asker", "query_id").join(top, "query_id")
    answered = answered.where("asker <> vec_id").select(F.col("asker").alias("query_id"), "vec_id", "score").distinct()
    return _top(answered, k).select("query_id", "rank", "vec_id", "score")


def _calibrate(indexed: DataFrame, asked: DataFrame, tree: Tree, k: int) -> int:
    """How many leaves to visit, from the true neighbours of a bounded sample of queries."""
    chosen = asked.select("query_id", "v").orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATE).collect()
    if not chosen:
        return 1
    shared = indexed.sparkSession.sparkContext.broadcast(
        (np.array([r["query_id"] for r in chosen]), np.array([r["v"] for r in chosen], np.float64))
    )

    def brute(batches):
        query_ids, queries = shared.value
        for batch in batches:
            if batch.num_rows:
                leaf = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                found = best(batch.column(0).to_numpy(), _matrix(batch.column(1)), query_ids, queries, k + 1)
                found["leaf"] = [leaf[i] for i in found["vec_id"]]
                yield pa.RecordBatch.from_pandas(found.astype({"leaf": "int32"}), preserve_index=False)

    true = _top(indexed.mapInArrow(brute, "query_id long, vec_id long, score double, leaf int"), k + 1).collect()
    orders = {r["query_id"]: {leaf: i for i, leaf in enumerate(tree.walk(unit(np.array([r["v"]]))[0], len(tree.leaf)))} for r in chosen}
    places = np.sort([orders[r["query_id"]][r["leaf"]] for r in true if r["vec_id"] != r["query_id"]])
    return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))))]) + 1 if len(places) else 1

"""Connected components by joins, and finding links inside buckets without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.text import mix
from palimpsest.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that it reaches.

    Every id points at the smallest id known to be with it. In each round an edge's two ends exchange what they
    point at, and what was pointed at learns of smaller ones, so that chains halve. Each step is a join and a minimum,
    which is partly taken before the shuffle; a hub with many edges is no group that must be held together.
    Every round is cut to a table. Only a count comes to the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links, "links")
    first = links
    while True:
        # Large star: an id's larger neighbours, and itself, link to its smallest neighbour.
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, both["a"] == low["id"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: an id's smaller neighbours, and itself, link to the smallest of them.
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.withColumnRenamed("a", "id").join(small_low.withColumnRenamed("a", "id"), "id")
        small = (
            moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(small_low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = cut(small, "links")
        left = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if left and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            links = after
            break
        links = after
    ends = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct()
    return ends.join(links.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


SKETCH_BITS = 18
HOT = 4096
SALTS = 64


def place(tokens: np.ndarray) -> np.ndarray:
    """A token's counter in a sketch."""
    return (tokens.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def meet(rows: DataFrame, sketch, may_link: Callable) -> DataFrame:
    """Rows (token, id, n, at) whose token others may have too, each with two it may link with: ``first`` and ``near``.

    Rows of a token lie side by side, by n, in one partition; a pass over them keeps one row at a time of what went before.
    ``near`` is the row before, ``first`` the first of the same token and size class; null where ``may_link`` rules them out.
    A token whose sketch counter is high may hold a large share of the rows: it is dealt over ``SALTS`` partitions,
    which costs it some of these hints but no row.
    """

    def hot(tokens: np.ndarray) -> np.ndarray:
        counts = sketch.value
        return counts[place(tokens)] > 2 * counts.mean() + HOT

    def deal(batches):
        for batch in batches:
            t, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            salt = np.where(hot(t), mix(of.view(np.uint64)) % np.uint64(SALTS), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt)], names=[*batch.schema.names, "salt"])

    def run(batches):
        held, last, head = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                out, last, head = hint(held, last, head, batch.column(0)[0].as_py())
                yield out
            held = batch
        if held is not None:
            yield hint(held, last, head, None)[0]

    def hint(batch, last, head, after):
        """last: the row before; head: the first row of its token and size class."""
        t, of, n, at = (batch.column(i).to_numpy() for i in range(4))
        size = np.floor(np.log(np.maximum(n, 1)) / np.log(1.26)).astype(np.int64)
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        same[0], same[-1] = last is not None and last[0] == t[0], after == t[-1]
        again = same[:-1].copy()
        again[1:] &= size[1:] == size[:-1]
        again[0] = same[0] and head[4] == size[0]
        began = np.maximum.accumulate(np.where(again, -1, np.arange(len(t))))

        def partner(rows, carried):
            """Columns of the row at each index; -1 is the carried one."""
            return [np.where(rows < 0, carried[i + 1] if carried else 0, x[np.maximum(rows, 0)]) for i, x in enumerate((of, n, at))]

        out = []
        for rows, carried, holds in ((began, head, again), (np.arange(len(t)) - 1, last, same[:-1])):
            pid, pn, pat = partner(rows, carried)
            good = holds & (pid != of) & may_link(n, at, pn, pat)
            out.append(pa.array(np.where(good, pid, 0), pa.int64(), mask=~good))
        end = len(t) - 1
        last = (t[end], of[end], n[end], at[end], size[end])
        head = head if began[end] < 0 else tuple(x[began[end]] for x in (t, of, n, at, size))
        kept = pa.array(same[1:] | same[:-1] | hot(t))
        return pa.RecordBatch.from_arrays([*batch.columns, *out], names=["token", "id", "n", "at", "first", "near"]).filter(kept), last, head

    schema = "token long, id long, n int, at int"
    dealt = rows.select("token", "id", "n", "at").mapInArrow(deal, f"{schema}, salt int")
    dealt = dealt.repartition("token", "salt").sortWithinPartitions("token", "n", "id").drop("salt")
    return dealt.mapInArrow(run, f"{schema}, first long, near long")


FILTER_BITS = 24


def among(frame: DataFrame, wanted: DataFrame, then: Callable, schema: str, id: str = "id") -> DataFrame:
    """What ``then`` makes of the rows of ``frame`` whose id may be wanted, in one pass and without a shuffle of what they carry.

    Wanted ids (column ``id``) set bits of a filter of fixed size, which is broadcast. Rows that pass without being
    wanted must fall in a later join; the more ids, the more pass, up to all.
    """
    slot = F.pmod(F.xxhash64(F.col(id)), F.lit(1 << FILTER_BITS))
    seen = wanted.select(F.pmod(F.xxhash64(F.col("id")), F.lit(1 << FILTER_BITS)).alias("slot"))
    seen = seen.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in seen.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared = frame.sparkSession.sparkContext.broadcast(words)

    def passing(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            passes = (bits[at >> 6] >> (at & 63)) & 1
            out = batch.filter(pa.array(passes.astype(bool)))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], names=out.schema.names[:-1])

    return frame.withColumn("__slot", slot).mapInArrow(lambda batches: then(passing(batches)), schema)


PARITY_WORDS = 8


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits for a set: each member flips one. Two sets differ in as many members as bits, at least."""
    at = (found >> np.uint64(20)) & np.uint64(64 * PARITY_WORDS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parities(flat: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """``parity`` of every set of many that lie end to end in ``flat``, each from its place in ``ptr`` on."""
    width, out = 64 * PARITY_WORDS, []
    at = ((flat >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)
    for a in range(0, len(ptr) - 1, 4096):
        own = ptr[a : a + 4097]
        place = np.repeat(np.arange(len(own) - 1), np.diff(own)) * width + at[own[0] : own[-1]]
        odd = np.bincount(place, minlength=(len(own) - 1) * width) & 1
        out += list(np.packbits(odd.astype(np.uint8).reshape(-1, width), axis=1, bitorder="little").view(np.int64))
    return out


def _differ(x: str, y: str):
    """How many members two sets differ in, at least."""
    out = F.lit(0)
    for i in range(PARITY_WORDS):
        out = out + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return out


def _close(differ, sizes, least: int):
    """i of n and m is enough if 100 i >= least (n + m - i); then the sets differ in n + m - 2 i members at most."""
    return sizes * (100 - least) >= differ * (100 + least)


def _possible(pairs: DataFrame, parities: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and parity bits allow a link."""
    for side in ("a", "b"):
        held = parities.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
        pairs = pairs.join(held, side)
    return pairs.where(_close(_differ("a_bits", "b_bits"), F.col("a_n") + F.col("b_n"), least)).select("a", "b")


def linked_groups(rows: DataFrame, parities: DataFrame, least: int, may_link: Callable, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) for every id that a true link between rows sharing a token joins to another.

    ``rows`` comes from ``meet``; ``may_link(n, at, n, at)`` bounds a pair by its carried numbers; ``parities`` holds
    (id, n, bits) of each set, and ``least`` is the similarity in per cent; ``verify`` keeps the true links of pairs (a, b).
    Pairs that sizes and parity bits rule out are no links, so they never reach ``verify``.

    First rounds verify a few partners of each id: the two hints of its rarest token, then twice a member of the largest
    component of that token, if it is not in it. What they link is put into components. Then, for every token, the rows
    that are not in its largest component are compared with all rows of other components, if their sizes, places and
    parity bits allow a link; first one pair of any two components, then those of components still apart. Pairs inside a
    component are never formed, so a group of near copies costs a few comparisons for each member, and no link between
    components is left out.
    """
    hints = rows.groupBy("id").agg(F.expr("min_by(first, at) filter (where first is not null)").alias("p"), F.expr("min_by(near, at) filter (where near is not null)").alias("q"))
    hinted = hints.select(F.explode(F.array("p", "q")).alias("other"), "id").where("other is not null")
    done = cut(_possible(_pairs(hinted, "id", "other"), parities, least), "pairs-hinted")
    label = cut(components(cut(verify(done), "links-hinted")), "label")
    rows = rows.select("token", "id", "n", "at")
    for turn in range(2):
        mixed = _mixed(rows, label)
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "at")
        pivots = mixed.where("of = main").groupBy("token").agg(F.min(order).alias("p"))
        outer = mixed.where("of <> main").join(pivots.select("token", "p.*").toDF("token", "h", "y_id", "y_n", "y_at"), "token")
        outer = outer.where(may_link(F.col("n"), F.col("at"), F.col("y_n"), F.col("y_at"))).groupBy("id").agg(F.min_by("y_id", "at").alias("other"))
        pairs = cut(_possible(_pairs(outer, "id", "other").join(done, ["a", "b"], "left_anti"), parities, least), "pairs-pivot")
        label = _joined(label, cut(verify(pairs), "links-pivot"))
        done = done.union(pairs)
    before = F.lag("token").over(Window.partitionBy("id").orderBy("at", "token"))
    # Bits join after the shuffle by id that the window needs, so they are not shuffled with each row.
    mixed = cut(_mixed(rows, label).withColumn("before", before).join(parities.select("id", "bits"), "id"), "mixed")
    names = ("id", "n", "at", "of", "bits", "before")
    x = mixed.where("of <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in names])
    y = mixed.select("token", "main", *[F.col(c).alias(f"y_{c}") for c in names])
    differ, sizes = _differ("x_bits", "y_bits"), F.col("x_n") + F.col("y_n")
    # Rows with the same token before them meet there, as ``may_link`` is no stricter at an earlier place.
    new = F.coalesce(F.col("x_before") != F.col("y_before"), F.lit(True))
    rest = x.join(y, "token").where("x_of <> y_of and (y_of = main or x_id < y_id)").where(new)
    rest = rest.where(may_link(F.col("x_n"), F.col("x_at"), F.col("y_n"), F.col("y_at")) & _close(differ, sizes, least))
    rest = rest.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), (differ / sizes).alias("gap"))
    rest = cut(rest.groupBy("a", "b").agg(F.min("gap").alias("gap")).join(done, ["a", "b"], "left_anti"), "pairs-rest")
    # Of two components the likeliest pair is verified first; if it links them, their other pairs add nothing.
    best = _apart(rest, label).groupBy("of_a", "of_b").agg(F.min(F.struct("gap", "a", "b")).alias("p")).select("p.a", "p.b")
    best = cut(best, "pairs-best")
    label = _joined(label, cut(verify(best), "links-best"))
    left = cut(_apart(rest, label).select("a", "b").join(best, ["a", "b"], "left_anti"), "pairs-left")
    return _joined(label, cut(verify(left), "links-left"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs between different components, with the smaller component as ``of_a`` and the larger as ``of_b``."""
    named = _labelled(_labelled(pairs, label, "a", "of_x"), label, "b", "of_y").where("of_x <> of_y")
    return named.withColumns({"of_a": F.least("of_x", "of_y"), "of_b": F.greatest("of_x", "of_y")})


def _pairs(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _mixed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of tokens that are in several components, with the row's component and the token's largest."""
    of = _labelled(rows, label, "id", "of")
    sizes = of.groupBy("token", "of").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "of"))["of"].alias("main"), F.count("*").alias("k")).where("k > 1")
    return of.join(largest.select("token", "main"), "token")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links join components, not ids."""
    more = _labelled(_labelled(links, label, "a", "of_a"), label, "b", "of_b")
    more = cut(more.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), "joins")
    # An id that only these links reach is its own component so far.
    label = label.union(more.select(F.explode(F.array("a", "b")).alias("id")).select("id", F.col("id").alias("component"))).distinct()
    moved = components(more).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return cut(label.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "label")


def _labelled(frame: DataFrame, label: DataFrame, key: str, name: str) -> DataFrame:
    return (
        frame.join(label.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left")
        .withColumn(name, F.coalesce(name, key))
    )

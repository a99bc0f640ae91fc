"""Spelling variants: words one edit apart, each word's more frequent form, and the root its forms lead to.

``count_words`` counts the words of texts. ``near_words`` finds all pairs that differ by exactly one inserted, deleted or
replaced code point. Two such words are equal but for a window that holds the edit: for a pair whose shorter word has ``a``
code points, the edit lies in the first or in the second half of ``a``. Words are therefore dealt by what stands outside a
window, together with its place; words that meet share everything else, and only what stands in the window is compared. A
group of more than ``GROUP`` words is dealt again by the two halves of its window, until groups are small: a window of one code
point leaves few different words. The word's other half decides, so a prefix that a third of all words share is no hot group.

In a group the windows are sorted, and every word of length ``a`` scans the list: the rows of the banded edit matrix are kept for
each prefix, a listed word takes up where its common prefix with the one before ends, and when a row exceeds one
edit, all listed words that share that prefix are skipped. Many words scan side by side, one matrix row each at a time.

``group_variants`` names a word's form: its near word of largest count (ties: smallest in code-point order), if that count is at
least ``ratio`` times its own; and its root, the end of the chain of forms. Counts grow by ``ratio`` from form to form, so a chain of
counts below 2**63 has fewer than 64 links for any ratio of 2 or more, and doubling finds its end in 6 joins.

Inputs: null and empty texts have no words; texts are taken whole, of any length, words too. Repeated rows count again. An empty
table gives an empty result; other columns are ignored. Code points beyond the word alphabet part words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import chunks, utf8
from palimpsest.session import cut

GROUP = 20_000
#: Cells of a block's matrix of code points; a block has whole groups only.
CELLS = 1 << 21
CHUNK = 1 << 22

# A word is a run of A-Z, a-z and U+00C0 to U+00FF; in UTF-8 the latter are 0xC3 and one more byte.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LEAD = 0xC3


def find_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words lower-cased (A-Z only), end to end: bytes, offsets, code points of each, and the number of its text."""
    data, offsets = utf8(texts)
    low = _LOWER[data]
    lead = low == _LEAD
    inside = _ASCII[low] | lead
    inside[1:] |= lead[:-1]  # the byte after a lead byte is always there
    before = np.zeros(len(low) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    sizes = np.cumsum(inside)
    at = np.concatenate([sizes[starts] - 1, sizes[-1:]]) if len(starts) else np.zeros(1, np.int64)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    kept = low[inside]
    tails = np.concatenate([[0], np.cumsum((kept & 0xC0) == 0x80)])
    points = np.diff(at) - np.diff(tails[at])
    return kept, at.astype(np.int64), points, text_of


def count_words(texts: DataFrame, column: str = "text", *, least: int = 1, change: Callable[[pa.RecordBatch, pa.Array, np.ndarray], pa.Array] | None = None, keep: list[str] = ()) -> DataFrame:
    """(word, n): how often each word of at least ``least`` code points occurs in all texts.

    ``change`` may give other words in place of those found: it gets the batch of ``keep`` columns, the words, and each word's row.
    """

    def run(batches):
        for batch in chunks(batches, "__text", CHUNK):
            data, at, points, row = find_words(batch.column(batch.num_columns - 1))
            use = points >= least
            size = np.diff(at)[use]
            bytes_ = np.repeat(use, np.diff(at))
            ends = np.concatenate([[0], np.cumsum(size)])
            words = pa.Array.from_buffers(pa.large_string(), int(use.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[bytes_])])
            if change is not None:
                words = change(batch, words, row[use])
                words = words.filter(pc.greater_equal(pc.utf8_length(words), least))
            counted = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1).cast(pa.int64())], names=["word", "n"])

    rows = texts.select(*[F.col(f"`{k}`") for k in keep], F.col(column).cast("string").alias("__text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def crc32_words(prefixes: list[bytes], words: pa.Array, row: np.ndarray) -> np.ndarray:
    """crc32 of each word's UTF-8 after its row's prefix; all words a byte further at a time."""
    import zlib

    # zlib's state is the finished value; taking the last step back gives the register.
    state = (np.array([zlib.crc32(p) for p in prefixes], np.uint32) ^ np.uint32(0xFFFFFFFF))[row]
    ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    table = _crc_table()
    order = np.argsort(-np.diff(ends), kind="stable")
    at, left = ends[:-1][order], np.diff(ends)[order]
    state = state[order]
    n = len(order)
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left[:n], -j, side="left"))  # words with a byte j
        s = state[:n]
        state[:n] = table[(s ^ data[at[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


def drop_letters(id: str, every: int = 31) -> Callable:
    """A change for ``count_words``: where ``every`` divides the crc32 h of "<id>:<word>", code point h % length goes."""

    def change(batch: pa.RecordBatch, words: pa.Array, row: np.ndarray) -> pa.Array:
        ids = pc.fill_null(batch.column(batch.schema.get_field_index(id)).cast(pa.string()), "").to_pylist()
        h = crc32_words([f"{i}:".encode() for i in ids], words, row)
        hit = np.flatnonzero(h % every == 0)
        new = [w[: (k := int(c) % len(w))] + w[k + 1 :] for w, c in zip(words.take(pa.array(hit)).to_pylist(), h[hit], strict=True)]
        mask = np.zeros(len(words), bool)
        mask[hit] = True
        return pc.replace_with_mask(words, pa.array(mask), pa.array(new, pa.large_string()))

    return change


# Pairs


def _windows(words: DataFrame) -> DataFrame:
    """Each word as the shorter or equal of a pair (a: its length) and as the longer (a: one less), by both halves of a."""
    size = F.char_length("word")
    roles = F.explode(F.array(size, size - 1)).alias("a")
    rows = words.select("word", "n", roles).where("a > 0")
    half = F.expr("cast(a div 2 as int)")
    spans = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("a").alias("e")))
    return rows.select("word", "n", "a", F.explode(spans).alias("w")).where("w.s < w.e").select("word", "n", "a", "w.s", "w.e")


def _keyed(rows: DataFrame) -> DataFrame:
    """What stands outside the window, and what stands in it."""
    size = F.char_length("word")
    tail = F.col("a") - F.col("e")
    return rows.select("a", "s", "e", _rest().alias("rest"), F.substring("word", F.col("s") + 1, size - tail - F.col("s")).alias("inner"), "n")


def _split(rows: DataFrame, group: int) -> DataFrame:
    """Rows (word, n, a, s, e) with windows halved until no group is larger than ``group`` or its window is one code point."""
    done = []
    while True:
        key = F.xxhash64("a", "s", "e", _rest())
        sizes = rows.where("e - s > 1").groupBy(key.alias("__k")).agg(F.count("*").alias("__c")).where(F.col("__c") > group).select("__k")
        sizes = cut(sizes, "large")
        if sizes.isEmpty():
            break
        marked = cut(rows.withColumn("__k", key), "windows")
        done.append(marked.join(sizes, "__k", "left_anti").drop("__k"))
        middle = F.expr("cast((s + e) div 2 as int)")
        halves = F.explode(F.array(F.struct(F.col("s").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("e").alias("e"))))
        rows = marked.join(sizes, "__k", "left_semi").select("word", "n", "a", halves.alias("w")).select("word", "n", "a", "w.s", "w.e")
    for some in done:
        rows = rows.unionByName(some)
    return rows


def _rest():
    tail = F.col("a") - F.col("e")
    return F.concat(F.substring("word", F.lit(1), F.col("s")), F.substring("word", F.char_length("word") - tail + 1, tail))


def scan(points: np.ndarray, sizes: np.ndarray, group: np.ndarray, width: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, listed) exactly one edit apart, queries of ``width`` code points, within each group.

    ``points``: code points of sorted windows, one row each, of ``width`` or ``width`` + 1; ``group``: group numbers, in order.
    ``last``: whether an edit at the very end counts here (it belongs to the following window otherwise).
    """
    n = len(sizes)
    first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    end = np.repeat(np.concatenate([first[1:], [n]]), np.diff(np.concatenate([first, [n]])))
    begin = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    same = np.zeros((n, width + 1), bool)
    same[1:] = (points[1:] == points[:-1]) & (points[1:] >= 0)
    common = np.logical_and.accumulate(same, axis=1).sum(1).astype(np.int32)
    common[first] = -1
    # after[d][i]: the next place behind i whose common prefix with its predecessor is shorter than d.
    after = np.full((width + 2, n + 1), n, np.int32)
    places = np.arange(n, dtype=np.int32)
    for d in range(width + 2):
        stop = np.where(common < d, places, n)
        after[d, :n] = np.minimum.accumulate(np.concatenate([stop[1:], [n]])[::-1])[::-1]
    query = np.flatnonzero((sizes == width) & (end - begin > 1))
    q = np.arange(len(query))
    text = np.full((len(query), width + 3), -2, np.int32)  # one place before, two behind
    text[:, 1 : width + 1] = points[query, :width]
    rows = np.full((len(query), width + 2, 3), 2, np.uint8)
    rows[:, 0] = (2, 0, 1)
    at, depth, stop = begin[query].astype(np.int32), np.zeros(len(query), np.int32), end[query]
    pairs = []
    one = np.uint8(1)
    while len(q):
        char = points[at, depth]
        before = rows[q, depth]
        b0 = np.minimum(before[:, 0] + (text[q, depth] != char), before[:, 1] + one)
        b1 = np.minimum(np.minimum(before[:, 1] + (text[q, depth + 1] != char), before[:, 2] + one), b0 + one)
        b2 = np.minimum(before[:, 2] + (text[q, depth + 2] != char), b1 + one)
        now = np.minimum(np.stack([b0, b1, b2], 1), 2).astype(np.uint8)
        depth = depth + 1
        rows[q, depth] = now
        over = now.min(1) > 1
        ended = ~over & (depth == sizes[at])
        distance = np.where(depth == width, now[:, 1], now[:, 0])
        hit = ended & (distance == 1)
        if hit.any():
            pairs.append((query[q[hit]], at[hit]))
        move = over | ended
        to = np.where(over, after[depth, at], at + 1)
        at = np.where(move, to, at)
        alive = at < stop
        q, at, stop = q[alive], at[alive], stop[alive]
        depth = np.where(move[alive], np.maximum(common[np.minimum(at, n - 1)], 0), depth[alive])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not last:  # a window that is all of the other's beginning: the edit stands at the end
        wide = sizes[b] > width
        inside = (points[a, :width] != points[b, :width]).any(1)
        keep = ~wide | inside
        a, b = a[keep], b[keep]
    return a, b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches joined and cut where a group ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows * (1 + pc.max(pc.utf8_length(batch.column(4))).as_py())
        if size >= CELLS:
            table = pa.Table.from_batches(held).combine_chunks()
            fresh = np.flatnonzero(_changes(table))
            if len(fresh):
                yield table.slice(0, int(fresh[-1]))
                rest = table.slice(int(fresh[-1]))
                held, size = rest.to_batches(), rest.num_rows * (1 + pc.max(pc.utf8_length(rest.column(4))).as_py())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's (a, s, e, rest) is not its predecessor's; never at the first."""
    out = np.zeros(table.num_rows, bool)
    if table.num_rows > 1:
        for c in range(4):
            column = table.column(c)
            out[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _pairs(batches):
    for table in _blocks(batches):
        group = np.cumsum(_changes(table))
        counts = np.bincount(group)
        table = table.filter(pa.array(counts[group] > 1))
        if not table.num_rows:
            continue
        group = group[counts[group] > 1]
        a, s, e, n = (table.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2, 5))
        parts = np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 0) | (np.diff(e) != 0)) + 1
        for lo, hi in zip([0, *parts], [*parts, len(a)], strict=True):
            width = int(e[lo] - s[lo])
            inner = table.column(4).slice(lo, hi - lo).combine_chunks()
            sizes = pc.utf8_length(inner).to_numpy().astype(np.int32)
            flat = np.frombuffer("".join(inner.to_pylist()).encode("utf-32-le"), np.int32)
            points = np.full((hi - lo, width + 1), -1, np.int32)
            points[np.arange(width + 1)[None, :] < sizes[:, None]] = flat
            x, y = scan(points, sizes, group[lo:hi], width, bool(e[lo] == a[lo]))
            if not len(x):
                continue
            rest, cut_at = table.column(3).slice(lo, hi - lo), int(s[lo])
            head, tail = (pc.utf8_slice_codeunits(rest, i, j) for i, j in ((0, cut_at), (cut_at, None)))
            word = pc.binary_join_element_wise(head, inner, tail, "")
            count = pa.array(n[lo:hi])
            # Words of unequal length meet in one direction only.
            back = sizes[y] > width
            left, right = np.concatenate([x, y[back]]), np.concatenate([y, x[back]])
            left, right = pa.array(left), pa.array(right)
            word = word.combine_chunks() if isinstance(word, pa.ChunkedArray) else word
            yield pa.RecordBatch.from_arrays(
                [word.take(left), word.take(right), count.take(right)], names=["word", "near", "near_n"]
            )


def near_words(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """(word, near, near_n) for distinct ``words`` (word, n): each ordered pair exactly one edit apart, once."""
    rows = _split(_windows(words.select("word", "n")), group)
    keys = ["a", "s", "e", "rest"]
    dealt = _keyed(rows).repartition(*keys).sortWithinPartitions(*keys, "inner")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long")


# Forms


def group_variants(words: DataFrame, *, ratio: int = 10, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct ``words`` (word, n)."""
    words = cut(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))  # a word has few near words: its edits are bounded
    near = near_words(words, group=group).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    found = words.join(near, "word", "left")
    enough = -F.col("b.m") >= ratio * F.col("n")
    found = cut(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n"),
    ), "forms")
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        doubled = links.join(further, "root", "left")
        if doubled.where("__next is not null").isEmpty():
            break
        links = cut(doubled.select("word", F.coalesce("__next", "root").alias("root")), "roots")
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

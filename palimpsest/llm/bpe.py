"""Byte-level BPE: texts to token ids and back.

Pre-tokenisation runs without a regular expression. Each code point has a class; a small automaton
over classes says, for each state, whether a piece begins here. An automaton step is a function
from state to state, and functions compose: the few that can arise are numbered, their products
tabulated, and the composition over a text is scanned in blocks of array lookups. Pieces are then
merged by rank, with a bounded cache of pieces seen before.

Inputs: null and empty texts give no ids. Texts of any length are taken whole; equal rows stay
rows of their own; an empty table gives an empty result; columns not named are left out of the result,
except those in ``keep``. Ids, offsets and decoded bytes are binary columns.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.llm.text import chunks

LETTER, ONE, TWO, NUMBER, OTHER, QUOTE, SPACES, GAP, LAST = range(9)
SYMBOLS = 9
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_GAP, AFTER_QUOTE, HALF = range(8)
STATES = 8

# Code points that count as white space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that an apostrophe takes along, of one letter and of two.
ENDINGS_ONE = "stmd"
ENDINGS_TWO = ["re", "ve", "ll"]

CACHE_ENTRIES = 250_000
SHORT = 128
NONE = 1 << 60
CACHE_PIECE = 64
BLOCK = 64
CHUNK = 1 << 19


def code_classes() -> np.ndarray:
    """For each code point: letter, number, white space (SPACES) or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[WHITE] = SPACES
    out[ord("'")] = QUOTE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this symbol."""
    letter = symbol in (LETTER, ONE, TWO)
    if state == HALF:
        return FRESH, False
    if state == AFTER_QUOTE and symbol in (ONE, TWO):
        return (FRESH if symbol == ONE else HALF), False
    joins = {
        IN_LETTERS: letter, IN_NUMBERS: symbol == NUMBER, IN_OTHERS: symbol in (OTHER, QUOTE), IN_SPACES: symbol == SPACES,
        AFTER_GAP: symbol not in (SPACES, GAP, LAST), AFTER_QUOTE: symbol in (OTHER, QUOTE),
    }.get(state, False)
    if letter:
        return IN_LETTERS, not joins
    if symbol == QUOTE and not joins:
        return AFTER_QUOTE, True
    after = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS, SPACES: IN_SPACES, GAP: AFTER_GAP, LAST: FRESH}
    return after[symbol], not joins


@lru_cache(1)
def automaton():
    """The step functions (also those that begin a text), numbered with all their products.

    Returns each symbol's number, the table of products, each function's image of each state, and
    where a piece begins, by state and symbol.
    """
    begins = np.zeros((STATES, 2 * SYMBOLS), bool)
    steps = []
    for symbol in range(2 * SYMBOLS):
        moved = [_step(s if symbol < SYMBOLS else FRESH, symbol % SYMBOLS) for s in range(STATES)]
        begins[:, symbol] = [b for _, b in moved]
        steps.append(tuple(s for s, _ in moved))
    numbers: dict[tuple, int] = {}
    for f in [tuple(range(STATES)), *steps]:
        numbers.setdefault(f, len(numbers))
    known = list(numbers)
    for f in known:  # grows while it is read
        for g in steps:
            h = tuple(g[s] for s in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                known.append(h)
    images = np.array(known, np.uint8)
    n = len(known)
    products = np.zeros((n, n), np.uint16)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            products[i, j] = numbers[tuple(g[s] for s in f)]
    return np.array([numbers[f] for f in steps], np.uint16), products.ravel(), images, begins, n


def scan(elements: np.ndarray) -> np.ndarray:
    """Running products of functions: blocks side by side, then the blocks' totals, then both together."""
    _, products, _, _, n = automaton()
    size = len(elements)
    if size <= BLOCK:
        out, acc = np.empty(size, np.uint16), 0
        for i, e in enumerate(elements.tolist()):
            acc = int(products[acc * n + e])
            out[i] = acc
        return out
    blocks = -(-size // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint16)
    grid[:size] = elements
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    acc = grid[0].astype(np.intp)
    for j in range(1, BLOCK):
        acc = products[acc * n + grid[j]].astype(np.intp)
        grid[j] = acc
    before = np.zeros(blocks, np.intp)
    before[1:] = scan(grid[-1])[:-1]
    grid = products[before[None, :] * n + grid]
    return np.ascontiguousarray(grid.T).ravel()[:size]


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, over texts set end to end; ``first``: where (non-empty) texts begin."""
    symbols = classes[points]
    head = np.zeros(len(points) + 1, bool)
    head[first] = True
    head[-1] = True
    white = symbols == SPACES
    last = white.copy()  # the last of a run, with something of the same text after it
    last[:-1] &= ~white[1:]
    last &= ~head[1:]
    symbols[last] = LAST
    symbols[last & (points == 32)] = GAP
    after = np.zeros_like(points)
    after[:-1] = points[1:]
    after[head[1:]] = 0
    for pair in ENDINGS_TWO:
        symbols[(points == ord(pair[0])) & (after == ord(pair[1]))] = TWO
    for one in ENDINGS_ONE:
        symbols[points == ord(one)] = ONE
    symbols[head[:-1]] += SYMBOLS
    numbers, _, images, begins, _ = automaton()
    ran = scan(numbers[symbols])
    state = np.zeros(len(points), np.uint8)
    state[1:] = images[ran[:-1], FRESH]
    return np.flatnonzero(begins[state, symbols])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join neighbours by the lowest rank, leftmost first, until none can be joined."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= SHORT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Few parts: the lowest pair is found by looking at all of them."""
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == NONE:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Many parts: pairs wait in a queue by rank, and neighbours are linked."""
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or right[i] >= n or end[right[i]] != stop:
            continue
        gone = right[i]
        live[gone] = False
        end[i], right[i] = stop, right[gone]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Pieces(dict):
    """Piece to packed ids, filled as pieces are met and emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(1)
def pieces_of(key: str) -> Pieces:
    """The cache of a worker process; it outlives a task and goes when another vocabulary comes."""
    return Pieces({})


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line. Read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """A rank file, shared with the workers once per operator call."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.shared = spark.sparkContext.broadcast((ranks, [t for t, _ in tokens], [i for _, i in tokens]))
        self.key = uuid.uuid4().hex
        self.classes = spark.sparkContext.broadcast(code_classes())


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns with ``ids`` (little-endian 32-bit) and ``ends`` (each token's end, in bytes of the text)."""
    shared, classes, key = vocabulary.shared, vocabulary.classes, vocabulary.key
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])

    def run(batches):
        ranks, tokens, ids_of = shared.value
        lengths = np.zeros(max(ids_of, default=0) + 1, np.int64)
        lengths[ids_of] = [len(t) for t in tokens]
        cache = pieces_of(key)
        cache.ranks = ranks
        for batch in chunks(batches, "__text", CHUNK):
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            ids = _encode(texts, classes.value, cache)
            ends = [np.cumsum(lengths[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names=schema.names
            )

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def _encode(texts: list[str], classes: np.ndarray, cache: Pieces) -> list[bytes]:
    sizes = np.array([len(x) for x in texts], np.int64)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    if not bounds[-1]:
        return [b""] * len(texts)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = piece_starts(points, bounds[:-1][sizes > 0], classes)
    cuts = [*starts.tolist(), len(joined)]
    ids = list(map(cache.__getitem__, [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
    at = np.searchsorted(starts, bounds).tolist()
    return [b"".join(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``decoded``: the bytes of each token laid at the offsets kept in ``ends``."""
    shared = vocabulary.shared
    kept = encoded.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        _, tokens, ids_of = shared.value
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        lengths, where = np.zeros(max(ids_of, default=0) + 1, np.int64), np.zeros(max(ids_of, default=0) + 1, np.int64)
        lengths[ids_of] = [len(t) for t in tokens]
        where[ids_of] = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
        for batch in batches:
            out = []
            for ids, ends in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                ids, ends = np.frombuffer(ids.as_buffer() or b"", "<u4"), np.frombuffer(ends.as_buffer() or b"", "<u4").astype(np.int64)
                size = lengths[ids]
                shift = np.repeat(where[ids] - (ends - size), size)
                out.append(flat[shift + np.arange(len(shift))].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(*keep, encoded["ids"].alias("__ids"), encoded["ends"].alias("__ends")).mapInArrow(run, schema)

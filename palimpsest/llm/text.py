"""Text columns as byte arrays: words, word hashes and shingles, without a Python object per word.

Arrow hands a batch of texts over as one UTF-8 buffer with offsets. The functions here work on
that buffer. A word's hash is a polynomial over its bytes, read off one running sum for all words
of a segment; a run of words is hashed the same way over word hashes. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from palimpsest.session import tune

#: Just under a power of two, as tables of powers, which a worker keeps, are as long as the next one.
CHUNK_BYTES = 250_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xD6E8FEB86659FD93)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: Arrow batches of a few megabytes, so that a worker holds few long texts at once."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range, one to one."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix(np.arange(256, dtype=_U) + _U(0x1234567))
_VALUES[0] = 0


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(12, n - 1).bit_length() if n > 4096 else 4096
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def alphabet(separators: Iterable[int]) -> np.ndarray:
    """A table from byte to lower-cased byte; separators become 0. UTF-8 tails are word bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words between ASCII blanks, and words of ASCII letters, digits and all beyond ASCII.
BLANKS = alphabet([0x20, *range(0x09, 0x0E)])
ALNUM = alphabet([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# A capital letter stands between 0x3A and 0x60 but is lower-cased first.
ALNUM[65:91] = np.arange(97, 123)
# NUL is a word byte between blanks; any nonzero value that no other byte has would do, 0x41 is free.
BLANKS[0] = 0x41


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a chunk holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """All words of some texts: byte ``starts`` and ``ends``, ``hashes``, and ``ptr``, the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        parts = [_segment(data, a, b, offsets, table) for a, b in _segments(data, offsets, table)]
        if parts:
            self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, _U)
        self.data, self.table = data, table
        self.ptr = np.searchsorted(self.starts, offsets)
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; runs may cross from text to text."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, _U)
        return self.run(np.arange(n), length)

    def run(self, first: np.ndarray, length) -> np.ndarray:
        up, down = _WORDS(len(self) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self) + 1, _U)
            np.cumsum(self.hashes * up[: len(self)], out=self._sums[1:])
        return mix((self._sums[first + length] - self._sums[first]) * down[first] + np.asarray(length).astype(_U))

    def text(self, first: int, length: int) -> bytes:
        """Words lower-cased, joined by a blank."""
        return b" ".join(self.table[self.data[self.starts[i] : self.ends[i]]].tobytes() for i in range(first, first + length))


def _segments(data, offsets, table):
    """Cuts of the data where no word is cut."""
    at, n = 0, len(data)
    while at < n:
        to = at + CHUNK_BYTES
        while to < n and table[data[to]]:
            more = np.flatnonzero(table[data[to : to + 65536]] == 0)
            ahead = int(offsets[np.searchsorted(offsets, to)])
            to = min(to + (int(more[0]) if len(more) else 65536), max(ahead, to))
            if ahead == to:
                break
        yield at, min(to, n)
        at = to


def _segment(data, a, b, offsets, table):
    low = table[data[a:b]]
    inside = low != 0
    breaks = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
    before = np.zeros(len(low) + 1, bool)
    before[1:] = inside
    after = before.copy()
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[:-1] = inside
    after[-1] = False
    after[breaks] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    up, down = _BYTES(len(low) + 1)
    sums = np.zeros(len(low) + 1, _U)
    np.cumsum(_VALUES[low] * up[: len(low)], out=sums[1:])
    return starts + a, ends + a, mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words is one shingle, of none has none."""
    whole = words.runs(size)
    out = []
    for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(words.run(np.array([a]), b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def pack(lists: list[np.ndarray], kind) -> pa.ListArray:
    """Arrays as an Arrow list column."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))

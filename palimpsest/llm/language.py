"""Language identification with string kernels.

A text's blended spectrum is the set of its byte 1- to 4-grams (letters of ASCII lower-cased), hashed to
``BINS`` places. The kernel of two texts is the number of shared places over the root of the product of
their counts. Landmark texts span the feature space by Nyström's method; one ridge regression for each
language against the rest is solved in it, and scores are matrix products over batches of texts.

A long text would fill all places, so a text of more than ``SEGMENT`` bytes is cut into pieces of equal length, each scored by
itself; the text's margin is the mean of all its pieces'. Every n-gram falls in one piece, also where it crosses a cut.

Fitting takes at most ``PER_LANGUAGE`` texts of each language, chosen by a hash of the id; only presence bits
reach the driver, so the size is bounded by that parameter and the number of languages. Of a
longer text, one piece stands for it in the fit. Scoring covers every row, and every piece.

Inputs: null texts and texts without a letter are ``und`` with score 0. A text of any length is taken
whole. Without labelled rows, all is ``und``. Equal rows give equal results; ties go to the language that
sorts first. Columns other than those named are ignored; those in ``keep`` come back as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.sampling import balanced, has_letter
from palimpsest.llm.text import chunks, mix, utf8

BINS = 4096
SEGMENT = 8192
PER_LANGUAGE = 1000
LANDMARKS = 160
RIDGE = 0.05
BLOCK = 256
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """Pieces of some texts: the text row ``of`` each, its first byte in ``starts``, and the end of its text in ``stops``."""

    def __init__(self, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.per = np.maximum(-(-sizes // SEGMENT), 1)
        self.first = np.cumsum(self.per) - self.per
        self.of = np.repeat(np.arange(len(sizes)), self.per)
        turn = np.arange(len(self.of)) - self.first[self.of]
        self.starts = np.append(offsets[:-1][self.of] + sizes[self.of] * turn // self.per[self.of], offsets[-1])
        self.stops = offsets[1:][self.of]

    def spectrum(self, data: np.ndarray, a: int, b: int) -> np.ndarray:
        """The presence matrix of pieces ``a`` to ``b``; an n-gram belongs to the piece that it begins in."""
        low, high = self.starts[a], min(self.starts[b] + 3, len(data))
        return spectrum(data[low:high], self.starts[a : b + 1] - low, np.minimum(self.stops[a:b], high) - low)


def spectrum(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Presence of each hashed n-gram in each text, as a matrix of 0 and 1; n-grams begin in a text and do not pass its end."""
    n = len(offsets) - 1
    out = np.zeros(n * BINS, np.float32)
    if len(data):
        row = np.repeat(np.arange(n, dtype=np.int64) * BINS, np.diff(offsets))
        low = _LOWER[data].astype(np.uint32)
        last = np.repeat(offsets[1:] if ends is None else ends, np.diff(offsets))
        grams = low.copy()
        for size in (1, 2, 3, 4):
            if size > 1:
                grams = (grams[:-1] << np.uint32(8)) | low[size - 1 :]
            own = grams[: len(row)]
            fits = np.arange(len(own)) + size <= last[: len(own)]
            place = ((own * np.uint32(2654435761) + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
            out[(row[: len(own)] + place)[fits]] = 1
    return out.reshape(n, BINS)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams over the root of the product of counts; 0 for texts without any."""
    na, nb = np.maximum(a.sum(1), 1), np.maximum(b.sum(1), 1)
    return (a @ b.T) / np.sqrt(na[:, None] * nb[None, :])


def fit(bits: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, landmark rows, and weights so that ``kernel(x, landmarks) @ weights`` scores each language."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    turn = np.empty(len(y), np.int64)
    for k in range(len(names)):  # landmarks from each language in turn
        turn[y == k] = np.arange((y == k).sum())
    marks = bits[np.lexsort((y, turn))[:LANDMARKS]]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel(bits, marks) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    weight *= len(y) / weight.sum()
    gram = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    beta = np.linalg.solve(gram, (z * weight[:, None]).T @ target)
    return names, marks, np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)


def text_margins(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each text's mean margin over its pieces, for each language."""
    pieces = Pieces(offsets)
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for a in range(0, len(pieces.of), BLOCK):
        b = min(a + BLOCK, len(pieces.of))
        np.add.at(out, pieces.of[a:b], kernel(pieces.spectrum(data, a, b), marks) @ weights[:-1] + weights[-1])
    return out / pieces.per[:, None]


def identify(
    docs: DataFrame, training: DataFrame, *, text: str = "text", keep: list[str], key: str = "doc_id", label: str = "lang"
) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (0 to 1), learned from the rows of ``training``."""
    spark = docs.sparkSession
    rows = training.where(F.col(label).isNotNull() & has_letter(F.col(text)))
    chosen = balanced(rows.select(key, label).distinct(), label, PER_LANGUAGE, key).select(
        F.col(key).alias("__key"), F.col(label).alias("__label")
    )
    sample = rows.join(
        F.broadcast(chosen), rows[key].eqNullSafe(chosen["__key"]) & (rows[label] == chosen["__label"]), "left_semi"
    ).select(F.col(text).alias("__text"), F.col(label).alias("__label"))

    def features(batches):
        for batch in chunks(batches, "__text"):
            data, offsets = utf8(batch.column(0))
            pieces = Pieces(offsets)
            one = pieces.first + (mix(np.diff(offsets)) % pieces.per.astype(np.uint64)).astype(np.int64)
            bits = np.vstack([np.packbits(pieces.spectrum(data, i, i + 1).astype(bool), axis=1) for i in one.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bits], pa.binary()), batch.column(1)], names=["bits", "label"])

    found = sample.mapInArrow(features, "bits binary, label string").collect()
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if not found:
        return kept.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found.sort(key=lambda r: (r["label"], bytes(r["bits"])))  # arrival order must not matter
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1), axis=1)
    order = np.argsort(mix(np.arange(len(found))), kind="stable")
    shared = spark.sparkContext.broadcast(fit(bits.astype(np.float32)[order], [found[i]["label"] for i in order]))

    def score(batches):
        names, marks, weights = shared.value
        for batch in chunks(batches, "__text"):
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            margins = text_margins(*utf8(batch.column(batch.num_columns - 2)), marks, weights)
            best = margins.argmax(1)
            odds = np.exp(4 * (margins - margins.max(1, keepdims=True)))
            sure = np.where(lettered, 1 / odds.sum(1), 0.0)
            said = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text"), has_letter(docs[text]).alias("__lettered")).mapInArrow(score, schema)

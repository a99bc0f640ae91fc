"""Quality by the vote of nearest labelled texts in a latent semantic space.

Terms are hashed byte trigrams, and forms of words (equal to the one before, ending in a sign, with a
capital). Trigrams' document frequencies are counted over all texts. A bounded sample of labelled texts gives
the latent space by a singular value decomposition of log counts weighted by rarity, and its vectors are broadcast
(``SAMPLE`` rows of ``RANK`` numbers). Every text is folded into the space, its exact cosine to every labelled
vector computed in blocks, and its ``NEIGHBOURS`` nearest vote, weighted by a power of the cosine, and by how many
labelled rows a sampled one of its label stands for, so that scores do not depend on which label was sampled.

Inputs: null and empty texts get the share of label 1 among the labelled rows; so does any text with no term.
Without labelled rows the score is 0.5. Texts are taken whole; equal rows score alike; columns not in ``keep``
are ignored, and ``keep`` may hold any name but those of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.sampling import balanced
from palimpsest.llm.text import BLANKS, Words, chunks, utf8

TERMS = 2048
FORMS = 8
PER_LABEL = 2000
RANK = 48
NEIGHBOURS = 15
POWER = 4
BLOCK = 4096
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(48, 58), *range(65, 91), *range(97, 123), ord("."), ord(",")]] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Occurrences of each hashed trigram in each text, and of each form among its words."""
    n = len(offsets) - 1
    out = np.zeros(n * TERMS, np.float32)
    if not len(data) or not n:
        return np.zeros((n, TERMS + FORMS), np.float32)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64) * TERMS, sizes)
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    fits = np.arange(len(grams)) + 3 <= np.repeat(offsets[1:], sizes)[: len(grams)]
    place = ((grams * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    out += np.bincount((row[: len(grams)] + place)[fits], minlength=n * TERMS)
    words = Words(data, offsets, BLANKS)
    of = np.repeat(np.arange(n, dtype=np.int64) * TERMS, np.diff(words.ptr))
    again = np.zeros(len(words), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.ptr[:-1][words.ptr[:-1] < len(words)]] = False
    first, last = data[words.starts], data[words.ends - 1]
    sign = (last < 128) & ~_PLAIN_END[last]
    capital = (first >= 65) & (first <= 90)
    form = again.astype(np.int64) | (sign.astype(np.int64) << 1) | (capital.astype(np.int64) << 2)
    marks = np.bincount(of // TERMS * FORMS + form, minlength=n * FORMS).reshape(n, FORMS)
    return np.hstack([out.reshape(n, TERMS), marks.astype(np.float32)])


def weigh(found: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Log counts by rarity beside the roots of the shares of forms; either half has length 1, or 0 if nothing is there."""
    terms = np.log1p(found[:, :TERMS]) * rarity
    forms = np.sqrt(found[:, TERMS:] / np.maximum(found[:, TERMS:].sum(1, keepdims=True), 1))
    return np.hstack([terms / np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-12), forms])


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each term occurs, over all texts; each task sends one row for each term it met."""

    def run(batches):
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in chunks(batches, "__text"):
            found = counts(*utf8(batch.column(0)))
            seen += (found[:, :TERMS] > 0).sum(0)
            n += len(found)
        if n:
            places = np.append(np.flatnonzero(seen), TERMS)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(np.append(seen, n)[places], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col(text).alias("__text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def classify(
    docs: DataFrame, labelled: DataFrame, *, text: str = "text", keep: list[str], key: str = "doc_id", label: str = "label"
) -> DataFrame:
    """``keep`` columns with ``score``, learned from ``labelled`` (key, label 0 or 1), whose texts are in ``docs``."""
    spark = docs.sparkSession
    known = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).distinct()
    chosen = balanced(known, "__label", PER_LABEL, "__key")
    # Bounded by PER_LABEL rows for each of two labels.
    sample = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key").select("__text", "__label")

    def features(batches):
        for batch in chunks(batches, "__text"):
            logs = counts(*utf8(batch.column(0))).astype(np.float32)
            logs = np.minimum(np.log1p(logs) * 16, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in logs], pa.binary()), batch.column(1)], names=["logs", "label"])

    found = sample.mapInArrow(features, "logs binary, label int").collect()
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    if not found:
        return kept.select("*", F.lit(0.5).alias("score"))
    found.sort(key=lambda r: (r["label"], bytes(r["logs"])))  # arrival order must not matter
    rows = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    prior = rows.get(1, 0) / sum(rows.values())
    seen, n = document_frequencies(docs, text)
    rarity = np.log((1 + n) / (1 + seen)) + 0.1
    logs = np.frombuffer(b"".join(bytes(r["logs"]) for r in found), np.uint8).reshape(len(found), TERMS + FORMS).astype(np.float64) / 16
    labels = np.array([r["label"] for r in found], np.float64)
    x = weigh(np.expm1(logs), rarity)
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :RANK]
    basis = basis * np.where(np.abs(basis).max(0) == basis.max(0), 1, -1)
    latent = x @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    stands_for = np.array([rows[int(x)] for x in labels]) / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum())
    shared = spark.sparkContext.broadcast((rarity, basis, latent, labels, stands_for))

    def score(batches):
        rarity, basis, latent, labels, stands_for = shared.value
        k = min(NEIGHBOURS, len(labels))
        for batch in chunks(batches, "__text"):
            found = weigh(counts(*utf8(batch.column(batch.num_columns - 1))), rarity) @ basis
            norms = np.linalg.norm(found, axis=1, keepdims=True)
            found /= np.maximum(norms, 1e-12)
            best = np.full((len(found), 0), 0.0)
            voters = np.full((len(found), 0), 0)
            for a in range(0, len(labels), BLOCK):
                near = np.hstack([best, found @ latent[a : a + BLOCK].T])
                who = np.hstack([voters, np.broadcast_to(np.arange(a, min(a + BLOCK, len(labels))), (len(found), min(BLOCK, len(labels) - a)))])
                top = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
                best, voters = np.take_along_axis(near, top, 1), np.take_along_axis(who, top, 1)
            weights = np.maximum(best, 0) ** POWER * stands_for[voters]
            total = weights.sum(1)
            scores = np.where((norms[:, 0] > 0) & (total > 0), (weights * labels[voters]).sum(1) / np.maximum(total, 1e-300), prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(score, schema)

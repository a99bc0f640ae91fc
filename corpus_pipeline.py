"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, encoding.

Each stage reads what the one before it wrote. A stage takes (spark, docs, sf_dir); all but the last return
the columns of ``documents``. Null and empty texts have no letter and go in the first stage.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.llm import bpe, decontaminate, jaccard, language, pii  # noqa: E402
from palimpsest.llm.text import prepare  # noqa: E402
from palimpsest.session import checkpoint_dir  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go; the language found is the language."""
    prepare(spark)
    found = language.identify(docs, docs, keep=COLUMNS)
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach, the document with the smallest id stays. Rows without an id are in no group and stay."""
    prepare(spark)
    gone = jaccard.similar_documents(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(docs, benchmark, keep=COLUMNS)
    return found.where(F.size("hits") == 0).select(COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; the length is that of the new text."""
    prepare(spark)
    return pii.mask(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with each token's end, both packed as 32-bit numbers."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary(prepare(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, vocabulary, keep=["doc_id", "lang", "source"])
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language", identify_language), ("near_copies", drop_near_copies), ("benchmark", drop_contaminated), ("personal", mask_personal), ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

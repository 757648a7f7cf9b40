"""From raw documents to token ids, stage by stage; each stage is written and read again.

1. quality rules: documents that repeat themselves too much, or have next to no words, go;
2. n-gram Jaccard join: one document of each group of near duplicates (80 percent of five-word shingles) stays;
3. secret scans: secrets are masked, all documents stay;
4. mixing: sources are drawn at target weights, a document as often as its source asks for it;
5. byte-pair encoding: ids and decoded text as digests.

Every stage works on all rows of its predecessor. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import bpe, mixing, repetition, secrets, shingle_join
from tallymark.llm.tables import read
from tallymark.session import new_folder

#: Near duplicates of the stage. The query op4_jaccard has a rule of its own, four words and 85 percent.
NEAR = shingle_join.Join(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs, NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("byte-pair encoding", encoded),
]

#: No SQL: suffix arrays, similarity joins and byte pairs are beyond it; see the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps goes through the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

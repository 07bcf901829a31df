"""From raw documents to packed training sequences, in five stages over the same columns.

Each stage takes what the stage before it kept, as Parquet, and returns a
DataFrame; all but the last return the columns of ``documents``. Sources,
languages and groups of copies of any size go through the same steps.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from transitlab.llm import langid, packing, quality, simhash, substring
from transitlab.llm.common import table
from transitlab.llm.queries import BYTE_BPE, PIECES, RANKS
from transitlab.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the model; those in none, or in doubt, go."""
    return langid.keep_identified(docs)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language."""
    return quality.keep_good(docs, public_tokenizers.path(PIECES), public_tokenizers.path(RANKS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return simhash.one_of_each(docs, shingle=4, radius=4)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has."""
    return substring.with_repeats_removed(docs, window=50)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), capacity=1024)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: Vocabularies and digests of hashed words can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared checkpoint folder and read again.

    Null texts, languages and ids, and empty texts, are what each stage says of them: the language stage rejects
    texts without letters, so none of these comes further. An empty table gives no rows. Other columns of the table are carried to the last stage.
    """
    scratch = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

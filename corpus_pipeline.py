"""A training corpus from raw documents: stages that each keep, change or pack what the stage before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns of ``docs``.
``n_chars`` follows the text where a stage changes it. Rows without an id stay unless the quality rules reject them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mrkit.llm import minhash, packing, pii, quality_rules, suffix_dedup
from mrkit.llm.queries import KEY
from mrkit.session import Generations

# Words of a shingle, and the similarity in percent from which documents are near duplicates.
WORDS, SIMILARITY = 5, 80

# Repeated strings go from 50 words or 400 bytes, whichever comes first: a word and the white space after it count as
# WORD_BYTES at least, and 8 less than 400 as the first word of a string may be cut and count differently.
PASSAGE_BYTES, WORD_BYTES = 392, 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the labels certify the cutoffs."""
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays."""
    return minhash.keep_one_of_each(docs, WORDS, SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings that also start elsewhere are cut out; documents of which nothing is left go."""
    return _counted(suffix_dedup.remove_repeated(docs, length=PASSAGE_BYTES, word_bytes=WORD_BYTES))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    replaced, _ = pii.replace_private(docs, KEY)
    return _counted(replaced.select(*docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", repeats),
    ("pii", private),
    ("packing", sequences),
]

# Exact binomial tests, MinHash and tokenizers are beyond SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next.

    What a stage has written is deleted when the next one is; the result still reads the last of these tables.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Generations(spark)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = tables.keep(docs)
    tables.release()
    return docs

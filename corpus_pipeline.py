"""Documents to packed training sequences, one operator after another.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame that is written and read again before the next
one: toxic documents go, repeated lines go, one document of each near-duplicate group stays, personal data is replaced, and what
is left is cut into token sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.sizing import shared_folder
from cohortline.llm import line_dedup, packing, simhash, surrogates, toxicity
from cohortline.llm.common import read_table
from cohortline.llm.queries import SURROGATE_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _resized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the size of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score stays below the threshold; the fit reads the given tables' labelled rows."""
    weights = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, weights, out="score").where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the first line of each class of nearly equal lines."""
    return _resized(line_dedup.without_duplicates(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document with the smallest id of each group of near duplicates; documents without an id stay."""
    return simhash.one_of_each(docs, repeats=False).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data."""
    return _resized(surrogates.rewritten(docs, SURROGATE_KEY))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place, and a checksum of their ids."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed_sequences),
]

#: Trained weights, edit distances and byte-pair merges are beyond SQL; tests run the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

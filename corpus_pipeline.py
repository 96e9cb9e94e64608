"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

The first four return the columns of documents; the last one the ids and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.llm import decontaminate, pieces, quality, secrets, shingles
from trolley.sources.scratch import staged

#: Width of the shingles of near copies, which have 0.8 or more of them in common (shingles.SIMILAR).
WIDTH = 5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return shingles.keep_one(docs, shingles.near_copies(docs, WIDTH))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, text): the ids of every document and the text they decode to."""
    coded = pieces.encode(docs, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "text")


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("sentencepiece", token_ids),
]

#: Fingerprints, trained models and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are a written table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

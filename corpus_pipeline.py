"""A corpus pipeline out of the training-data operators: toxic documents go, then exact and near copies, then sources are
mixed to target weights, and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebridge.llm import bpe, exact_dedup, mixing, simhash, toxicity
from pricebridge.llm.common import cut

# Of all stages: a null text is an empty text; an empty table stays empty; long texts are taken whole; columns of any name
# pass through. What follows says the rest.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels that are not held out.

    Equal texts and repeated rows stay or go alike; empty texts are scored like others. Without labels of both kinds the
    score is how frequent label 1 is.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of all with equal texts but for white space: the longest, then that with the smallest id (null last).

    Empty texts are one group, and of rows that repeat one id and text one stays.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of all that a similarity of five-word shingles of at least 0.8 links.

    Texts without words are one group. Rows that bear one id stay or go together; a group whose ids are all null stays.
    """
    return simhash.keep_one_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. A null source is a source; texts without words may come up to twice."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of what they decode to, for every row; empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.round_trip(docs, path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: No SQL can express the classifier or the encoder; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

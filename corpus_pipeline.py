"""A corpus from documents to token ids: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.llm import bpe, decontaminate, divergence, jaccard, toxicity
from agoraflow.llm.shared import fresh_path, id_crc32, table


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns as in its own query, without the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_crc32(F.col("doc_id")), F.lit(4)) != 2)
    return toxicity.keep_ordinary(docs, toxicity.fit(toxicity.labelled_sample(docs, labels)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return divergence.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return jaccard.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    encoded = bpe.encode_documents(docs)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", ordinary), ("quality rules", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", unseen), ("byte-level BPE", tokens)]

#: Compression, signature trees and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

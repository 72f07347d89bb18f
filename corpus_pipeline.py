"""From documents to token ids: quality rules, near copies, mixing, encoding.

Each stage is a function (spark, docs, folder of the tables) to a DataFrame that is written and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waybill.llm import byte_bpe, fertility, mixing, near_copies
from waybill.llm.catalog import pattern, vocabulary
from waybill.llm.frames import read
from waybill.session import fresh_folder


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return fertility.filter_quality(docs, vocabulary("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts, and the digests of the ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())


STAGES = [("quality rules", quality), ("near copies", near_dedup), ("mixing", mix), ("byte-level BPE", encode)]

#: Signatures, pieces and ids are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = fresh_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-data pipeline: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and, but for the last, returns the columns of documents.  ``run`` writes
every stage's rows into the shared folder before the next one reads them, so a
lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.bpe_chunks import encode_decode
from veilframe.llm.common import crc_mod, stored, table, work_dir
from veilframe.llm.exact_dedup import drop_duplicates
from veilframe.llm.mixing import mixed_documents
from veilframe.llm.near_join import drop_near_duplicates
from veilframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return encode_decode(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("bpe", bpe)]

#: The first, fourth and fifth stage have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)

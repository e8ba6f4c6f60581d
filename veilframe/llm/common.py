"""Shared plumbing of the training-data operators: tables, work folder, bounds."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.folders import hadoop_path
from veilframe.sources.folders import work_folder as work_dir  # noqa: F401

#: Bytes that one Arrow batch may hold (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20

#: The least and the most bits of a routing bitmap, as powers of two.
LEAST_BITS, MOST_BITS = 16, 27

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = " \t\n\x0b\x0c\r"


def let_go() -> None:
    """Give what a finished task took back to the system, so that a worker that is used again doesn't keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function of batches that lets go of its memory at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            let_go()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts within a worker's memory, by bytes; short rows still go by thousands."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder (in a folder for each value of ``by``) and read it back: cuts lineage.

    Its shuffle files go as soon as it is written, so a chain of steps needs the
    disk of one step at a time.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs of a text column without nulls."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x09-\\x0D\\x20]+"))).cast("long")


def crc_mod(id_col: str, m: int):
    """crc32 of the id's text modulo ``m``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % m


def keep_columns(docs: DataFrame, **extra) -> DataFrame:
    """The rows of ``docs`` as one column ``row`` beside ``extra`` columns, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), *(col.alias(name) for name, col in extra.items()))


def route_bitmap(rows: DataFrame, slot, bits_a_row: int = 16) -> np.ndarray:
    """A bitmap with a bit for the long ``slot`` of each row; ``bits_a_row`` to twice that a row, from 8 KB to 16 MB.

    ``slot`` counts modulo the bitmap's size.  More rows than fit saturate it:
    then more is let through, never less.
    """
    bits = min(max((bits_a_row * rows.count()).bit_length(), LEAST_BITS), MOST_BITS)
    at = slot.bitwiseAND(F.lit((1 << bits) - 1)) + 1
    got = rows.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in got:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    s = slots & (len(bits) * 8 - 1)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def router(spark: SparkSession, bits: np.ndarray):
    """A test of slots (longs) against a broadcast bitmap."""
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        return pd.Series(marked(sent.value, slots.to_numpy()))

    return test


def sample_by_label(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, max_chars: int):
    """A bounded, repeatable training sample: at most ``per_class`` rows of each
    of the labels 0 and 1, none longer than ``max_chars``.

    Ids are drawn first (top-k by a hash, a few bytes a row) and only their
    texts are fetched, through a broadcast of at most ``2 * per_class`` ids.  An
    id labelled both 0 and 1 isn't drawn; of rows that repeat an id the one
    whose text hashes lowest is, so the sample is bounded by rows as well.
    """
    value = F.col(label)
    known = (
        labels.where(value.isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(value).alias("_y"), F.max(value).alias("_other"))
        .where("_y = _other")
        .select("_id", F.col("_y").cast("int").alias("_y"))
    )
    ids = None
    for v in (0, 1):
        part = known.where(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    got = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
        .join(F.broadcast(ids), "_id")
        .groupBy("_id", "_y")
        .agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_t"))
        .select("_id", F.col("_t.t").alias("_text"), "_y")
        .collect()
    )
    got.sort(key=lambda r: r["_id"])
    return [r["_text"] for r in got], [r["_y"] for r in got]

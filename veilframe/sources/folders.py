"""Folders for a query's own tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``, deleted when the driver ends.

    Where that setting is absent a temporary folder is used if the session runs
    on one machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilframe-")
    path = f"{root.rstrip('/')}/vf-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def arrow_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) for tasks, which have no Hadoop classes at hand."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in ``folder``: computed once, whatever reads it, and cut from its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Move the only part file of ``folder`` to ``path``."""
    fs, p = hadoop_path(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files in {folder}")
    fs.rename(parts[0], hadoop_path(spark, path)[1])
    fs.delete(p, True)

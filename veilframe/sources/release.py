"""Several outputs as one commit: readers see all of a run's files or none.

Each version's outputs are written into a folder of its own.  A manifest, renamed
into place after the last of them, makes the version the current one; a writer
that stops before leaves the version before as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources.folders import drop_folder, exists, hadoop_path


def _numbers(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, f"{root}/manifests"):
        return []
    fs, p = hadoop_path(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """{version, outputs: {name: path below root}} of a version, the current one if none is named; None before the first."""
    numbers = _numbers(spark, root)
    if version is None:
        version = numbers[-1] if numbers else None
    if version is None:
        return None
    if version not in numbers:
        raise LookupError(f"no version {version} in {root}")
    fs, p = hadoop_path(spark, f"{root}/manifests/{version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, outputs: dict[str, DataFrame], keep: int = 2) -> int:
    """Write ``outputs`` as the next version and make it current; returns its number.

    Each is computed from what it reads when it is written, so outputs that have
    to agree should come from one table.  The last ``keep`` versions stay
    readable, older ones and what broken writers left go.  If another writer took
    the number meanwhile this one raises and changes nothing.
    """
    numbers = _numbers(spark, root)
    version = numbers[-1] + 1 if numbers else 1
    folder = f"versions/{version:012d}-{uuid.uuid4().hex[:8]}"
    for name, df in outputs.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    body = json.dumps({"version": version, "outputs": {name: f"{folder}/{name}" for name in outputs}})
    target, staged = f"{root}/manifests/{version:012d}.json", f"{root}/manifests/_{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, staged)
    stream = fs.create(p, False)
    try:
        stream.write(body.encode())
    finally:
        stream.close()
    if exists(spark, target) or not fs.rename(p, hadoop_path(spark, target)[1]):
        fs.delete(p, False)
        drop_folder(spark, f"{root}/{folder}")
        raise RuntimeError(f"version {version} of {root} was taken by another writer")
    _tidy(spark, root, (numbers + [version])[-max(1, keep) :])
    return version


def _tidy(spark: SparkSession, root: str, kept: list[int]) -> None:
    used = {path.split("/")[1] for v in kept for path in manifest(spark, root, v)["outputs"].values()}
    fs, p = hadoop_path(spark, f"{root}/versions")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        # a number above the last may be a writer at work
        if name not in used and int(name.split("-")[0]) <= kept[-1]:
            fs.delete(s.getPath(), True)
    for v in _numbers(spark, root):
        if v < kept[0]:
            drop_folder(spark, f"{root}/manifests/{v:012d}.json")


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """One output of a version, the current one if none is named."""
    found = manifest(spark, root, version)
    if found is None or name not in found["outputs"]:
        raise LookupError(f"no output {name} in {root}")
    return spark.read.parquet(f"{root}/{found['outputs'][name]}")

"""Counts kept up as documents come in: each batch adds its sums, none is counted twice.

A batch's state is one row of sums, its documents' ids in sorted blocks, and the
few documents that failed, published as one commit under the batch's number.
The totals add up one row a batch; no document is aggregated again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import stats
from veilframe.sources import release
from veilframe.sources.folders import exists, hadoop_path

#: Blocks of ids in a batch.
BLOCKS = 1024


class Counts:
    """Totals of an alignment under ``root``, by batches of ``stats.match_stats`` rows."""

    def __init__(self, spark: SparkSession, root: str, blocks: int = BLOCKS):
        self.spark, self.root, self.blocks = spark, root.rstrip("/"), blocks

    def batches(self) -> list[str]:
        if not exists(self.spark, self.root):
            return []
        fs, p = hadoop_path(self.spark, self.root)
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(n for n in names if release.manifest(self.spark, f"{self.root}/{n}") is not None)

    def _all(self, name: str, but: str | None = None) -> DataFrame | None:
        parts = [release.read(self.spark, f"{self.root}/{b}", name) for b in self.batches() if b != but]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _block(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def _new(self, rows: DataFrame, batch: str) -> DataFrame:
        """Without documents that another batch has, block by block; of repeated ids one row."""
        once = rows.dropDuplicates(["data_id"]).where("data_id is not null")
        known = self._all("ids", but=batch)
        if known is None:
            return once
        mine = once.groupBy(self._block("data_id").alias("block")).agg(F.collect_list("data_id").alias("mine"))
        old = known.groupBy("block").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        fresh = mine.join(old, "block", "left").select(F.explode(F.when(F.col("ids").isNull(), F.col("mine")).otherwise(F.array_except("mine", "ids"))).alias("data_id"))
        return once.join(fresh, "data_id", "left_semi")

    def add(self, batch: str, per_document: DataFrame, failed: DataFrame | None = None) -> None:
        """Count a batch; one that comes again takes the place of what it counted before.

        A document counts in the batch that had it first.  One that failed counts as
        failed until a batch has it without failure.
        """
        new = self._new(per_document, batch)
        ids = new.groupBy(self._block("data_id").alias("block")).agg(F.sort_array(F.collect_list("data_id")).alias("ids"))
        lost = per_document.where("false") if failed is None else failed.select(*per_document.columns).where("data_id is not null").dropDuplicates(["data_id"])
        release.publish(self.spark, f"{self.root}/{batch}", {"ids": ids, "sums": stats.run_sums(new), "failed": lost}, keep=1)

    def totals(self) -> DataFrame:
        """What ``stats.run_totals`` gives for all documents."""
        sums, lost, ids = self._all("sums"), self._all("failed"), self._all("ids")
        if sums is None:
            raise LookupError(f"no batch in {self.root}")
        done = ids.select(F.explode("ids").alias("data_id"))
        lost = lost.dropDuplicates(["data_id"]).join(done, "data_id", "left_anti")
        both = sums.unionByName(stats.run_sums(lost.where("false"), lost))
        return stats.with_rates(both.agg(*(F.sum(c).alias(c) for c in sums.columns)))

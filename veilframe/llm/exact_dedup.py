"""Exact dedup with counting quotient filters (operator 6).

Every partition folds its 48-bit fingerprints into one compact counting
quotient filter per fingerprint range.  Filters of a range merge losslessly,
because each lists its remainders in order below their quotients.  Fingerprints
counted more than once route their rows to byte verification (a grouping by the
text itself); no other text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_path, keep_columns, route_bitmap, router, small_batches, stored, tidy, work_dir

FP_BITS = 48
#: Fingerprints that a partition gathers before it writes out its filters.
FLUSH = 1 << 20
#: Rows of a range, and the fewest ranges as a power of two.
RANGE_ROWS, LEAST_RANGES = 1 << 20, 4


class CountingQuotientFilter:
    """Fingerprints below 2**bits with counts, in quotient order.

    ``occupied`` marks the quotients that have a run, ``run_end`` the last
    remainder of each run, ``remainders`` are sorted within a run, ``counts``
    stand beside them.
    """

    def __init__(self, bits: int, q_bits: int, occupied, run_end, remainders, counts):
        self.bits, self.q_bits = bits, q_bits
        self.occupied, self.run_end, self.remainders, self.counts = occupied, run_end, remainders, counts

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> "CountingQuotientFilter":
        q_bits = max(bits - 32, min(bits, int(len(keys)).bit_length()))
        r_bits = bits - q_bits
        quotients = keys >> np.uint64(r_bits)
        occupied = np.zeros(1 << q_bits, bool)
        occupied[quotients.astype(np.int64)] = True
        run_end = np.ones(len(keys), bool)
        run_end[:-1] = quotients[1:] != quotients[:-1]
        remainders = (keys & np.uint64((1 << r_bits) - 1)).astype(np.uint32)
        return cls(bits, q_bits, np.packbits(occupied), np.packbits(run_end), remainders, counts.astype(np.uint32))

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int) -> "CountingQuotientFilter":
        return cls.of_sorted(*np.unique(fingerprints, return_counts=True), bits)

    def keys(self) -> np.ndarray:
        n, r_bits = len(self.remainders), self.bits - self.q_bits
        if not n:
            return np.zeros(0, np.uint64)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q_bits)).astype(np.uint64)
        ends = np.unpackbits(self.run_end, count=n).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]])
        return (quotients[run] << np.uint64(r_bits)) | self.remainders.astype(np.uint64)

    def merge(self, *others: "CountingQuotientFilter") -> "CountingQuotientFilter":
        every = [self, *others]
        keys = np.concatenate([f.keys() for f in every])
        counts = np.concatenate([f.counts for f in every]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if not len(keys):
            return self
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return self.of_sorted(keys[first], np.add.reduceat(counts, first), self.bits)

    def count(self, key: int) -> int:
        keys = self.keys()
        at = int(np.searchsorted(keys, np.uint64(key)))
        return int(self.counts[at]) if at < len(keys) and int(keys[at]) == key else 0

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.q_bits, len(self.remainders)], np.int64).tobytes()
        return head + b"".join(a.tobytes() for a in (self.occupied, self.run_end, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "CountingQuotientFilter":
        bits, q_bits, n = (int(x) for x in np.frombuffer(blob, np.int64, 3))
        at, out = 24, []
        for kind, size in ((np.uint8, -(-(1 << q_bits) // 8)), (np.uint8, -(-n // 8)), (np.uint32, n), (np.uint32, n)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += out[-1].nbytes
        return cls(bits, q_bits, *out)


def _build(range_bits: int):
    low = FP_BITS - range_bits

    def filters(fps: np.ndarray) -> pd.DataFrame:
        keys, counts = np.unique(fps, return_counts=True)
        which = keys >> np.uint64(low)
        starts = np.searchsorted(which, np.arange((1 << range_bits) + 1, dtype=np.uint64))
        rows = []
        for r in range(1 << range_bits):
            a, b = starts[r], starts[r + 1]
            if a < b:
                own = keys[a:b] & np.uint64((1 << low) - 1)
                rows.append((r, CountingQuotientFilter.of_sorted(own, counts[a:b], low).to_bytes()))
        return pd.DataFrame(rows, columns=["range_id", "filter"])

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf["fp"].to_numpy().astype(np.uint64))
            n += len(pdf)
            if n >= FLUSH:
                yield filters(np.concatenate(held))
                held, n = [], 0
        if n:
            yield filters(np.concatenate(held))

    return run


def _merge(range_bits: int):
    low = FP_BITS - range_bits

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (CountingQuotientFilter.from_bytes(b) for b in pdf["filter"])
        merged = first.merge(*rest)
        many = merged.counts > 1
        fps = (np.uint64(key[0]) << np.uint64(low)) | merged.keys()[many]
        return pd.DataFrame({"fp": fps.astype(np.int64), "n": merged.counts[many].astype(np.int64)})

    return run


def range_bits(rows: int) -> int:
    """The ranges of fingerprints as a power of two: about RANGE_ROWS rows in each, whatever the input."""
    return min(max((rows // RANGE_ROWS).bit_length(), LEAST_RANGES), FP_BITS - 16)


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of every fingerprint in column ``fp`` that occurs more than once."""
    ranges = range_bits(fingerprints.count())
    blobs = fingerprints.select("fp").mapInPandas(tidy(_build(ranges)), "range_id long, filter binary")
    return blobs.groupBy("range_id").applyInPandas(_merge(ranges), "fp long, n long")


def _fingerprint(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FP_BITS)


def _sha(text):
    return F.unhex(F.sha2(text, 256))


def _narrow(docs: DataFrame, folder: str, id_col: str, text_col: str):
    """(doc_id, fp, sha) of every row, and a test of fingerprints: whether byte verification has to see their rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(docs.select(F.col(id_col).alias("doc_id"), _fingerprint(text).alias("fp"), _sha(text).alias("sha")), folder, "narrow")
    repeated = stored(repeated_fingerprints(narrow), folder, "repeated")
    return narrow, router(docs.sparkSession, route_bitmap(repeated, F.col("fp")))


def _verified(docs: DataFrame, routed, id_col: str, text_col: str) -> DataFrame:
    """(sha, keep, n) of each text that stands in more than one row, compared byte by byte; copies are added up before the shuffle."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        .where(routed(_fingerprint(F.col("body"))))
        .groupBy("body")
        .agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(_sha(F.col("body")).alias("sha"), "keep", "n")
    )


def _grouped(narrow: DataFrame, routed, groups: DataFrame):
    """(routed rows with keep and n, null where a row is alone; the rows that aren't routed).

    Nothing follows the join that needs its partitioning, so adaptive execution
    can deal the rows of a large group over several tasks.
    """
    return narrow.where(routed("fp")).join(groups, "sha", "left"), narrow.where(~routed("fp"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows with equal texts; of a group the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  A null text counts as empty.  A null id never wins over
    another; rows that repeat the winning id are all marked kept.  Columns other
    than the two named ones are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    folder = work_dir(docs.sparkSession)
    narrow, routed = _narrow(docs, folder, id_col, text_col)
    groups = stored(_verified(docs, routed, id_col, text_col), folder, "groups")
    some, alone = _grouped(narrow, routed, groups)
    kind = dict(narrow.dtypes)["doc_id"]
    every = some.select("doc_id", "sha", "keep", "n").unionAll(alone.select("doc_id", "sha", F.lit(None).cast(kind), F.lit(None).cast("long")))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return every.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row, that of the largest id, for each text.

    A null text counts as empty, a null id stays only where its text has no
    other; of rows that repeat both the id that stays and the text, that of the
    smallest hash stays.  All columns are kept, whatever their names; an empty table stays
    empty.  Digests decide which rows may stay, and only these few rows' texts
    are shuffled, for an exact check: rows whose fingerprint occurs once stay
    where they are, and rows that lose to another go where they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow, routed = _narrow(docs, folder, id_col, text_col)
    groups = stored(_verified(docs, routed, id_col, text_col), folder, "groups")
    some, _ = _grouped(narrow, routed, groups)
    slot = F.xxhash64("doc_id", "sha")
    stays = some.where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).select("doc_id", "sha")
    may_stay = router(spark, route_bitmap(stored(stays, folder, "stays"), slot))
    rows = keep_columns(docs, doc_id=F.col(id_col), sha=_sha(text), routed=routed(_fingerprint(text)))
    asked = rows.where("routed").withColumn("may", may_stay(slot)).where("may").groupBy("sha", "doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    sure = asked.join(groups, "sha", "left").where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep")))
    drop_path(spark, f"{folder}/narrow")
    return rows.where("not routed").select("row.*").unionAll(sure.select("row.*"))

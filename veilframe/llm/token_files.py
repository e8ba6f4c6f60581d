"""Token-id files with Re-Pair grammar compression (operator 8).

Documents are laid out in ascending id order and cut into shards of about
SHARD_IDS ids.  In a shard frequent pairs of ids become nonterminals, round
after round; the file keeps the rules, the length that each rule expands to, the
remaining symbols and a table of documents, so that any range of ids can be
decoded without the rest.  Files are binary values of a Parquet table in the
shared folder, which Spark's committers write once even if tasks are repeated.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import bpe
from veilframe.llm.common import small_batches, tidy, work_dir

MAGIC = b"RPT1"
SHARD_IDS = 1 << 20
#: Rounds (None: as many as find a pair that occurs LEAST times).
ROUNDS, LEAST = None, 24
END_ID = 0
#: Most bits of the table that finds a pair's rule.
BUCKETS = 20


def _frequent(pair: np.ndarray, least: int) -> np.ndarray:
    """The distinct values that occur at least ``least`` times, in order."""
    ordered = np.sort(pair)
    if least > 1:
        n = max(0, len(ordered) - least + 1)
        ordered = ordered[:n][ordered[least - 1 :] == ordered[:n]]
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _ranks(pair: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The place of each pair among ``kinds``, or -1: by a table of slots, and by search where two kinds share a slot."""
    bits = min(BUCKETS, len(kinds).bit_length() + 5)

    def slots(keys):
        return ((keys * keys.dtype.type(0x9E3779B1)) >> keys.dtype.type(keys.dtype.itemsize * 8 - bits)).astype(np.int32)

    of_kind, slot = slots(kinds), slots(pair)
    table = np.full(1 << bits, -1, np.int32)
    table[of_kind] = np.arange(len(kinds), dtype=np.int32)
    got = table[slot]
    got[kinds[got] != pair] = -1
    lost = np.flatnonzero(table[of_kind] != np.arange(len(kinds)))
    if len(lost):
        crowded = np.zeros(1 << bits, bool)
        crowded[of_kind[lost]] = True
        at = np.flatnonzero((got < 0) & crowded[slot])
        place = np.minimum(np.searchsorted(kinds[lost], pair[at]), len(lost) - 1)
        found = kinds[lost][place] == pair[at]
        got[at[found]] = lost[place[found]]
    return got


def compress(ids: np.ndarray, base: int, rounds: int | None = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k makes symbol base + k stand for two earlier symbols.

    Rounds go on until no pair occurs ``least`` times or the rules are used up;
    then the most frequent pairs get the rules that are left.
    """
    seq, rules, used, fresh = ids.astype(np.uint32), [], 0, 0
    room = max(0, (1 << 16) - base) if base < 1 << 16 else 1 << 16
    half, kind = (16, np.uint32) if base + room <= 1 << 16 else (32, np.uint64)
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(seq) < 2 or used >= room:
            break
        pair = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
        spot = None
        if used:
            # What occurred less than ``least`` times in the last round does so still, so only pairs with a new symbol are counted.
            new = seq >= fresh
            spot = np.flatnonzero(new[:-1] | new[1:])
            pair = pair[spot]
        kinds = _frequent(pair, least)
        if not len(kinds):
            break
        rank = _ranks(pair, kinds)
        at = np.flatnonzero(rank >= 0)
        if len(kinds) > room - used:
            keep = np.sort(np.argsort(-np.bincount(rank[at], minlength=len(kinds)), kind="stable")[: room - used])
            to = np.full(len(kinds), -1, np.int32)
            to[keep] = np.arange(len(keep))
            kinds, rank = kinds[keep], np.where(rank >= 0, to[rank], -1)
            at = np.flatnonzero(rank >= 0)
        sym = rank[at] + (base + used)
        at = at if spot is None else spot[at]
        fresh = base + used
        # Of overlapping places, every second one of a run of neighbours is taken.
        near = at[1:] == at[:-1] + 1
        if near.any():
            first = np.concatenate([[True], ~near])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run) % 2 == 0
            at, sym = at[take], sym[take]
        seq[at] = sym
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.stack([kinds >> kind(half), kinds & kind((1 << half) - 1)], 1).astype(np.uint32))
        used += len(kinds)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """What each nonterminal expands to, in ids."""
    out = np.ones(base + len(rules), np.uint32)
    left = np.arange(len(rules))
    known = np.zeros(len(out), bool)
    known[:base] = True
    while len(left):
        ready = known[rules[left, 0]] & known[rules[left, 1]]
        k = left[ready]
        out[base + k] = out[rules[k, 0]] + out[rules[k, 1]]
        known[base + k] = True
        left = left[~ready]
    return out[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for: each rule is spelled out once, then all symbols are copied from these."""
    spelled, size = _spelled(rules, base)
    start = np.cumsum(size) - size
    big = size[symbols]
    ends = np.cumsum(big)
    return spelled[np.repeat(start[symbols] - (ends - big), big) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _spelled(rules: np.ndarray, base: int):
    """(ids of all symbols in order, one after another, and how many each has)."""
    seq, owner = np.arange(base + len(rules), dtype=np.uint32), np.arange(base + len(rules))
    while True:
        big = seq >= base
        if not big.any():
            return seq, np.bincount(owner, minlength=base + len(rules))
        size = 1 + big.astype(np.int64)
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        pair = rules[seq[big] - base]
        out[start[~big]] = seq[~big]
        out[start[big]] = pair[:, 0]
        out[start[big] + 1] = pair[:, 1]
        seq, owner = out, np.repeat(owner, size)


def pack(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    symbols, rules = compress(ids, base)
    wide = 2 if base + len(rules) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<IIQQII", base, wide, len(doc_ids), len(symbols), len(rules), 0)
    kind = np.uint16 if wide == 2 else np.uint32
    return head + doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes() + rules.astype("<u4").tobytes() + lengths_of(rules, base).astype("<u4").tobytes() + symbols.astype(kind).tobytes()


class TokenFile:
    """A shard read back: documents, and any range of its ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        self.base, wide, docs, symbols, rules, _ = struct.unpack_from("<IIQQII", blob, 4)
        at = 4 + struct.calcsize("<IIQQII")
        out = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", 2 * rules), ("<u4", rules), ("<u2" if wide == 2 else "<u4", symbols)):
            out.append(np.frombuffer(blob, kind, n, at))
            at += out[-1].nbytes
        self.doc_ids, self.known, self.counts, flat, self.lengths, self.symbols = out
        self.rules = flat.reshape(-1, 2)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``; only symbols that cover them are expanded."""
        if start == 0 and stop is None:
            return expand(self.symbols, self.rules, self.base)
        size = np.ones(len(self.symbols), np.int64)
        big = self.symbols >= self.base
        size[big] = self.lengths[self.symbols[big].astype(np.int64) - self.base]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None else stop
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        lead = start - int(ends[a] - size[a]) if a < len(ends) else 0
        return expand(self.symbols[a:b], self.rules, self.base)[lead : lead + stop - start]


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode and write all documents in ascending id order (null ids first, rows of one id by a hash of their text).

    Rows of ``path``: part, piece (their order is the documents'), start (ids of
    the part before this piece), n_docs, n_ids, file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(bpe.ByteBpe.read(tokenizer))

    def encode(batches):
        codec = bpe.of(spec.value)
        base = len(codec.bytes)
        part = TaskContext.get().partitionId()
        held, doc_ids, known, counts, n, before, piece = [], [], [], [], 0, 0, 0

        def flush():
            ids = np.concatenate(held)
            blob = pack(np.array(doc_ids, np.int64), np.array(known, bool), np.array(counts), ids, base)
            return pd.DataFrame({"part": [part], "piece": [piece], "start": [before], "n_docs": [len(doc_ids)], "n_ids": [n], "file": [blob]})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids = np.append(codec.array(text or ""), np.uint32(END_ID))
                held.append(ids)
                known.append(not pd.isna(doc_id))
                doc_ids.append(int(doc_id) if known[-1] else 0)
                counts.append(len(ids))
                n += len(ids)
                if n >= shard_ids:
                    yield flush()
                    before, piece = before + n, piece + 1
                    held, doc_ids, known, counts, n = [], [], [], [], 0
        if doc_ids:
            yield flush()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
        .mapInPandas(tidy(encode), "part int, piece int, start long, n_docs long, n_ids long, file binary")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    small_batches(spark)
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each partition written
    base, offsets = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets.append((r["part"], base))
        base += r["n"]
    placed = files.join(F.broadcast(spark.createDataFrame(offsets, "part int, base long")), "part")

    def decode(batches):
        for pdf in batches:
            for base, start, blob in zip(pdf["base"].tolist(), pdf["start"].tolist(), pdf["file"].tolist()):
                f = TokenFile(bytes(blob))
                ids = f.ids().astype("<u4")
                ends = np.cumsum(f.counts.astype(np.int64))
                starts = ends - f.counts
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(f.doc_ids.astype(np.int64), f.known == 0), "start": starts + start + base, "n_tokens": f.counts.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    return placed.select("base", "start", "file").mapInPandas(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the token files (to ``path`` or the shared folder) and read the documents' rows back.

    Null texts count as empty and get the end id alone; rows with equal ids are
    laid out by a hash of their texts, in several tasks if they are many; an empty table gives no files and no rows.
    """
    path = path or f"{work_dir(docs.sparkSession)}/token_files"
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)

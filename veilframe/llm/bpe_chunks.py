"""BPE encoding and decoding with content-defined chunk reuse (operator 7).

A rolling hash over the last 16 bytes cuts texts into chunks, so passages that
documents share give equal chunks wherever they stand.  Documents are dealt to
bins.  One pass lists the digests of each bin's chunks; chunks of more than one
bin are sent to the task that owns their digest and encoded there once, and
their ids go to every bin that needs them.  A bin's documents then meet these
ids; a chunk that no other bin has is encoded in its bin and kept while the bin
lasts.  Documents without a shared chunk stay where they are.

Tokens around a cut may differ from those of the whole text, so each join is
encoded again, between places where a token must end: where a blank follows a
visible ASCII character, which no token spans, whatever stands around.  The
window begins at the last but one such place of the left chunk and ends at the
second one of the right chunk, and its ids have to agree exactly with the left
chunk's ids up to its last place and with the right chunk's from its first one;
if they don't, or a chunk lacks such places, the window grows over the chunk.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import bpe
from veilframe.llm.common import BATCH_BYTES, drop_path, partitions, route_bitmap, small_batches, stored, tidy, work_dir

#: A cut for about every 2**MASK_BITS bytes, and the shortest and longest chunk.
MASK_BITS, MIN_CHUNK, MAX_CHUNK = 10, 256, 1 << 15
#: Bytes of texts that a bin is meant to hold.
BIN_BYTES = 8 << 20
#: Bytes of a bin's own chunks whose ids are kept, as a number of ids.
CACHE_IDS = 4 << 20
#: Bytes of text that are encoded before their ids are folded into the digests.
PART_BYTES = 1 << 20
#: Bits of the bitmap for each shared chunk: a document has many chunks, so each must seldom pass for another.
ROUTE_BITS = 512
#: Digests of chunks, with their bins, that a task remembers to have sent.
SENT = 1 << 18
#: Bins of a block: a chunk is encoded once for all bins of one.
BLOCK_BINS = 1 << 12

FIRST = re.compile(rb"[!-~](?=[ \t\n\r])")
LAST = re.compile(rb".*[!-~](?=[ \t\n\r])", re.S)
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Inner chunk bounds of ``data``, at starts of UTF-8 characters."""
    n = len(data)
    if n <= MIN_CHUNK:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    places = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0).tolist() + [n]
    out, last = [], 0
    for p in places:
        p = min(p + 1, n)
        while p - last > MAX_CHUNK:
            last = _whole(data, last + MAX_CHUNK)
            out.append(last)
        if p - last >= MIN_CHUNK and p < n:
            p = _whole(data, p)
            if p < n:
                out.append(p)
                last = p
    return [p for p in out if p < n]


def _whole(data: bytes, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def parts(codec: bpe.Splitter, text: str):
    """(bytes, special id) of one text after another, cut at sure places into about PART_BYTES bytes."""
    for part, special in codec.segments(text):
        if special is not None:
            yield b"", special
            continue
        data, at = part.encode("utf-8"), 0
        while at < len(data):
            m = FIRST.search(data, at + PART_BYTES) if len(data) - at > PART_BYTES else None
            end = m.end() if m else len(data)
            yield data[at:end], None
            at = end


def chunks(codec: bpe.Splitter, text: str):
    for data, special in parts(codec, text):
        if special is None:
            bounds = [0, *cuts(data), len(data)]
            for a, b in zip(bounds, bounds[1:]):
                yield data[a:b]


class ChunkEncoder:
    """Encodes texts by chunks; ``reused`` and ``encoded`` count them.

    ``shared`` maps digests to ids (bytes) that were encoded elsewhere; others are
    encoded here and kept, up to ``cache_ids`` ids in all.
    """

    def __init__(self, codec: bpe.ByteBpe, shared: dict | None = None, cache_ids: int = CACHE_IDS):
        self.codec, self.shared, self.cache_ids = codec, shared or {}, cache_ids
        self.cache: dict[bytes, tuple] = {}
        self.held = self.reused = self.encoded = 0

    def _chunk(self, data: bytes):
        """(ids, places): the token and byte numbers of the first two and last two sure ends, or None."""
        key = digest(data)
        got = self.cache.get(key)
        if got is not None:
            self.reused += 1
            return got[0].tolist(), got[1]
        known = self.shared.get(key)
        if known is None:
            self.encoded += 1
            ids = self.codec.plain(data.decode("utf-8"))
        else:
            self.reused += 1
            ids = np.frombuffer(known, self.codec.kind).tolist()
        places = self._places(data, ids)
        if self.held > self.cache_ids:
            self.cache.clear()
            self.held = 0
        self.cache[key] = (np.array(ids, self.codec.kind), places)
        self.held += len(ids)
        return ids, places

    def _places(self, data: bytes, ids: list[int]):
        first = FIRST.search(data)
        second = first and FIRST.search(data, first.end())
        if not second:
            return None
        last = LAST.match(data).end()
        before = LAST.match(data, 0, last)
        if not before or before.end() < second.end():
            return None
        at = (first.end(), second.end(), before.end(), last)
        ends = np.cumsum(self.codec.lengths[ids])
        tokens = np.searchsorted(ends, at)
        if (ends[tokens] != at).any():
            return None
        return *(tokens + 1).tolist(), *at

    def _segment(self, data: bytes) -> list[int]:
        bounds = [0, *cuts(data), len(data)]
        if len(bounds) == 2:
            return self._chunk(data)[0]
        out: list[int] = []
        pending, due = 0, []
        for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
            ids, places = self._chunk(data[s:e])
            if places is None:
                continue
            a1, a2, b2, b1, _, second, before, _ = places
            if k == 0:
                out += ids[:b2]
            else:
                window = self.codec.plain(data[pending : s + second].decode("utf-8"))
                if window[: len(due)] != due or window[len(window) - (a2 - a1) :] != ids[a1:a2]:
                    continue
                out += window
                if k == len(bounds) - 2:
                    return out + ids[a2:]
                out += ids[a2:b2]
            pending, due = s + before, ids[b2:b1]
        return out + self.codec.plain(data[pending:].decode("utf-8"))

    def parts(self, text: str):
        """Lists of ids of one text after another, each of about PART_BYTES bytes."""
        if not self.codec.fast:
            yield self.codec.plain(text)
            return
        for data, special in parts(self.codec, text):
            yield [special] if special is not None else self._segment(data)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part]


class Digests:
    """Rows (n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids) of texts."""

    def __init__(self, codec: bpe.ByteBpe, with_ids: bool):
        self.codec, self.with_ids = codec, with_ids
        self.names = [str(i) for i in range(len(codec.bytes))]

    def row(self, encoder: ChunkEncoder, text: str) -> tuple:
        n, of_ids, of_bytes, every, tail = 0, hashlib.sha256(), hashlib.sha256(), [], b""
        names = self.names
        for ids in encoder.parts(text):
            if not ids:
                continue
            of_ids.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
            n += len(ids)
            if self.codec.fast:
                tail += self.codec.decode_bytes(ids)
                whole = tail.decode("utf-8", "ignore").encode() if len(tail) > 4 and tail[-1] & 0x80 else tail
                of_bytes.update(whole.decode("utf-8", "replace").encode())
                tail = tail[len(whole) :]
            else:
                of_bytes.update(self.codec.decode(ids).encode())
            if self.with_ids:
                every += ids
        of_bytes.update(tail.decode("utf-8", "replace").encode())
        return n, of_ids.hexdigest(), of_bytes.hexdigest(), *([every] if self.with_ids else [])

    def batch(self, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 if self.with_ids else 3]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(kinds) + 1]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def _digests_of_chunks(codec: bpe.Splitter):
    def run(batches):
        for batch in batches:
            bins, hashes = [], []
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h in {digest(c) for c in chunks(codec, text)}:
                    bins.append(b)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(hashes, pa.binary())], ["bin", "h"])

    return run


def _is_shared(bits: np.ndarray, h: bytes) -> bool:
    slot = int.from_bytes(h[:6], "big") & (len(bits) * 8 - 1)
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def _routed(spec, sent, with_ids: bool):
    """One pass over the texts, as rows of three kinds.

    0: the digests of a text without a chunk that the bitmap lets through.  1: a
    text with one, and its bin.  2: such a chunk's digest and bin, once a task,
    and its bytes the first time that the task meets it in a block of bins.
    """

    def run(batches):
        codec, bits = bpe.of(spec.value), sent.value
        out, encoder, told, given = Digests(codec, with_ids), ChunkEncoder(codec), set(), set()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            alone, rows, moved, texts, bins = [], [], [], [], []
            hashes, places, data = [], [], []
            for i, (text, b) in enumerate(zip(batch.column("text").to_pylist(), batch.column("bin").to_pylist())):
                found = [(h, c) for c in chunks(codec, text) if _is_shared(bits, h := digest(c))]
                if not found:
                    alone.append(i)
                    rows.append(out.row(encoder, text))
                    continue
                moved.append(i)
                texts.append(text)
                bins.append(b)
                for h, c in found:
                    if (h, b) in told:
                        continue
                    if len(told) >= SENT:
                        told.clear()
                        given.clear()
                    told.add((h, b))
                    first = (h, b // BLOCK_BINS) not in given
                    given.add((h, b // BLOCK_BINS))
                    hashes.append(h)
                    places.append(b)
                    data.append(c if first else None)
            yield _parts(0, out.batch(doc_ids.take(pa.array(alone, pa.int64())), rows), with_ids, doc_ids.type)
            yield _parts(1, pa.RecordBatch.from_arrays([doc_ids.take(pa.array(moved, pa.int64())), pa.array(texts, pa.string()), pa.array(bins, pa.int32())], ["doc_id", "text", "bin"]), with_ids, doc_ids.type)
            yield _parts(2, pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(places, pa.int32()), pa.array(data, pa.binary())], ["h", "bin", "chunk"]), with_ids, doc_ids.type)

    return run


def _parts(kind: int, batch: pa.RecordBatch, with_ids: bool, id_type: pa.DataType) -> pa.RecordBatch:
    """A batch with the columns of all kinds."""
    types = {"doc_id": id_type, "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), **({"ids": pa.list_(pa.int32())} if with_ids else {}), "text": pa.string(), "bin": pa.int32(), "h": pa.binary(), "chunk": pa.binary()}
    n = batch.num_rows
    columns = [batch.column(c) if c in batch.schema.names else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays([*columns, pa.array([kind] * n, pa.int32())], [*types, "kind"])


def _encoded_once(spec, whole: bool):
    """(bin, h, ids) of each bin of a chunk, from rows (h, bin, chunk) in order of chunk, rows with bytes first.

    If all bins of a chunk are there (``whole``), one that only one bin has was
    let through by mistake and goes.  Of a chunk its bins are remembered, at most
    BLOCK_BINS of them.
    """

    def run(batches):
        codec, past, seen, ids, first = bpe.of(spec.value), None, set(), None, None
        for batch in batches:
            out = []
            for h, b, chunk in zip(*(batch.column(c).to_pylist() for c in ("h", "bin", "chunk"))):
                key = h, b // BLOCK_BINS
                if key != past:
                    past, seen, ids, first = key, set(), None, chunk
                if b in seen:
                    continue
                seen.add(b)
                if len(seen) == 1 and whole:
                    alone = b
                    continue
                if ids is None:
                    ids = np.array(codec.plain(first.decode("utf-8")), codec.kind).tobytes()
                    if whole:
                        out.append((alone, h, ids))
                out.append((b, h, ids))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bin", "h", "ids"])

    return run


def _bins(spec, with_ids: bool):
    """Digests of documents, sorted by bin and each bin's shared ids before them."""

    def run(batches):
        codec = bpe.of(spec.value)
        out, now, encoder = Digests(codec, with_ids), None, ChunkEncoder(codec)
        for batch in batches:
            bins, h, ids, texts = (batch.column(c).to_pylist() for c in ("bin", "h", "ids", "text"))
            rows, live = [], []
            for i, b in enumerate(bins):
                if b != now:
                    now, encoder = b, ChunkEncoder(codec)
                if h[i] is not None:
                    encoder.shared[h[i]] = ids[i]
                else:
                    live.append(i)
                    rows.append(out.row(encoder, texts[i]))
            yield out.batch(batch.column("doc_id").take(pa.array(live, pa.int64())), rows)

    return run


def _alone(spec, with_ids: bool):
    """Digests of documents, text by text."""

    def run(batches):
        codec = bpe.of(spec.value)
        out, encoder = Digests(codec, with_ids), ChunkEncoder(codec)
        for batch in batches:
            yield out.batch(batch.column("doc_id"), [out.row(encoder, t) for t in batch.column("text").to_pylist()])

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (and ids, if asked for).

    Null texts count as empty and have no ids; very long texts are encoded and
    folded into their digests a part at a time; rows that repeat an id give a
    row each, null ids too; an empty table gives no rows; other columns are not
    read, whatever their names.  ``tokenizer`` is the vocabulary file, read on
    the driver.  A vocabulary that isn't plain byte-level BPE is encoded text by
    text, without chunks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = bpe.ByteBpe.read(tokenizer)
    spec = spark.sparkContext.broadcast(text)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.select("doc_id").dtypes[0][1]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    doc = json.loads(text)
    if not bpe.is_plain(doc):
        return named.mapInArrow(tidy(_alone(spec, with_ids)), schema)
    folder, splitter = work_dir(spark), bpe.Splitter(bpe.special_tokens(doc))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bins = max(partitions(spark), -(-total // BIN_BYTES))
    binned = named.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_bins)).cast("int"))
    by_bin = binned.select("bin", "text").mapInArrow(tidy(_digests_of_chunks(splitter)), "bin int, h binary")
    shared = stored(by_bin.groupBy("h").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo < hi").select("h"), folder, "shared")
    slot = F.conv(F.hex(F.substring("h", 1, 6)), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(route_bitmap(shared, slot, ROUTE_BITS))
    results = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    routed = stored(binned.mapInArrow(tidy(_routed(spec, bits, with_ids)), f"{schema}, text string, bin int, h binary, chunk binary, kind int"), folder, "routed", "kind")

    # Each shared chunk is encoded once, by the task that its digest belongs to, and sent to its bins; past BLOCK_BINS bins, once
    # for each block of them, so that no task has all bins of a chunk that stands everywhere.
    whole = n_bins <= BLOCK_BINS
    told = routed.where("kind = 2").select("h", "bin", "chunk")
    told = told if whole else told.join(shared, "h", "left_semi")
    block = F.floor(F.col("bin") / BLOCK_BINS)
    told = told.repartition("h", block).sortWithinPartitions("h", block, F.col("chunk").isNull(), "bin")
    ids = told.mapInArrow(tidy(_encoded_once(spec, whole)), "bin int, h binary, ids binary")

    some = routed.where("kind = 1").select("bin", F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("ids"), "doc_id", "text")
    both = ids.select("bin", "h", "ids", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text")).unionAll(some)
    ordered = both.repartition(min(n_bins, max(partitions(spark), 1 << 13)), "bin").sortWithinPartitions("bin", F.col("h").isNull())
    found = stored(ordered.mapInArrow(tidy(_bins(spec, with_ids)), schema), folder, "found")
    drop_path(spark, f"{folder}/shared")
    drop_path(spark, f"{folder}/routed/kind=1")
    drop_path(spark, f"{folder}/routed/kind=2")
    return found.unionAll(routed.where("kind = 0").select(*results))

"""N-gram Jaccard join by grouped prefixes (operator 4).

A text's set are the 64-bit hashes of its word shingles, in one order for all
texts: by how often a counting sketch has seen a shingle in the whole corpus,
rarest first, then by hash.  Two sets that overlap enough share a shingle of
their prefixes.  Equal sets are one class; classes with equal prefixes and size
are one group, and groups meet where they share a prefix shingle.

Group pairs are filtered by size, by the places of their shared shingles and by
how many prefix shingles they share, which bounds how much they can overlap at
all.  Members are expanded and verified in two ways.  First each group meets
only one neighbour per shared shingle, in a few rounds; the links found join
most near copies.  Then all pairs of a shingle are met whose classes no links
join yet, whichever members of their groups they are, so no link between
components is lost while a large group of near copies isn't paired out.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import drop_path, keep_columns, marked, route_bitmap, router, small_batches, stored, tidy, work_dir
from veilframe.llm.graph import components
from veilframe.llm.textvec import PLACES, mixed, word_hashes

SHINGLE, PERCENT = 4, 85
#: Rows of the counting sketch, its blocks, its steps to a logarithm of 1.
ROWS, BLOCK_BITS, STEPS = 2, 15, 2600
#: Bytes of text for each cell of a row, and the least and most cells as powers of two (4 bytes of broadcast a cell).
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 256, 16, 24
#: Shingles of more groups are busy: their groups are dealt over tasks of about so many, and what has to meet is aggregated or copied first.
BUSY = 1000
#: Bytes of a text whose words are split at a time.
SLICE = 1 << 20

BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def hashed_words(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased."""
    data = text.encode("utf-8").lower()
    if len(data) <= SLICE:
        return word_hashes(data.split())
    out, at = [], 0
    while at < len(data):
        m = BLANK.search(data, at + SLICE)
        end = m.start() if m else len(data)
        out.append(word_hashes(data[at:end].split()))
        at = end
    return np.concatenate(out)


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, in order of hash."""
    h = hashed_words(text)
    if not len(h):
        return h
    if len(h) < k:
        return mixed(np.array([np.sum(h * PLACES[: len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    g = h[: len(h) - k + 1] * PLACES[0]
    for i in range(1, k):
        g = g + h[i : len(h) - k + 1 + i] * PLACES[i]
    return np.unique(mixed(g))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each shingle in one of the sketch's rows."""
    h = hashes if row == 0 else hashes * PLACES[4]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(k: int, bits: int):
    def run(batches):
        cells = np.zeros((ROWS, 1 << bits), np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text or "", k)
                for r in range(ROWS):
                    np.add.at(cells[r], _cells(s, r, bits), 1)
        if cells.any():
            blocks = cells.reshape(-1, 1 << BLOCK_BITS)
            for at in range(0, len(blocks), 16):
                small = [b.astype(np.uint8 if b.max() < 256 else np.uint32).tobytes() for b in blocks[at : at + 16]]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(small)), pa.int32()), pa.array(small, pa.binary())], ["block", "cells"])

    return run


def shingle_counts(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """The merged count-min sketch: how often shingles of each cell occur over all documents, a line for each of its rows.

    Counts are kept as logarithms in steps of about 0.04 %, which is finer than
    their noise and halves what is broadcast.  The cells grow with the text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // CELL_BYTES).bit_length(), LEAST_CELLS), MOST_CELLS)

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for c in pdf["cells"]:
            total += np.frombuffer(c, np.uint8 if len(c) == 1 << BLOCK_BITS else np.uint32)
        return pd.DataFrame({"block": [key[0]], "cells": [np.round(np.log1p(total) * STEPS).astype(np.uint16).tobytes()]})

    rows = docs.select("text").mapInArrow(tidy(_sketch(k, bits)), "block int, cells binary").groupBy("block").applyInPandas(add, "block int, cells binary").collect()
    out = np.zeros((ROWS << bits >> BLOCK_BITS, 1 << BLOCK_BITS), np.uint16)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["cells"], np.uint16)
    return out.reshape(ROWS, -1)


def frequency(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The sketch's estimate of how often each shingle occurs, as a logarithm; the same for all documents."""
    bits = counts.shape[1].bit_length() - 1
    return np.minimum.reduce([counts[r][_cells(hashes, r, bits)] for r in range(ROWS)])


def _signatures(sent, k: int, percent: int):
    weights = np.random.default_rng(17).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)

    def digest(values: np.ndarray) -> list[int]:
        a = mixed(values * weights[0])
        b = mixed((values ^ weights[1]) * weights[2])
        return [int(x) for x in np.array([np.sum(a, dtype=np.uint64), np.sum(b, dtype=np.uint64)]).astype(np.int64)]

    def run(batches):
        counts = sent.value
        for batch in batches:
            ids, n, marks, prefixes = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text or "", k)
                often = frequency(counts, s)
                order = np.argsort(often, kind="stable")
                order = order[: prefix_length(len(s), percent)] if len(s) else order
                p = s[order]
                n.append(len(s))
                marks.append(digest(s) + digest(p))
                prefixes.append(p.astype(np.int64))
            cols = list(zip(*marks)) if marks else [()] * 4
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "n", "h1", "h2", "p1", "p2", "prefix"])

    return run


def _sets(bits, k: int):
    def run(batches):
        for batch in batches:
            ids, keep, sets = batch.column(0), [], []
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(marked(bits.value, slots))
            texts = batch.column(1).take(pa.array(wanted)).to_pylist()
            for i, text in zip(wanted.tolist(), texts):
                s = shingles(text or "", k).astype(np.int64)
                if len(s):
                    keep.append(i)
                    sets.append(s)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), values)], ["cid", "set"])

    return run


def _near_in_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The component of every document under links of Jaccard similarity >= percent / 100.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    id reachable).  Null and empty texts have no shingles and link with
    nothing; texts shorter than a shingle are one shingle; very long texts are
    read whole.  Rows that repeat an id are one node, linked by the texts of
    either; a null id links with nothing.  Other columns are not read, an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(named, shingle))
    sig = stored(named.mapInArrow(tidy(_signatures(counts, shingle, percent)), "doc_id long, n long, h1 long, h2 long, p1 long, p2 long, prefix array<long>"), folder, "signatures")
    keys = ["n", "p1", "p2", "h1", "h2"]
    live = sig.where("n > 0 and doc_id is not null")
    classes = live.groupBy(*keys).agg(F.min("doc_id").alias("cid"))
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes.join(groups, ["n", "p1", "p2"]), folder, "classes")

    # Postings of groups.  A shingle leads on only where the next smaller or larger group that has it is near in size; a busy
    # one, by an exact count of its groups, always does.
    heads = classes.where("cid = gid").select("n", "p1", "p2", F.col("gid").alias("doc_id"))
    postings = sig.join(heads, ["doc_id", "n", "p1", "p2"], "left_semi").select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("gid"), "n")
    postings = stored(postings, folder, "postings")
    often = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUSY).select("token", F.ceil(F.col("c") / max(BUSY, 1)).cast("int").alias("salts")), folder, "often")
    postings = postings.join(often, "token", "left").withColumn("busy", F.col("salts").isNotNull()).withColumn("salts", F.coalesce("salts", F.lit(1)))
    over = Window.partitionBy("token", "salt").orderBy("n", "gid")
    below, above = F.lag("n").over(over), F.lead("n").over(over)
    near = (F.coalesce(below, F.lit(0)) * 100 >= F.col("n") * percent) | (F.coalesce(F.col("n") * 100 >= above * percent, F.lit(False)))
    postings = postings.withColumn("salt", _salt("gid")).withColumn("near", F.col("busy") | near).where("near").withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("gid")))
    fields = ["token", "gid", "n", "pos", "salts"]
    shared = stored(postings.select(*fields, "k", "busy"), folder, "shared", "busy")
    drop_path(spark, f"{folder}/postings")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs (a, b) of classes; only the texts of these classes are read as sets.

        Each pair brings the set of its b to that of a.  Adaptive execution may
        deal the pairs of a busy a over several tasks, as nothing that follows
        needs the join's partitioning.
        """
        pairs = stored(pairs.where("a <> b").distinct(), folder, f"pairs-{name}")
        asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), folder, f"asked-{name}")
        bits = spark.sparkContext.broadcast(route_bitmap(asked, F.xxhash64("cid")))
        sets = named.select("doc_id", "text", F.xxhash64("doc_id").alias("slot")).where("doc_id is not null").mapInArrow(tidy(_sets(bits, shingle)), "cid long, set array<long>")
        sets = stored(sets.join(asked, "cid", "left_semi"), folder, f"sets-{name}")
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - both
        met = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
        links = stored(met.where(both * 100 >= union * percent).select("a", "b"), folder, f"links-{name}")
        for part in ("sets", "asked", "pairs"):
            drop_path(spark, f"{folder}/{part}-{name}")
        return links

    # Rounds of single neighbours: of the groups that share a shingle the one that shares most of its shingles (what copies
    # were made from shares all of them), then that of smallest id.
    orders = (F.col("n") / F.col("k"), F.col("gid"))
    links = verified(_single(shared, orders[0], percent).unionAll(classes.where("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))), "0")
    joined = components(links, folder, "joined-0")
    for r, order in enumerate(orders[1:], 1):
        pairs = _single(shared, order, percent)
        links = links.unionAll(verified(_apart(pairs, joined), str(r)))
        joined = components(links, folder, f"joined-{r}")

    # Every pair left whose classes no links join.
    comps = classes.select("gid", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("comp", "cid").alias("comp"))
    comps = stored(comps, folder, "comps")
    # A group's members can lie in several components; only groups that lie in one and the same have nothing to find.
    spread = comps.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    placed = stored(shared.join(spread, "gid").select(*fields, "lo", "hi", "busy"), folder, "placed", "busy")
    whole = Window.partitionBy("token")
    calm = placed.where("not busy").withColumn("first", F.min("lo").over(whole)).withColumn("last", F.max("hi").over(whole)).where("first <> last")
    ends = placed.where("busy").groupBy("token", "salts").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first <> last")
    busy = _salted(placed.where("busy"), ends)
    names = [*fields, "lo", "hi", "busy"]
    open_ = stored(calm.select(*names).unionAll(busy.select(*names)), folder, "open")
    # Of a busy shingle each block of groups meets all groups in a task of its own.
    x = open_.select("token", _salt("gid").alias("block"), "gid", "n", "pos", "lo", "hi").toDF("token", "block", "ga", "na", "pa", "la", "ha")
    y = open_.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("block"), "gid", "n", "pos", "lo", "hi").toDF("token", "block", "gb", "nb", "pb", "lb", "hb")
    # A pair needs a shingle early enough in both sets: with what follows it they can still overlap enough.
    early = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _least_overlap(percent)
    differ = F.least("la", "lb") != F.greatest("ha", "hb")
    across = x.join(y, ["token", "block"]).where((F.col("ga") < F.col("gb")) & differ & _near_in_size("na", "nb", percent) & early).select("ga", "gb").distinct()
    # Components are paired before members, so that only members to be verified are.
    parts = comps.select("gid", "comp").distinct()
    apart = across.join(parts.toDF("ga", "ca"), "ga").join(parts.toDF("gb", "cb"), "gb").where("ca <> cb")
    wide = apart.join(comps.toDF("ga", "a", "ca"), ["ga", "ca"]).join(comps.toDF("gb", "b", "cb"), ["gb", "cb"]).select("a", "b")
    own = comps.join(classes.where("members > 1").select("gid", "cid").distinct(), ["gid", "cid"], "left_semi")
    within = own.toDF("gid", "a", "ca").join(own.toDF("gid", "b", "cb"), "gid").where("ca < cb").select("a", "b")
    links = links.unionAll(verified(wide.unionAll(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "rest"))
    members = live.select("doc_id", *keys).join(classes.select(*keys, "cid"), keys)
    members = stored(members.select("doc_id", "n", "cid"), folder, "members")
    twice = members.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("hi")).where("a <> hi").select("doc_id", "a")
    links = links.unionAll(members.join(twice, "doc_id").select("a", F.col("cid").alias("b")))
    comps = components(links, folder, "components").withColumnRenamed("node", "cid")
    found = members.join(comps, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "cid").alias("component_id"))
    rest = stored(sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")), folder, "rest")
    for name in ("signatures", "shared", "comps", "placed", "open"):
        drop_path(spark, f"{folder}/{name}")
    return found.unionAll(rest)


def _salt(col: str):
    """The task of its token's that a row goes to."""
    return F.pmod(F.xxhash64(col), F.col("salts")).cast("int")


def _salted(rows: DataFrame, by_token: DataFrame) -> DataFrame:
    """``rows`` joined with the one row of their token (token, salts and more), a busy token's rows dealt over its tasks."""
    copies = by_token.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return rows.withColumn("salt", _salt("gid")).join(copies, ["token", "salt"]).drop("salt")


def _least_overlap(percent: int):
    """The overlap that sets of na and nb shingles need."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _least_shared(percent: int):
    """How many prefix shingles they have to share for that.

    Shared shingles outside both prefixes come after the end of the prefix that
    ends first, and that set has no more than its size less its prefix left.
    """
    left = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    return F.greatest(F.lit(1), _least_overlap(percent) - left)


def _single(shared: DataFrame, order, percent: int) -> DataFrame:
    """Each group (b) with the first one (a), by ``order``, of each of its shingles, if they share enough of them."""
    over = Window.partitionBy("token").orderBy("o", "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = shared.withColumn("o", order)
    head = F.struct("o", "gid", "n")
    calm = ordered.where("not busy").withColumn("h", F.first(head).over(over))
    busy = _salted(ordered.where("busy"), ordered.where("busy").groupBy("token", "salts").agg(F.min(head).alias("h")))
    names = [F.col("h.gid").alias("ga"), F.col("gid").alias("gb"), F.col("h.n").alias("na"), F.col("n").alias("nb")]
    pairs = calm.select(*names).unionAll(busy.select(*names))
    counted = pairs.where((F.col("ga") != F.col("gb")) & _near_in_size("na", "nb", percent)).groupBy("ga", "gb", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return counted.where(F.col("c") >= _least_shared(percent)).select(F.col("ga").alias("a"), F.col("gb").alias("b"))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) that no component holds both of."""
    a, b = joined.toDF("a", "ca"), joined.toDF("b", "cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that another of their component stands for.

    Of each component the smallest id stays; rows that repeat it all stay.  Null
    and empty texts and null ids link with nothing and stay.  All columns are
    kept, whatever their names; an empty table stays empty.  Only rows that a
    bitmap of the dropped ids lets through are shuffled, so most texts stay
    where they are.
    """
    spark = docs.sparkSession
    found = jaccard_join(docs, id_col, text_col, shingle, percent)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), work_dir(spark), "gone")
    maybe = router(spark, route_bitmap(gone, F.xxhash64("doc_id")))
    doc_id = F.col(id_col).cast("long")
    rows = keep_columns(docs, doc_id=doc_id, maybe=maybe(F.xxhash64(doc_id)))
    checked = rows.where("maybe").join(gone, "doc_id", "left_anti")
    return rows.where("not maybe").select("row.*").unionAll(checked.select("row.*"))

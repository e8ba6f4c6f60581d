"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

Targets are water-filled per source.  Sources are cut into shards and shards
into blocks of equally many words; blocks are seats, which Sainte-Lague divides
first among sources, then among a source's shards.  A seeded draw picks the
blocks of each shard's quota, and a document takes the words of it that lie in
picked blocks.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import keep_columns, stored, word_count, work_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
#: Words and documents in a shard, and the most shards that the driver's plan may list besides one a source.
SHARD_WORDS, SHARD_ROWS, MAX_SHARDS = 1 << 18, 1 << 16, 1 << 16
#: The longest block, and the most blocks over all shards.
BLOCK_WORDS, MAX_BLOCKS = 1024, 1 << 30
#: Rows of the plan up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def water_fill(sizes: list[int], weights: list[float], share: float = SHARE, repeat: float = MAX_REPEAT) -> list[float]:
    """Targets in proportion to the weights, none above ``repeat`` times its size.

    What a capped source can't take goes to the others by weight, again until
    none is above its cap.
    """
    target = [0.0] * len(sizes)
    left = share * sum(sizes)
    # Sources reach their caps in the order of cap over weight.
    open_ = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: (repeat * sizes[i] / weights[i], i))
    whole = sum(weights[i] for i in open_)
    for at, i in enumerate(open_):
        cap = float(repeat * sizes[i])
        if left * weights[i] / whole <= cap:
            for j in open_[at:]:
                target[j] = left * weights[j] / whole
            break
        target[i] = cap
        left -= cap
        whole -= weights[i]
    return target


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by the highest quotients w / (2 s + 1), none above its cap; ties go to the first."""
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(w > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    got = np.zeros(len(w), np.int64)
    if not seats:
        return got
    lo, hi = 0.0, float(w.sum()) * 4 + 1
    # The largest divisor d at which rounding w / d gives at most ``seats``; the
    # few seats left are then dealt one by one.
    lo = float(w[w > 0].min()) / (2.0 * seats + 2) / 4
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if int(np.minimum(np.floor(w / mid + 0.5), caps).sum()) > seats:
            lo = mid
        else:
            hi = mid
    # A little above that divisor no seat is dealt that ties with another by less than rounding errors.
    got = np.minimum(np.floor(w / (hi * (1 + 1e-9)) + 0.5), caps).astype(np.int64)
    queue = [(-w[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < caps)]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return got


def block_length(target: float, total: int) -> int:
    """Words of a source's blocks: a power of two, at most BLOCK_WORDS (more only past MAX_BLOCKS of them) and a 64th of the source's own target.

    So a small source has short blocks without making those of others short;
    sources with blocks of one length are apportioned together.
    """
    length = min(max(BLOCK_WORDS, -(-total // MAX_BLOCKS)), max(1, int(target // 64)))
    return 1 << (length.bit_length() - 1)


def draw_blocks(sizes: np.ndarray, quota: int, block: int, seed) -> np.ndarray:
    """Words that each of a shard's documents, laid end to end, gets from ``quota`` blocks."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(len(sizes), np.int64)
    n = -(-total // block)
    full, extra = divmod(quota, n)
    length = np.minimum(block, total - np.arange(n) * block)
    picked = np.zeros(n, bool)
    picked[np.random.default_rng(seed).permutation(n)[:extra]] = True
    before = np.concatenate([[0], np.cumsum(np.where(picked, length, 0))])

    def upto(at):
        b = at // block
        return before[b] + np.where(picked[np.minimum(b, n - 1)] & (b < n), at - b * block, 0)

    return full * sizes + upto(ends) - upto(ends - sizes)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def copies(wanted, sizes, repeat: int = MAX_REPEAT, carry: int = 0) -> tuple[list[int], int]:
    """How often each document stands, and the words still owed after the last one.

    Each takes the whole number of copies nearest to its own words and those
    that the ones before it owe, so copies times sizes miss the words wanted by
    about half of the last size.
    """
    out = []
    for t, s in zip(wanted, sizes):
        carry += t
        n = min(max((2 * carry + s) // (2 * s), 0), repeat)
        carry -= n * s
        out.append(n)
    return out, carry


def mix_sources(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken and source, one row per
    input row.  Null and empty texts have size 0 and are taken 0 words of; a
    null source is a source of its own that stands last; rows that repeat an id
    and null ids are rows like any others; columns other than the three named
    ones are not read; an empty table gives no rows.  The plan holds one row per
    source and at most MAX_SHARDS shards besides; blocks and documents stay on
    the executors.  Reruns give the same rows.
    """
    shards, take, empty = _shards(docs, seed, id_col, text_col, source_col, weights, share, repeat)
    kind = docs.select(id_col).dtypes[0][1]
    schema = "doc_id string, size long, source_size long, target double, taken long, source string"
    names = ["doc_id", "size", "source_size", "target", "taken", "source"]
    taken = shards.applyInPandas(lambda key, pdf: take(key, pdf)[names], schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    return taken.unionAll(empty.withColumn("taken", F.lit(0).cast("long")).select(*names))


def _shards(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weights, share: float, repeat: int):
    """The documents with words grouped by source and shard, the function that draws the words taken of a group, and the documents without words."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size")), work_dir(spark), "sized")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.when(F.col("size") > 0, 1)).alias("docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in rows], [int(r["n"]) for r in rows]
    total = sum(sizes)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, repeat)
    shard_words = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    shard_rows = max(SHARD_ROWS, -(-sum(r["docs"] for r in rows) // MAX_SHARDS))
    n_shards = [max(1, -(-s // shard_words), -(-r["docs"] // shard_rows)) for s, r in zip(sizes, rows)]
    lengths = [block_length(t, total) for t in targets]
    plan = spark.createDataFrame(
        [(i, n, s, float(t), k) for i, (n, s, t, k) in enumerate(zip(names, sizes, targets, n_shards))], "src int, source string, source_size long, target double, shards int"
    )
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")).cast("int")
    every = sized.join(_small(plan, len(names)), sized["source"].eqNullSafe(plan["source"])).select("doc_id", sized["source"], "size", "src", "source_size", "target", shard.alias("shard"))
    placed = every.where("size > 0")
    cells = placed.groupBy("src", "shard").agg(F.sum("size").alias("n")).collect()
    by_source: dict[int, list[tuple[int, int]]] = {}
    for r in cells:
        by_source.setdefault(r["src"], []).append((r["shard"], int(r["n"])))
    most = [repeat * sum(-(-n // length) for _, n in by_source.get(i, ())) for i, length in enumerate(lengths)]
    seats = np.array(most, np.int64)
    for length in sorted(set(lengths)):
        alike = [i for i, x in enumerate(lengths) if x == length]
        got = sainte_lague([targets[i] for i in alike], round(sum(targets[i] for i in alike) / length), [most[i] for i in alike])
        seats[alike] = np.where([targets[i] >= repeat * sizes[i] for i in alike], seats[alike], got)
    quotas = []
    for i, length in enumerate(lengths):
        own = sorted(by_source.get(i, ()))
        got = seats[i : i + 1] if len(own) == 1 else sainte_lague([n for _, n in own], int(seats[i]), [repeat * -(-n // length) for _, n in own])
        quotas += [(i, s, int(q), length) for (s, _), q in zip(own, got)]
    quota = spark.createDataFrame(quotas, "src int, shard int, quota long, block long")

    def take(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "doc_id", "size"], kind="stable")
        pdf["taken"] = draw_blocks(pdf["size"].to_numpy(), int(pdf["quota"].iloc[0]), int(pdf["block"].iloc[0]), [seed, int(key[0]), int(key[1])])
        return pdf

    # Ids go to pandas as text, which keeps long ones exact beside nulls.
    drawn = placed.join(_small(quota, len(quotas)), ["src", "shard"]).withColumn("o", F.xxhash64(F.lit(seed + 1), "doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    return drawn.groupBy("src", "shard"), take, every.where("size = 0")


def mixed_documents(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, so that each source has its target's words.

    A document stands taken over size times, rounded to a whole number; what
    rounding gives too much or too little is carried on to the next one, from
    the longest of a shard to its shortest.  The shortest of each shard are left
    open and dealt in the same way over the shards of a source, so a source
    misses the words taken by about half of its shards' shortest document,
    however long its documents are.  Null and empty texts go, as the mix takes no
    word of them.  Rows of a source that repeat an id and have equal sizes stand
    equally often, null ids too; a null source is one like any other.  All
    columns are kept, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    shards, take, _ = _shards(docs, seed, id_col, text_col, source_col, weights, share, repeat)
    kind = docs.select(id_col).dtypes[0][1]

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = take(key, pdf)
        got = got.groupby(["doc_id", "size"], dropna=False, sort=False).agg(o=("o", "first"), source=("source", "first"), rows=("size", "count"), taken=("taken", "sum")).reset_index()
        got = got.sort_values(["size", "o", "doc_id"], ascending=[False, True, True], kind="stable")
        each = (got["size"] * got["rows"]).tolist()
        times, owed = copies(got["taken"].tolist()[:-1], each[:-1], repeat)
        n = len(got)
        return pd.DataFrame(
            {
                "doc_id": [None if pd.isna(x) else str(x) for x in got["doc_id"]],
                "source": [None if pd.isna(x) else str(x) for x in got["source"]],
                "size": got["size"].astype("int64"),
                "src": int(key[0]),
                "shard": int(key[1]),
                "words": each,
                "times": pd.array([*times, None][:n], dtype="Int64"),
                "owed": pd.array([None] * (n - 1) + [owed + int(got["taken"].iloc[-1])], dtype="Int64"),
            }
        )

    folder = work_dir(spark)
    dealt = shards.applyInPandas(whole, "doc_id string, source string, size long, src int, shard int, words long, times long, owed long")
    dealt = stored(dealt.withColumn("doc_id", F.col("doc_id").cast(kind)), folder, "dealt")
    rows = dealt.where("times is null").select("src", "shard", "words", "owed").collect()
    rows.sort(key=lambda r: (r["src"], -r["words"], r["shard"]))
    last = []
    for _, own in itertools.groupby(rows, key=lambda r: r["src"]):
        own = list(own)
        times, _ = copies([r["owed"] for r in own], [r["words"] for r in own], repeat)
        last += [(r["src"], r["shard"], n) for r, n in zip(own, times)]
    plan = spark.createDataFrame(last, "src int, shard int, n long")
    ends = dealt.where("times is null").join(_small(plan, len(last)), ["src", "shard"]).select("doc_id", "source", "size", "n")
    took = dealt.where("times > 0").select("doc_id", "source", "size", F.col("times").alias("n")).unionAll(ends.where("n > 0"))
    d, t = keep_columns(docs, doc_id=F.col(id_col), source=F.col(source_col).cast("string"), size=word_count(F.coalesce(F.col(text_col), F.lit("")))), took
    same = d["doc_id"].eqNullSafe(t["doc_id"]) & d["source"].eqNullSafe(t["source"]) & (d["size"] == t["size"])
    return d.where("size > 0").join(t, same).select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")

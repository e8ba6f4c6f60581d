"""Embedding near-dedup by rotated binary codes (operator 10).

Equal vectors of a label are one class.  The classes of a label lie in tiles
around sampled pivots, each tile in two parts: close to its pivot and farther
off.  By the triangle inequality some pairs of parts hold no link and are never
met, in others every pair is a link and only the parts' totals are added (so a
large group of near copies isn't paired out).  Within any other pair of parts the sign codes of the randomly rotated
vectors give an unbiased estimate of each inner product (corrected by the
stored product of a vector and its code) with a confidence bound; only pairs
that the bound can't rule out are recomputed in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, stored, tidy, work_dir
from veilframe.llm.graph import components

THRESHOLD = 0.93
#: Standard errors that the bound allows an estimate to be too low by.
SIGMAS = 6.0
#: Vectors that a tile is meant to hold, and the most pivots over all labels.
TILE_ROWS, MAX_PIVOTS = 1024, 4096
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors and their correction factors."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def decode(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * (2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))


def estimates(turned: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of rotated vectors with coded ones."""
    return (turned @ signs.T) / factors[None, :].astype(np.float32)


def lowest(factors: np.ndarray, dim: int, threshold: float, sigmas: float = SIGMAS) -> np.ndarray:
    """The least estimate that a pair at the threshold gives, by coded vector, within the bound."""
    f2 = np.clip(factors * factors, 1e-9, 1)
    spread = np.sqrt((1 - f2) / f2 / max(dim - 1, 1)) * np.sqrt(max(0.0, 1 - threshold * threshold))
    return threshold - sigmas * spread - 1e-4


def links_between(a: np.ndarray, b: np.ndarray, codes_b: np.ndarray, factors_b: np.ndarray, threshold: float = THRESHOLD, step: int = 512):
    """Index pairs of rows of ``a`` and ``b`` with cosine of at least the threshold."""
    dim = a.shape[1]
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    turned = ((a / na[:, None]) @ rotation(dim)).astype(np.float32)
    signs, least = decode(codes_b, dim), lowest(factors_b, dim, threshold).astype(np.float32)
    left, right = [], []
    for at in range(0, len(a), step):
        i, j = np.nonzero(estimates(turned[at : at + step], signs, factors_b) >= least[None, :])
        for k in range(0, len(i), 1 << 17):
            x, y = i[k : k + (1 << 17)] + at, j[k : k + (1 << 17)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            left.append(x[ok])
            right.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def lowest_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs (i, j)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(np.float64)


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"], kind="stable").reset_index(drop=True)
        m, codes, factor = _matrix(pdf["embedding"]), np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]]), pdf["factor"].to_numpy()
        n, weight, first = len(pdf), pdf["n"].to_numpy(), int((pdf["side"] == 0).sum())
        if first == n:
            i, j = links_between(m, m, codes, factor, threshold)
            i, j = i[i != j], j[i != j]
            got = np.bincount(i, weight[j], minlength=n)
        else:
            i, j = links_between(m[:first], m[first:], codes[first:], factor[first:], threshold)
            j = j + first
            got = np.bincount(i, weight[j], minlength=n) + np.bincount(j, weight[i], minlength=n)
        order = np.argsort(pdf["cid"].to_numpy(), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        lab = lowest_labels(n, place[i], place[j])
        root = pdf["cid"].to_numpy()[order][lab][place]
        live = got > 0
        return pd.DataFrame({"cls": pdf["cls"][live], "links": got[live].astype(np.int64), "cid": pdf["cid"][live], "root": root[live]})

    return run


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Links of cosine >= threshold within a label and their components.

    Returns one row per input row: vec_id, n_links, component_id, kept.  A
    vector that is null, empty, zero or not finite, or whose label or id is
    null, links with nothing.  Vectors of other lengths never meet.  Rows that
    repeat an id count as vectors each, but share one node of the graph.  Other
    columns are not read, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    ok = F.coalesce(usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull(), F.lit(False))
    good = named.where(ok)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id()), folder, "classes")

    tile_rows = max(TILE_ROWS, -(-classes.count() // MAX_PIVOTS))
    big = classes.groupBy("label", "dim").count().where(F.col("count") > 2 * tile_rows)
    wanted = big.select("label", "dim", F.ceil(F.col("count") / tile_rows).alias("k"), F.col("count").alias("of")).collect()
    pivots: dict = {}
    if wanted:
        ks = spark.createDataFrame(wanted, big.select("label", "dim", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("of")).schema)
        # Hashes below a threshold that about k + 4 classes of a label pass: no task ranks a label's classes.
        place = F.xxhash64("cid") / F.lit(2.0**64) + 0.5
        drawn = classes.join(F.broadcast(ks), ["label", "dim"]).where(place <= (F.col("k") + 4) / F.col("of"))
        for r in drawn.select("label", "dim", "embedding").collect():
            pivots.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    for k, v in pivots.items():
        m = np.array(sorted(v), np.float64)
        pivots[k] = m / np.linalg.norm(m, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast(pivots)
    label_type = dict(classes.dtypes)["label"]

    def place(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            tile, angle = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            code, factor = np.empty(len(pdf), object), np.zeros(len(pdf))
            for key, own in pdf.groupby(["label", "dim"]):
                at = own.index.to_numpy()
                m = _matrix(own["embedding"])
                unit = m / np.linalg.norm(m, axis=1, keepdims=True)
                bits, factor[at] = encode(unit, rotation(int(key[1])))
                code[at] = [b.tobytes() for b in bits]
                centres = sent.value.get((key[0], int(key[1])))
                if centres is not None:
                    cos = unit @ centres.T
                    tile[at] = cos.argmax(1)
                    angle[at] = np.arccos(np.clip(cos.max(1), -1, 1))
            yield pdf.assign(tile=tile, angle=angle, code=code, factor=factor)

    placed = stored(classes.mapInPandas(tidy(place), f"label {label_type}, embedding {dict(classes.dtypes)['embedding']}, cid {dict(classes.dtypes)['cid']}, n long, dim int, cls long, tile int, angle double, code binary, factor double"), folder, "placed")
    out = f"cls long, links long, cid {dict(classes.dtypes)['cid']}, root {dict(classes.dtypes)['cid']}"
    columns = ["label", "dim", "pair", "side", "cid", "cls", "n", "embedding", "code", "factor"]
    if not pivots:
        met, sure = placed.withColumn("pair", F.lit(-1).cast("long")).withColumn("side", F.lit(0)).select(*columns), None
    else:
        reach = float(np.arccos(threshold))
        placed = placed.withColumn("core", (F.col("angle") <= reach / 2 - 1e-6).cast("int"))
        subs, met_by, sure = _tile_pairs(spark, placed, big.select("label", "dim"), pivots, TILE_ROWS, reach, folder)
        cut = placed.join(F.broadcast(subs), ["label", "dim", "tile", "core"], "left").withColumn("piece", F.coalesce(F.col("first") + F.pmod(F.xxhash64("cid"), F.col("subs")), F.lit(-1).cast("long")))
        small = cut.where("piece < 0").withColumn("pair", F.lit(-1).cast("long")).withColumn("side", F.lit(0)).select(*columns)
        met = small.unionAll(cut.where("piece >= 0").join(met_by, "piece").select(*columns))
        sure = cut.where("piece >= 0").join(F.broadcast(sure), "part").select("cls", (F.col("weight") - F.when(F.col("self"), F.col("n")).otherwise(0)).alias("links"), "cid", "root")
    found = met.groupBy("label", "dim", "pair").applyInPandas(_compare(threshold), out)
    found = stored(found if sure is None else found.unionAll(sure), folder, "found")
    comps = components(found.select("cid", "root"), folder)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = stored(classes.select("label", "embedding", "cid", "cls", "n").join(links, "cls", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left"), folder, "of_class")
    linked = good.join(of_class, ["label", "embedding"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "cid").alias("component_id"))
    rest = named.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tile_pairs(spark, placed, big, pivots, tile_rows, reach, folder):
    """(number and pieces of each part, the pairs of pieces to meet that each piece is a side of, totals of surely linked parts).

    The driver lists the parts, at most about four times MAX_PIVOTS.  Pairs of
    them, which can be many more, are made on the executors: a task compares
    some parts with all parts of their label.
    """
    stats = placed.join(F.broadcast(big), ["label", "dim"]).groupBy("label", "dim", "tile", "core").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("w"), F.max("angle").alias("r"), F.min("cid").alias("lo")).collect()
    order = {key: i for i, key in enumerate(pivots)}
    stats.sort(key=lambda s: (order[s["label"], s["dim"]], s["tile"], s["core"]))
    pieces = np.array([-(-s["rows"] // (2 * tile_rows)) for s in stats], np.int64)
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    parts = [(s["label"], s["dim"], s["tile"], s["core"], i, int(f), int(p)) for i, (s, f, p) in enumerate(zip(stats, first, pieces))]
    group = np.array([order[s["label"], s["dim"]] for s in stats])
    every = {
        "group": group,
        "tile": np.array([s["tile"] for s in stats]),
        "radius": np.array([s["r"] for s in stats]),
        "weight": np.array([s["w"] for s in stats], np.int64),
        "least": np.array([s["lo"] for s in stats]),
        "pivots": list(pivots.values()),
    }
    sent = spark.sparkContext.broadcast(every)

    def near(i: int):
        """Parts of part i's label that may link with it, and which of them surely do."""
        e = sent.value
        own = np.flatnonzero(e["group"] == e["group"][i])
        centres, t = e["pivots"][e["group"][i]], e["tile"][own]
        apart = np.arccos(np.clip(centres[t] @ centres[e["tile"][i]], -1, 1))
        apart[t == e["tile"][i]] = 0
        far = e["radius"][i] + e["radius"][own]
        close = apart <= far + reach + 1e-9
        return own[close], (apart + far <= reach - 1e-6)[close]

    def pairs(batches):
        for pdf in batches:
            for i in pdf["id"].tolist():
                own, linked = near(i)
                own = own[(own >= i) & ~linked]
                if not len(own):
                    continue
                right = np.concatenate([first[j] + np.arange(pieces[j]) for j in own])
                for left in range(int(first[i]), int(first[i] + pieces[i])):
                    to = right[right >= left]
                    number = left * total + to
                    other = to != left
                    yield pd.DataFrame({"piece": np.concatenate([np.full(len(to), left), to[other]]), "pair": np.concatenate([number, number[other]]), "side": np.concatenate([np.zeros(len(to), np.int32), np.ones(int(other.sum()), np.int32)])})

    def totals(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                own, linked = near(i)
                own = own[linked]
                if len(own):
                    rows.append((i, int(sent.value["weight"][own].sum()), bool((own == i).any()), sent.value["least"][own].min()))
            yield pd.DataFrame(rows, columns=["part", "weight", "self", "root"])

    kinds = dict(placed.dtypes)
    numbers = spark.range(0, len(stats), 1, max(1, min(len(stats) // 8, 4 * spark.sparkContext.defaultParallelism)))
    return (
        spark.createDataFrame(parts, f"label {kinds['label']}, dim int, tile int, core int, part long, first long, subs long"),
        stored(numbers.mapInPandas(pairs, "piece long, pair long, side int"), folder, "pairs"),
        stored(numbers.mapInPandas(totals, f"part long, weight long, self boolean, root {kinds['cid']}"), folder, "sure"),
    )

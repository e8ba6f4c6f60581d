"""Quality classifier by supervised subword embeddings (operator 3).

A text is the average of learned vectors of its hashed words and character
n-grams; a softmax layer over that average is trained together with the vectors
by stochastic gradient descent.  As the layer is linear in the average, scoring
folds it into the vectors: one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import crc_mod, let_go, sample_by_label, small_batches
from veilframe.llm.textvec import PLACES, code_points, mixed, pieces, prior_shift, word_hashes

BITS, DIM, ORDERS = 17, 16, (2, 3, 4)
#: What a word counts in the average, beside a character n-gram's 1.
WORD_WEIGHT = 6.0
PER_CLASS, MAX_CHARS = 3000, 20000
THRESHOLD = 0.3


def grams(texts, bits: int = BITS):
    """Yields (document numbers, buckets, weight): character n-grams, then words.

    A word that repeats the one before it also gives a mark common to all words.
    """
    longest = max(ORDERS)
    shift = np.uint64(64 - bits)
    for held in pieces(texts, longest - 1):
        codes = [code_points(p) for _, _, p in held]
        sizes = np.array([len(c) for c in codes], np.int64)
        c = np.concatenate(codes).astype(np.uint64)
        piece = np.repeat(np.arange(len(held)), sizes)
        doc = np.array([i for i, _, _ in held], np.int64)
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(c)) - starts[piece]
        lead = np.array([s for _, s, _ in held], np.int64)[piece]
        owner = doc[piece]
        h = c * PLACES[0]
        for order in range(2, longest + 1):
            if len(c) < order:
                break
            h = h[1:] + c[: -(order - 1)] * PLACES[order - 1]
            if order in ORDERS:
                ok = (inside[order - 1 :] >= order - 1) & (inside[order - 1 :] >= lead[order - 1 :])
                yield owner[order - 1 :][ok], (mixed(h)[ok] >> shift).astype(np.int64), 1.0
    held, n = [], 0
    for i, text in enumerate(texts):
        w = text.split()
        held.append((i, w))
        n += len(w)
        if n > 1 << 18:
            yield _words(held, shift)
            held, n = [], 0
    if held:
        yield _words(held, shift)


def _words(held, shift):
    doc = np.repeat(np.array([i for i, _ in held], np.int64), [len(w) for _, w in held])
    h = word_hashes([x for _, w in held for x in w])
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    mark = np.full(int(again.sum()), mixed(word_hashes(["<again>"]))[0])
    return np.concatenate([doc, doc[1:][again]]), (mixed(np.concatenate([h, mark])) >> shift).astype(np.int64), WORD_WEIGHT


@dataclass(frozen=True)
class Embeddings:
    """Bucket vectors, softmax layer and bias of the two classes."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> np.ndarray:
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)


def train(texts: list[str], labels: list[int], bits: int = BITS, dim: int = DIM, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Embeddings:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    own = []
    for text in texts:
        got = list(grams([text], bits))
        u, inverse = np.unique(np.concatenate([b for _, b, _ in got] or [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.full(len(b), w) for _, b, w in got] or [np.zeros(0)]), minlength=len(u))
        own.append((u, (n / max(n.sum(), 1)).astype(np.float32)))
    order, step, steps = np.arange(len(texts)), 0, epochs * max(len(texts), 1)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            u, share = own[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[u] if len(u) else np.zeros(dim, np.float32)
            logit = layer @ hidden + bias
            e = np.exp(logit - logit.max())
            g = e / e.sum()
            g[labels[i]] -= 1
            back = g @ layer
            layer -= lr * np.outer(g, hidden)
            bias -= lr * 0.1 * g
            # The share of a bucket in a text is small; a rate for it that grows with the text's variety keeps rare buckets learning.
            vectors[u] -= lr * len(u) ** 0.5 * share[:, None] * back[None, :]
    return Embeddings(vectors, layer, bias)


def scores(texts: list[str], folded: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for doc, bucket, weight in grams(texts, bits):
        total += weight * np.bincount(doc, folded[bucket], minlength=len(texts))
        n += weight * np.bincount(doc, minlength=len(texts))
    logit = total / np.maximum(n, 1) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, float]:
    """Folded vectors and bias of a model of at most ``per_class`` rows of each class.

    With labels of one class alone every text scores about that class, without
    any label one half.
    """
    allowed = F.lit(True) if allowed is None else allowed
    texts, y = sample_by_label(docs, labels, label, allowed, per_class, max_chars)
    if not any(y) or all(y):
        return np.zeros(1 << BITS, np.float32), 30.0 if any(y) else -30.0 if y else 0.0
    population = {r[label]: r["count"] for r in labels.where(allowed & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    model = train(texts, y)
    return model.folded(), float(model.bias[1] - model.bias[0]) + prior_shift(population, y)


def quality(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``score`` (0 to 1, higher is better) and ``predicted`` for every row's id.

    Null and empty texts have no vectors and score by the bias alone; repeated
    ids give repeated rows; other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(fit(named, labels, allowed))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        folded, bias = sent.value
        for s in batches:
            yield pd.Series(scores(s.fillna("").tolist(), folded, bias), dtype="float64")
        let_go()

    return named.select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return quality(docs, labels, crc_mod("doc_id", 5) != 0).select("doc_id", held.alias("held_out"), "score", "predicted")

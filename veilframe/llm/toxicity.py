"""Toxicity by FTRL-proximal logistic regression (operator 9).

Features are hashed words, word pairs and skip pairs (one or two words left
out), each present or absent in a text.  Per-coordinate rates and an L1 penalty
leave few weights other than zero, which are broadcast as one sparse pair of
arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import crc_mod, keep_columns, let_go, sample_by_label, small_batches
from veilframe.llm.textvec import PLACES, mixed, prior_shift, slices, word_hashes

WORD = re.compile(r"[^\W_]+")
BITS = 20
#: Bound of the training sample: rows of either class, and their longest text.
PER_CLASS, MAX_CHARS = 6000, 20000
THRESHOLD = 0.3


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, feature buckets) of the texts' words and pairs, repeats included."""
    counts, parts, held = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        for part in slices(text):
            words = WORD.findall(part.lower())
            counts[i] += len(words)
            held += words
            if len(held) > 1 << 17:
                parts.append(word_hashes(held))
                held = []
    h = np.concatenate([*parts, word_hashes(held)])
    doc = np.repeat(np.arange(len(texts)), counts)
    grams, docs = [h], [doc]
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        grams.append(mixed(h[:-gap] * PLACES[0] + h[gap:] * PLACES[gap])[same] if len(same) else np.zeros(0, np.uint64))
        docs.append(doc[:-gap][same] if len(same) else np.zeros(0, np.int64))
    return np.concatenate(docs), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class SparseLogit:
    """Buckets with a weight other than zero, in order, their weights, the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.weights
        return out


def _drained(items: list):
    """The items in order, each let go as soon as it is used."""
    items.reverse()
    while items:
        yield items.pop()


def train(texts, labels: list[int], bits: int = BITS, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, seed: int = 7) -> SparseLogit:
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    own = []
    for text in texts:
        own.append(np.unique(features([text], bits)[1]).astype(np.int32))
    order = np.arange(len(own))
    rng = np.random.default_rng(seed)
    w0 = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            at = own[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha)
    w = weights(z, n)
    live = np.flatnonzero(w)
    return SparseLogit(live, w[live].astype(np.float32), float(w0), bits)


def scores(texts: list[str], model: SparseLogit, dense: np.ndarray) -> np.ndarray:
    doc, bucket = features(texts, model.bits)
    live = dense[bucket] != 0
    cell = np.unique((doc[live] << model.bits) | bucket[live])
    logit = np.bincount(cell >> model.bits, dense[cell & ((1 << model.bits) - 1)], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> SparseLogit:
    """A model of at most ``per_class`` rows of each class, none longer than ``max_chars``.

    Without any usable label, or with labels 0 alone, the model is empty and
    scores everything about 0; with labels 1 alone about 1.
    """
    allowed = F.lit(True) if allowed is None else allowed
    texts, y = sample_by_label(docs, labels, label, allowed, per_class, max_chars)
    if not any(y) or all(y):
        return SparseLogit(np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if any(y) else -30.0)
    population = {r[label]: r["count"] for r in labels.where(allowed & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    got = train(_drained(texts), y)
    return SparseLogit(got.buckets, got.weights, got.bias + prior_shift(population, y), got.bits)


def scorer(spark, model: SparseLogit):
    """A Pandas UDF from a text column to scores; null texts count as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        dense = m.dense()
        for s in batches:
            out, held, n, parts = [], [], 0, s.fillna("").tolist()
            for text in parts:
                held.append(text)
                n += len(text)
                if n > 1 << 20:
                    out.append(scores(held, m, dense))
                    held, n = [], 0
            if held:
                out.append(scores(held, m, dense))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")
        let_go()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row's id.

    Null and empty texts get the score of a text without words; repeated ids
    give repeated rows; other columns are neither read nor returned.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(docs.sparkSession, fit(named, labels, allowed))
    return named.select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return toxicity(docs, labels, crc_mod("doc_id", 4) != 2).select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names.

    Null and empty texts score by the bias alone, very long ones as a whole;
    rows that repeat an id are scored each by its own text, null ids too; an
    empty table stays empty.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(docs.sparkSession, fit(named, labels, allowed))
    return keep_columns(docs, score=score(F.col(text_col))).where(F.col("score") < threshold).select("row.*")

"""Language ID by interpolated Kneser-Ney character models (operator 2).

One model per language, up to ORDER characters.  A model keeps, for each order,
the sorted hashes of its n-grams with their discounted shares and the sorted
hashes of its contexts with their back-off weights; a probability is found by
binary search.  The language with the lowest cross-entropy per character wins.
A language rejects a text whose cross-entropy lies above what held-back
training texts of that language reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import crc_mod, let_go, small_batches, stored, work_dir
from veilframe.llm.textvec import PLACES, code_points, pieces

ORDER = 4
#: Bound of the training sample: texts of each language, and their longest text.
PER_LANG, MAX_CHARS = 300, 20000
#: Texts of all languages together (each has one at least), and the languages that are learned, those with most texts first.
SAMPLE_TEXTS, MAX_LANGS = 30000, 2000
#: One text in so many is held back for the rejection thresholds.
HOLD_BACK = 5
UNKNOWN = "und"
#: Numbers in the per-worker table of probabilities looked up before, and its most slots.
TABLE, SLOTS = 1 << 22, 1 << 18
ALPHABET = 1 << 16


def sequences(texts, order: int = ORDER):
    """Yields (document numbers, codes, hashes by order 1.., counted) for batches of texts.

    Codes are lower-cased characters after ``order - 1`` start marks; counted
    marks the places that are characters of the text itself.
    """
    for held in pieces((t.lower() for t in texts), order - 1):
        parts, owner, counted = [], [], []
        for i, lead, piece in held:
            c = code_points(piece)
            pad = 0 if lead else order - 1
            parts.append(np.concatenate([np.full(pad, 2, np.uint32), c]) if pad else c)
            owner.append(np.full(len(parts[-1]), i))
            counted.append(np.arange(len(parts[-1])) >= order - 1)
        codes = np.concatenate(parts).astype(np.uint64)
        hashes = [codes * PLACES[0]]
        for k in range(1, order):
            h = hashes[-1].copy()
            h[k:] += (codes[:-k] + np.uint64(1)) * PLACES[k]
            hashes.append(h)
        yield np.concatenate(owner), codes, hashes, np.concatenate(counted)


@dataclass(frozen=True)
class KneserNey:
    """Sorted hash arrays of one language: per order (grams, shares, contexts, back-off weights)."""

    levels: tuple
    floor: float

    def probability(self, codes: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(codes), self.floor)
        for h, (grams, shares, contexts, backoff) in zip(hashes, self.levels):
            p = _found(grams, shares, h, 0.0) + _found(contexts, backoff, h - codes * PLACES[0], 1.0) * p
        return p


def _found(keys, values, wanted, default):
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def train(texts: list[str], order: int = ORDER) -> KneserNey:
    gathered: list[list] = [[] for _ in range(order)]
    codes = []
    for _, c, hashes, counted in sequences(texts, order):
        codes.append(c[counted])
        for k in range(order):
            gathered[k].append(hashes[k][counted])
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    hashes = [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in gathered]
    levels = []
    for k in range(order):
        h = hashes[k]
        if k == order - 1:
            grams, first, counts = np.unique(h, return_index=True, return_counts=True)
        else:
            # Below the highest order an n-gram counts the different characters before it.
            _, longer = np.unique(hashes[k + 1], return_index=True)
            grams, inside, counts = np.unique(h[longer], return_index=True, return_counts=True)
            first = longer[inside]
        contexts, which = np.unique(grams - c[first] * PLACES[0], return_inverse=True)
        whole = np.bincount(which, counts, minlength=len(contexts)).astype(float)
        kinds = np.bincount(which, minlength=len(contexts))
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        shares = (counts - discount) / whole[which] if len(grams) else np.zeros(0)
        levels.append((grams, np.maximum(shares, 0), contexts, discount * kinds / np.maximum(whole, 1)))
    return KneserNey(tuple(levels), 1.0 / ALPHABET)


class Scorer:
    """Cross-entropies per character of texts under every language.

    Probabilities found before stay in a table of fixed size, filled as texts
    come; others are searched in the models' sorted arrays.
    """

    def __init__(self, models: list[KneserNey], order: int = ORDER):
        self.models, self.order = models, order
        self.slots = 1 << (min(SLOTS, max(1024, TABLE // max(1, len(models)))).bit_length() - 1)
        self.keys = np.zeros(self.slots, np.uint64)
        self.rows = np.zeros((self.slots, len(models)), np.float32)
        self.used = np.zeros(self.slots, bool)

    def _logs(self, codes, hashes) -> np.ndarray:
        top = hashes[-1]
        slot = (top >> np.uint64(40)).astype(np.int64) & (self.slots - 1)
        hit = self.used[slot] & (self.keys[slot] == top)
        out = self.rows[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, first, inverse = np.unique(top[miss], return_index=True, return_inverse=True)
            at = miss[first]
            fresh = np.stack([-np.log(m.probability(codes[at], [h[at] for h in hashes])) for m in self.models], 1).astype(np.float32)
            out[miss] = fresh[inverse]
            self.keys[slot[at]], self.rows[slot[at]], self.used[slot[at]] = top[at], fresh, True
            # Two new n-grams may share a slot; only the last one's pair is kept whole.
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        total, n = np.zeros((len(texts), len(self.models))), np.zeros(len(texts))
        for owner, codes, hashes, counted in sequences(texts, self.order):
            if not counted.any():
                continue
            owner = owner[counted]
            logs = self._logs(codes[counted], [h[counted] for h in hashes])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            np.add.at(total, owner[starts], np.add.reduceat(logs.astype(np.float64), starts, axis=0))
            n += np.bincount(owner, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None], n


@dataclass(frozen=True)
class LanguageId:
    names: tuple
    models: tuple
    limits: np.ndarray

    def predict(self, texts, scorer: Scorer) -> pd.DataFrame:
        known = [t is not None and any(ch.isalpha() for ch in t) for t in texts]
        if not self.names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "entropy": np.nan, "rejected": True})
        ce, n = scorer.entropies([t or "" for t in texts])
        best = ce.argmin(1) if len(texts) else np.zeros(0, np.int64)
        low = ce[np.arange(len(texts)), best]
        odds = np.exp(-np.minimum(n, 40)[:, None] * (ce - low[:, None]))
        score = 1 / odds.sum(1)
        known = np.array(known, bool)
        return pd.DataFrame(
            {
                "lang_pred": np.where(known, np.array(self.names, dtype=object)[best], UNKNOWN),
                "score": np.where(known, score, 0.0),
                "entropy": np.where(known, low, np.nan),
                "rejected": ~known | (low > self.limits[best]),
            }
        )


def fit(docs: DataFrame, allowed: Column | None = None, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> LanguageId:
    """Models from at most ``per_lang`` texts of each language, none longer than ``max_chars``.

    A language that has fewer such texts learns from the first ``max_chars``
    characters of longer ones besides.  Where there are many languages each has
    fewer, SAMPLE_TEXTS together; past MAX_LANGS tags those with the fewest
    texts are taken for junk, so that what the driver and the models hold stays
    bounded.  Ids are drawn first, by a hash: those below a threshold that lets
    about four times as many through as are wanted, so that no task ranks all of
    a language.  Of rows that repeat an id one is taken, that whose text hashes
    lowest.
    """
    allowed = F.lit(True) if allowed is None else allowed
    long = F.length("text") > max_chars
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    known = stored(usable.groupBy("lang", "doc_id").agg(F.min(long).alias("long")), work_dir(docs.sparkSession), "ids")
    kinds = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("long"), 1)).alias("short")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    per_lang = max(1, min(per_lang, SAMPLE_TEXTS // max(1, len(kinds))))
    share = [(r["lang"], kind, min(1.0, 4 * per_lang / n)) for r in kinds for kind, n in ((False, r["short"]), (True, r["n"] - r["short"] if r["short"] < per_lang else 0)) if n]
    shares = docs.sparkSession.createDataFrame(share, "lang string, long boolean, share double")
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    ids = known.join(F.broadcast(shares), ["lang", "long"]).where(place <= F.col("share")).withColumn("r", rank).where(F.col("r") <= per_lang).select("doc_id", "lang", "long")
    texts = docs.where(F.length("text") > 0).select("doc_id", "lang", F.substring("text", 1, max_chars).alias("text"), long.alias("long"))
    drawn = texts.join(F.broadcast(ids), ["doc_id", "lang", "long"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"))
    rows = sorted((r["lang"], r["doc_id"], r["t"]["text"]) for r in drawn.collect())
    names = sorted({r[0] for r in rows})
    by = {name: [t for lang, _, t in rows if lang == name] for name in names}
    train_on = {k: [t for i, t in enumerate(v) if len(v) < HOLD_BACK or i % HOLD_BACK] for k, v in by.items()}
    models = tuple(train(train_on[k]) for k in names)
    limits = np.full(len(names), np.inf)
    scorer = Scorer(list(models))
    for i, k in enumerate(names):
        back = by[k][::HOLD_BACK] if len(by[k]) >= HOLD_BACK else by[k]
        ce = scorer.entropies(back)[0][:, i]
        limits[i] = ce.mean() + 4 * ce.std() + 0.25
    return LanguageId(tuple(names), models, limits)


def language_id(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every row.

    Null texts and texts without a letter get ``und``, score 0 and rejected; so
    does everything if there is nothing to learn from.  Any other text gets a
    learned language, of equally good ones the first by name; rejected says that
    its cross-entropy is above that language's calibrated limit.  Very long texts
    are scored as a whole.  Repeated ids give repeated rows, null ids too; other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sent = spark.sparkContext.broadcast(fit(named, allowed))

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        scorer = Scorer(list(model.models))
        for s in batches:
            yield model.predict([None if x is None else x for x in s.tolist()], scorer)
        let_go()

    return named.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


def language_query(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return language_id(docs, crc_mod("doc_id", 4) != 2).select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")

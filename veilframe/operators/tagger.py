"""A tagger of personal data: averaged structured perceptron over hashed features.

Training mixes parameters: in each round every shard of windows starts from the
mixed weights and updates them window by window, Spark averages the shards'
weights and the driver holds one model, whose size its parameters bound.
Decoding is a Viterbi search that BIO order constrains, many windows at once;
a token's confidence is its tag's marginal.  Overlapping windows are stitched
token by token by confidence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.spans import START
from veilframe.sources.folders import work_folder, written

#: Tokens of a window, and how many of them it shares with the next one.
SIZE, SHARED = 96, 24
#: Windows decoded at a time, and those that a task cuts before it hands them on.
TOGETHER, CUT_TOGETHER = 256, 1024
#: Bytes of texts that one Arrow batch may hold (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Hashed features as a power of two, rounds of training, and the most windows that it draws (by a hash; half of them without a mention).
BITS, ROUNDS, MOST_WINDOWS = 16, 8, 50_000
#: Windows that a shard has at least, as mixed weights of few windows each learn slowly.
SHARD_WINDOWS = 500
MENTIONS = "array<struct<start_offset:int,end_offset:int,entity_type:string>>"
SPANS = "array<struct<start_offset:int,end_offset:int,entity_type:string,confidence:double>>"
NEVER = -1e9

TOKEN = re.compile(r"[^\W_]+|\S")


def tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words and single marks of a text, with their borders."""
    words = TOKEN.findall(text)
    size = np.fromiter(map(len, words), np.int64, len(words))
    blank = np.fromiter(map(len, TOKEN.split(text)), np.int64, len(words) + 1)
    ends = np.cumsum(size + blank[:-1])
    return words, ends - size, ends


def _form(token: str) -> str:
    """What a token looks like: kinds of characters in runs, and its length where it has digits."""
    kinds = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:64])
    short = re.sub(r"(.)\1+", r"\1", kinds)
    if "d" not in kinds:
        return short
    hexadecimal = len(token) >= 16 and re.fullmatch(r"[0-9a-f]+", token) is not None
    return f"hex{len(token)}" if hexadecimal and "x" in kinds else f"{short[:6]}{len(token)}"


class _Hashes(dict):
    """The hash of each token's word, above that of its form; so many are remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = zlib.crc32(token.lower().encode()) << 32 | zlib.crc32(("=" + _form(token)).encode())
        if len(token) <= 64:
            self[token] = got
        return got


class Features:
    """Hashed features of tokens; hashes of a token's form and word are remembered."""

    def __init__(self, bits: int):
        self.mask, self.known = np.uint64((1 << bits) - 1), _Hashes()

    def __call__(self, words: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of feature numbers for each token."""
        n = len(words)
        both = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        pair = np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)], 1)
        glued = np.zeros(n + 1, np.uint64)
        glued[1:n] = (starts[1:] == ends[:-1])[: max(0, n - 1)]
        around = np.concatenate([np.full((3, 2), 7, np.uint64), pair, np.full((3, 2), 7, np.uint64)])
        at = lambda k, c: around[3 + k : 3 + k + n, c]
        own = glued[:n] * np.uint64(2) + glued[1:]
        columns = [at(0, 0), at(0, 1), at(0, 1) ^ own, at(-1, 0), at(1, 0), at(-2, 1), at(-1, 1), at(1, 1), at(2, 1), at(-1, 1) * np.uint64(3) + at(0, 1) * np.uint64(5) + own, at(1, 1) * np.uint64(3) + at(0, 1) * np.uint64(5) + own, at(-2, 0) * np.uint64(3) + at(-1, 0), at(1, 0) * np.uint64(3) + at(2, 1), at(-3, 1) + at(-1, 1) * np.uint64(9), own]
        out = np.empty((n, len(columns)), np.int64)
        for i, c in enumerate(columns):
            mixed = (c + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, i] = ((mixed >> np.uint64(29)) & self.mask).astype(np.int64)
        return out


def allowed(kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start, step): 0 where BIO order lets a tag stand, a prohibitive score elsewhere; tags are O, B-k, I-k, ..."""
    t = 1 + 2 * len(kinds)
    start, step = np.zeros(t), np.zeros((t, t))
    for k in range(len(kinds)):
        inside = 2 + 2 * k
        start[inside] = NEVER
        step[[i for i in range(t) if i not in (inside - 1, inside)], inside] = NEVER
    return start, step


def viterbi(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of a batch (windows, tokens, tags); of equally good ones the first."""
    b, n, t = scores.shape
    best, back = scores[:, 0] + start, np.zeros((b, n, t), np.int16)
    for i in range(1, n):
        ways = best[:, :, None] + step
        back[:, i] = ways.argmax(1)
        now = ways.max(1) + scores[:, i]
        best = np.where((i < lengths)[:, None], now, best)
    out = np.zeros((b, n), np.int64)
    tag = best.argmax(1)
    for i in range(n - 1, -1, -1):
        live = i < lengths
        out[live, i] = tag[live]
        tag = np.where(live & (i > 0), back[np.arange(b), i, tag], tag)
    return out


def may_leave(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Windows whose best tags may be others than O: a token's best other tag, with the best step to it and away, isn't below O."""
    if scores.shape[2] == 1:
        return np.zeros(len(scores), bool)
    enter, leave = (step - step[0, 0]).max(0)[1:], max(0.0, float((step[1:, 0] - step[0, 0]).max()))
    reach = scores[:, :, 1:] + enter
    reach[:, 0] = scores[:, 0, 1:] + start[1:]
    live = np.arange(scores.shape[1]) < lengths[:, None]
    return (live & (reach.max(2) + leave - scores[:, :, 0] > -1e-6)).any(1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The probability of each tag of each token under all ways through a window."""
    b, n, t = scores.shape
    ahead, behind = np.zeros((b, n, t)), np.zeros((b, n, t))
    ahead[:, 0] = scores[:, 0] + start
    for i in range(1, n):
        ahead[:, i] = _logsum(ahead[:, i - 1, :, None] + step, 1) + scores[:, i]
    for i in range(n - 2, -1, -1):
        after = _logsum(step[None] + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where((i + 1 < lengths)[:, None], after, 0.0)
    both = ahead + behind
    return np.exp(both - _logsum(both, 2)[:, :, None])


@dataclass(frozen=True)
class Tagger:
    """A trained model: kinds of mentions, weights by feature and tag, weights of steps, and the scale that calibrates marginals."""

    kinds: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray
    scale: float = 1.0

    @property
    def bits(self) -> int:
        return self.weights.shape[0].bit_length() - 1

    def _scores(self, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, lengths) of windows, filled up to the longest one."""
        lengths = np.array([len(w) for w in part])
        scores = np.zeros((len(part), int(lengths.max()), self.weights.shape[1]))
        for i, w in enumerate(part):
            scores[i, : len(w)] = self.weights[w].sum(1)
        return scores, lengths

    def decode(self, windows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tags, confidences) of each window's feature rows, windows of a text in order.

        Windows in which no tag can make up for leaving O aren't searched, and
        confidences are 1 where neither a window nor the ones beside it hold a
        mention, as nothing depends on them there.
        """
        start, step = allowed(self.kinds)
        step = step + self.steps
        tags: list[np.ndarray] = []
        for at in range(0, len(windows), TOGETHER):
            scores, lengths = self._scores(windows[at : at + TOGETHER])
            some = np.flatnonzero(may_leave(scores, lengths, start, step))
            told = np.zeros(scores.shape[:2], np.int64)
            if len(some):
                told[some] = viterbi(scores[some], lengths[some], start, step)
            tags += [told[i, :n] for i, n in enumerate(lengths)]
        hold = np.zeros(len(windows) + 2, bool)
        hold[1:-1] = [t.any() for t in tags]
        sure = [np.ones(len(t)) for t in tags]
        near = np.flatnonzero(hold[:-2] | hold[1:-1] | hold[2:])
        start, step = allowed(self.kinds)
        step = step + self.steps * self.scale
        for at in range(0, len(near), TOGETHER):
            part = near[at : at + TOGETHER]
            scores, lengths = self._scores([windows[i] for i in part])
            p = marginals(scores * self.scale, lengths, start, step)
            for k, i in enumerate(part):
                sure[i] = np.take_along_axis(p[k, : lengths[k]], tags[i][:, None], 1)[:, 0]
        return list(zip(tags, sure))


def cut(n: int, size: int = SIZE, shared: int = SHARED) -> list[tuple[int, int]]:
    """Borders of the windows of ``n`` tokens."""
    out, at = [], 0
    while n:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            break
        at += size - shared
    return out


def stitch(n: int, borders: list[tuple[int, int]], decoded: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tags and confidences of a text: where windows overlap the more confident one's, of equal ones the first's."""
    tags, sure = np.zeros(n, np.int64), np.full(n, -1.0)
    for (a, b), (t, c) in zip(borders, decoded):
        better = c > sure[a:b]
        tags[a:b] = np.where(better, t, tags[a:b])
        sure[a:b] = np.where(better, c, sure[a:b])
    return tags, sure


def runs(tags: np.ndarray, sure: np.ndarray, least: float = START) -> list[tuple[int, int, int, float]]:
    """(first token, last token, kind, confidence) of mentions: begun by a token of enough confidence, gone on with by inside tags of its kind."""
    out: list[list] = []
    open_ = False
    for i in np.flatnonzero(tags):
        kind, inside = (tags[i] - 1) // 2, tags[i] % 2 == 0
        if open_ and inside and out[-1][1] == i - 1 and out[-1][2] == kind:
            out[-1][1], out[-1][3] = i, max(out[-1][3], sure[i])
        elif sure[i] >= least:
            out.append([i, i, kind, sure[i]])
            open_ = True
        else:
            open_ = False
    return [(int(a), int(b), int(k), float(c)) for a, b, k, c in out]


def gold_tags(starts: np.ndarray, ends: np.ndarray, mentions, kinds: tuple[str, ...]) -> np.ndarray:
    """Tags of tokens: those that lie in a mention, of overlapping mentions in the first one."""
    tags = np.zeros(len(starts), np.int64)
    place = {k: i for i, k in enumerate(kinds)}
    for a, b, kind in sorted((m["start_offset"], m["end_offset"], m["entity_type"]) for m in mentions):
        hit = np.flatnonzero((starts >= a) & (ends <= b) & (tags == 0))
        if len(hit) and kind in place:
            tags[hit] = 2 + 2 * place[kind]
            tags[hit[0]] = 1 + 2 * place[kind]
    return tags


def _epoch(examples: list[tuple[np.ndarray, np.ndarray]], kinds, weights: np.ndarray, steps: np.ndarray, seed: int):
    """Weights and their averages after one pass of updates."""
    start, step = allowed(kinds)
    w, s = weights.copy(), steps.copy()
    wa, sa, n = np.zeros_like(w), np.zeros_like(s), 1
    for i in np.random.default_rng(seed).permutation(len(examples)):
        rows, gold = examples[i]
        guess = viterbi(w[rows].sum(1)[None], np.array([len(rows)]), start, step + s)[0]
        wrong = np.flatnonzero(guess != gold)
        for k in wrong:
            w[rows[k], gold[k]] += 1
            w[rows[k], guess[k]] -= 1
            wa[rows[k], gold[k]] += n
            wa[rows[k], guess[k]] -= n
        if len(wrong):
            for tags, by in ((gold, 1), (guess, -1)):
                np.add.at(s, (tags[:-1], tags[1:]), by)
                np.add.at(sa, (tags[:-1], tags[1:]), by * n)
        n += 1
    return w, s, w - wa / n, s - sa / n


def _examples(windows: list, feature: Features, kinds):
    out = []
    for words, starts, ends, mentions in windows:
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        out.append((feature(list(words), starts, ends), gold_tags(starts, ends, mentions, kinds)))
    return out


def _small_batches(docs: DataFrame) -> None:
    """Keep Arrow batches of texts within a worker's memory by bytes; it stays set, as results are computed later."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of texts, however many texts a batch has in frames of at most ``CUT_TOGETHER``."""
    columns, rows = ["data_id", "at", "words", "starts", "ends", "mentions"], []
    for pdf in batches:
        for data_id, text, mentions in zip(pdf["data_id"], pdf["text"], pdf["mentions"]):
            mentions = [] if mentions is None else list(mentions)
            words, starts, ends = tokens(text or "")
            for a, b in cut(len(words)):
                inside = [dict(m) if isinstance(m, dict) else m.asDict() for m in mentions if m["start_offset"] < ends[b - 1] and m["end_offset"] > starts[a]]
                rows.append((data_id, a, words[a:b], starts[a:b].tolist(), ends[a:b].tolist(), inside))
                if len(rows) == CUT_TOGETHER:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


def _window_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where windows begin and whether they hold a mention, without their words."""
    for pdf in batches:
        rows = []
        for data_id, text, mentions in zip(pdf["data_id"], pdf["text"], pdf["mentions"]):
            if mentions is None or not len(mentions):
                rows += [(data_id, a, False) for a, _ in cut(len(TOKEN.findall(text or "")))]
                continue
            _, starts, ends = tokens(text or "")
            rows += [(data_id, a, any(m["start_offset"] < ends[b - 1] and m["end_offset"] > starts[a] for m in mentions)) for a, b in cut(len(starts))]
        yield pd.DataFrame(rows, columns=["data_id", "at", "some"])


def _shard_round(sent, kinds: tuple[str, ...], bits: int, seed: int):
    """A round over one shard's windows: what differs from zero of its last weights and of their averages, by place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, steps = sent.value
        pdf = pdf.sort_values(["place", "at"], kind="stable")
        examples = _examples(list(zip(pdf["words"], pdf["starts"], pdf["ends"], pdf["mentions"])), Features(bits), kinds)
        w, s, mean_w, mean_s = _epoch(examples, kinds, weights.astype(float), steps, seed)
        last, mean = np.concatenate([w.ravel(), s.ravel()]), np.concatenate([mean_w.ravel(), mean_s.ravel()])
        at = np.flatnonzero((last != 0) | (mean != 0))
        return pd.DataFrame({"at": np.append(at, -1), "last": np.append(last[at], 1.0), "mean": np.append(mean[at], 1.0)})

    return run


def fit(docs: DataFrame, bits: int = BITS, rounds: int = ROUNDS, most_windows: int = MOST_WINDOWS, shards: int = 8) -> Tagger:
    """A model from documents (data_id, text, mentions as ``MENTIONS``).

    Null texts and mentions are empty.  At most ``most_windows`` windows are drawn,
    half of them with a mention where there are so many; without any mention no
    kind is learned and nothing will be found.
    """
    spark = docs.sparkSession
    _small_batches(docs)
    id_type = docs.schema["data_id"].dataType.simpleString()
    window = f"data_id {id_type}, at int, words array<string>, starts array<int>, ends array<int>, mentions {MENTIONS}"
    read = docs.select("data_id", F.coalesce("text", F.lit("")).alias("text"), "mentions")
    place, folder = F.xxhash64("data_id", "at"), work_folder(spark)
    places = written(read.mapInPandas(_window_places, f"data_id {id_type}, at int, some boolean").withColumn("place", place), folder, "places")
    # Windows without a mention are many: what a threshold on their hash lets through is about what is wanted.
    rates = {r["some"]: r["n"] for r in places.groupBy("some").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_some = min(rates.get(True, 0), most_windows // 2)
    share = {True: n_some / max(1, rates.get(True, 0)), False: min(1.0, max(n_some, 200) / max(1, rates.get(False, 0)))}
    chance = F.pmod("place", F.lit(1 << 30)) / float(1 << 30)
    lets = chance < F.when(F.col("some"), share[True]).otherwise(share[False])
    # only documents of a drawn window, about as many as ``most_windows`` at most, are cut into windows with their words
    ids = F.broadcast(places.where(lets).select(F.col("data_id").alias("_id")).distinct())
    drawn = read.join(ids, F.col("data_id").eqNullSafe(F.col("_id")), "left_semi").mapInPandas(_cut_texts, window)
    kept = drawn.withColumn("some", F.size("mentions") > 0).withColumn("place", place).where(lets)
    wanted = sum(share[k] * n for k, n in rates.items())
    shards = max(1, min(shards, round(wanted / SHARD_WINDOWS)))
    kept = written(kept.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")), folder, "windows")
    kinds = tuple(sorted(r["k"] for r in kept.select(F.explode("mentions.entity_type").alias("k")).where("k is not null").distinct().collect()))
    tags, size = 1 + 2 * len(kinds), 1 << bits
    weights, steps = np.zeros((size, tags)), np.zeros((tags, tags))
    total, total_steps = np.zeros_like(weights), np.zeros_like(steps)
    for r in range(rounds if kinds else 0):
        sent = spark.sparkContext.broadcast((weights.astype(np.float32), steps))

        mixed = kept.groupBy("shard").applyInPandas(_shard_round(sent, kinds, bits, r), "at long, last double, mean double").groupBy("at").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean")).toPandas()
        ways = float(mixed.loc[mixed["at"] == -1, "last"].sum())
        mixed = mixed[mixed["at"] >= 0]
        for into, into_steps, name, clear in ((weights, steps, "last", True), (total, total_steps, "mean", False)):
            flat = np.zeros(size * tags + tags * tags)
            flat[mixed["at"].to_numpy()] = mixed[name].to_numpy() / ways
            if clear:
                into[:], into_steps[:] = 0, 0
            into += flat[: size * tags].reshape(size, tags)
            into_steps += flat[size * tags :].reshape(tags, tags)
        sent.unpersist()
    model = Tagger(kinds, (total / max(1, rounds)).astype(np.float32), total_steps / max(1, rounds))
    return calibrated(model, kept.orderBy("place", "at").limit(400).collect())


def calibrated(model: Tagger, windows) -> Tagger:
    """With the scale of scores under which the windows' true tags are likeliest."""
    if not model.kinds or not windows:
        return model
    feature = Features(model.bits)
    examples = _examples([(r["words"], r["starts"], r["ends"], r["mentions"]) for r in windows], feature, model.kinds)
    start, step = allowed(model.kinds)
    best = (-np.inf, 1.0)
    for scale in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6):
        told = 0.0
        for rows, gold in examples:
            p = marginals(model.weights[rows].sum(1)[None].astype(float) * scale, np.array([len(rows)]), start, step + model.steps * scale)[0]
            told += float(np.log(np.maximum(p[np.arange(len(gold)), gold], 1e-9)).sum())
        best = max(best, (told, scale))
    return Tagger(model.kinds, model.weights, model.steps, best[1])


def _spans_of(model: Tagger, texts: list[str], least: float, feature: Features | None = None) -> Iterator[list[dict]]:
    """The spans of each text; features are held of one text, or of short ones' ``TOGETHER`` windows, at a time."""
    feature = feature or Features(model.bits)
    read, windows = [], []
    for k, text in enumerate(texts):
        words, starts, ends = tokens(text)
        borders = cut(len(words))
        read.append((starts, ends, borders))
        rows = feature(words, starts, ends) if words else None
        windows += [rows[a:b] for a, b in borders]
        if len(windows) < TOGETHER and k + 1 < len(texts):
            continue
        decoded, at = model.decode(windows), 0
        for starts, ends, borders in read:
            tags, sure = stitch(len(starts), borders, decoded[at : at + len(borders)])
            at += len(borders)
            yield [{"start_offset": int(starts[a]), "end_offset": int(ends[b]), "entity_type": model.kinds[k], "confidence": c} for a, b, k, c in runs(tags, sure, least)]
        read, windows = [], []


def found(docs: DataFrame, model: Tagger, text: Column | None = None, least: float = START) -> DataFrame:
    """``docs`` with spans: what the model finds in each whole text, by place; null and empty texts have none."""
    _small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feature = Features(sent.value.bits)
        for s in batches:
            if not sent.value.kinds:
                yield pd.Series([[] for _ in s], dtype=object)
            else:
                yield pd.Series(list(_spans_of(sent.value, [t or "" for t in s], least, feature)), dtype=object)

    return docs.withColumn("spans", run(F.col("text") if text is None else text))


def spans(docs: DataFrame, model: Tagger, least: float = START) -> DataFrame:
    """The spans of documents (data_id, text) as rows, as ``anonymize.by_spans`` takes them."""
    return found(docs.select("data_id", "text"), model, least=least).select("data_id", F.posexplode("spans").alias("pos", "s")).select("data_id", "pos", "s.*")


def scores(gold: DataFrame, told: DataFrame) -> DataFrame:
    """precision, recall and f1 of spans (data_id, start_offset, end_offset, entity_type) against the true ones, borders and type alike."""
    keys = ["data_id", "start_offset", "end_offset", "entity_type"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(told.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full_outer")
    c = both.agg(F.sum("g").alias("gold"), F.sum("t").alias("told"), F.sum(F.col("g") * F.col("t")).alias("hit")).na.fill(0)
    part = lambda n: F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(0.0)
    return c.select("gold", "told", "hit", part("told").alias("precision"), part("gold").alias("recall"), F.when(F.col("gold") + F.col("told") > 0, 2 * F.col("hit") / (F.col("gold") + F.col("told"))).otherwise(0.0).alias("f1"))

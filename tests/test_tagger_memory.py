"""The tagger's memory: it goes with a window's or a text's size, not with the texts of an Arrow batch."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from veilframe.operators import tagger


def texts(n, seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abdeioun0123") for _ in range(pick.randrange(2, 9)))
    return [" ".join(word() for _ in range(pick.choice([0, 1, 50, 300, 700]))) for _ in range(n)]


def some_model():
    rng = np.random.default_rng(3)
    return tagger.Tagger(("A", "B"), rng.normal(size=(1 << 10, 5)).astype(np.float32), rng.normal(size=(5, 5)))


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_features_of_a_few_windows_at_a_time():
    """Eight times as many texts in one batch take hardly more memory; spans, which stay, are few."""
    model = some_model()
    small, large = texts(100), texts(100) * 8
    assert peak(lambda: [len(s) for s in tagger._spans_of(model, large, 0.99)]) < 1.5 * peak(lambda: [len(s) for s in tagger._spans_of(model, small, 0.99)])


@pytest.mark.parametrize("n", [0, 1, 7, 150])
def test_spans_do_not_depend_on_company(n):
    model, many = some_model(), texts(n, n)
    assert list(tagger._spans_of(model, many, 0.3)) == [s for t in many for s in tagger._spans_of(model, [t], 0.3)]


def test_windows_are_handed_on(monkeypatch):
    """A batch of many texts gives several frames, with all its windows in order."""
    monkeypatch.setattr(tagger, "CUT_TOGETHER", 64, raising=False)
    many = [*texts(60), None]
    frames = list(tagger._cut_texts(iter([pd.DataFrame({"data_id": range(61), "text": many, "mentions": [None] * 61})])))
    assert max(map(len, frames)) <= 64
    got = [(i, a, tuple(w)) for f in frames for i, a, w in zip(f["data_id"], f["at"], f["words"])]
    assert got == [(i, a, tuple(tagger.tokens(t or "")[0][a:b])) for i, t in enumerate(many) for a, b in tagger.cut(len(tagger.tokens(t or "")[0]))]


def test_batches_by_bytes(spark):
    """A session's default of 64 MB of text a batch doesn't hold while the tagger runs."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        tagger.found(spark.createDataFrame([(1, "a b")], "data_id int, text string"), some_model())
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


@pytest.mark.parametrize("seed", range(6))
def test_windows_that_are_not_searched(seed):
    """Tags as by a search of every window, spans as with every window's marginals; some windows, but not all, are passed over."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(1 << 10, 5)).astype(np.float32) * 0.5
    weights[:, 0] += 1
    weights[rng.integers(1 << 10), 1] += 25
    model, feature = tagger.Tagger(("A", "B"), weights, rng.normal(size=(5, 5)), 0.4), tagger.Features(10)
    start, step = tagger.allowed(model.kinds)
    passed = []
    for text in texts(40, seed):
        words, starts, ends = tagger.tokens(text)
        borders = tagger.cut(len(words))
        windows = [feature(words, starts, ends)[a:b] for a, b in borders]
        slow = []
        for w in windows:
            scores, n = weights[w].sum(1)[None].astype(float), np.array([len(w)])
            passed.append(not tagger.may_leave(scores, n, start, step + model.steps)[0])
            best = tagger.viterbi(scores, n, start, step + model.steps)[0]
            p = tagger.marginals(scores * model.scale, n, start, step + model.steps * model.scale)[0]
            slow.append((best, p[np.arange(len(w)), best]))
        quick = model.decode(windows)
        assert [t.tolist() for t, _ in quick] == [t.tolist() for t, _ in slow]
        tags, sure = tagger.stitch(len(words), borders, slow)
        tags_, sure_ = tagger.stitch(len(words), borders, quick)
        assert tagger.runs(tags_, np.round(sure_, 9)) == tagger.runs(tags, np.round(sure, 9))
    assert 0 < sum(passed) < len(passed)


def test_places_are_those_of_the_windows():
    """The windows that are counted are the ones that are cut, with and without mentions."""
    many = [*texts(60), None, ""]
    found = [[{"start_offset": s, "end_offset": s + 9, "entity_type": "A"} for s in range(0, len(t or ""), 400)][: i % 4] or None for i, t in enumerate(many)]
    batch = pd.DataFrame({"data_id": range(62), "text": many, "mentions": found})
    cut = pd.concat(tagger._cut_texts(iter([batch])))
    places = pd.concat(tagger._window_places(iter([batch])))
    assert list(zip(places["data_id"], places["at"], places["some"])) == [(i, a, len(m) > 0) for i, a, m in zip(cut["data_id"], cut["at"], cut["mentions"])]


@pytest.mark.parametrize("text", ["", " ", "a", " a_b  c-1.\n", "é\u00a0\u2003x😀y\x1f z", "__ \x85 ..", "\ud7ff\x00a"])
def test_tokens_and_their_places(text):
    words, starts, ends = tagger.tokens(text)
    assert [(w, s, e) for w, s, e in zip(words, starts, ends)] == [(m.group(), m.start(), m.end()) for m in tagger.TOKEN.finditer(text)]

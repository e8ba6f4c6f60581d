"""The tagger: search and marginals against all ways, windows, and what it learns."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators import tagger
from veilframe.plans import anonymize
from veilframe.queries_tagger import PLANTED, planted


def ways(n, kinds):
    """All tag sequences that BIO order lets stand."""
    for tags in itertools.product(range(1 + 2 * len(kinds)), repeat=n):
        if all(t == 0 or t % 2 == 1 or (i and tags[i - 1] in (t - 1, t)) for i, t in enumerate(tags)):
            yield tags


@pytest.mark.parametrize("seed", range(12))
def test_search_and_marginals_against_all_ways(seed):
    """A batch of windows of 1 to 4 tokens, each with its own length."""
    rng, kinds = np.random.default_rng(seed), ("A", "B")
    start, step = tagger.allowed(kinds)
    learned = rng.normal(size=step.shape)
    lengths = np.array([4, 1, 3, 2])
    scores = rng.normal(size=(4, 4, 5)) * 2
    tags = tagger.viterbi(scores, lengths, start, step + learned)
    p = tagger.marginals(scores, lengths, start, step + learned)
    for b, n in enumerate(lengths):
        value = {w: sum(scores[b, i, t] for i, t in enumerate(w)) + sum(learned[x, y] for x, y in itertools.pairwise(w)) for w in ways(n, kinds)}
        best = tuple(tags[b, :n])
        assert best in value and value[best] == pytest.approx(max(value.values()))
        whole = sum(np.exp(v) for v in value.values())
        for i in range(n):
            want = [sum(np.exp(v) for w, v in value.items() if w[i] == t) / whole for t in range(5)]
            assert p[b, i] == pytest.approx(want, abs=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.integers(2, 60), st.data())
def test_windows_cover_every_token(n, size, data):
    shared = data.draw(st.integers(0, size - 1))
    borders = tagger.cut(n, size, shared)
    assert [a for a, _ in borders] == [i * (size - shared) for i in range(len(borders))]
    assert all(b - a <= size for a, b in borders) and {i for a, b in borders for i in range(a, b)} == set(range(n))
    assert all(y[0] == x[1] - shared for x, y in itertools.pairwise(borders))


def test_the_surer_window_counts():
    tags, sure = tagger.stitch(5, [(0, 3), (2, 5)], [(np.array([1, 0, 3]), np.array([0.9, 0.8, 0.4])), (np.array([0, 1, 2]), np.array([0.7, 0.6, 0.5]))])
    assert tags.tolist() == [1, 0, 0, 1, 2] and sure.tolist() == [0.9, 0.8, 0.7, 0.6, 0.5]


def test_a_mention_begins_with_enough_confidence():
    tags = np.array([1, 2, 0, 1, 1, 2, 4, 4, 0, 3])
    sure = np.array([0.6, 0.2, 0.9, 0.5, 0.55, 0.7, 0.9, 0.3, 1.0, 0.54])
    assert tagger.runs(tags, sure) == [(0, 1, 0, 0.6), (4, 5, 0, 0.7), (6, 7, 1, 0.9)]


def text_of(pick):
    """A text and its mentions, of the kinds that the documents have, in prose of no language."""
    word = lambda: "".join(pick.choice("abdeioun") for _ in range(pick.randrange(2, 9)))
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    make = {
        "EMAIL": lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com",
        "PHONE": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        "CARD": lambda: digits(16),
        "SECRET": lambda: "".join(pick.choice("0123456789abcdef") for _ in range(40)),
    }
    parts, at, found = [], 0, []
    for _ in range(pick.randrange(1, 120)):
        kind = pick.choice(list(make)) if pick.random() < 0.03 else None
        part = make[kind]() if kind else pick.choice([word(), word(), word() + ",", word() + ".", digits(pick.randrange(1, 5)), f"({word()})"])
        if kind:
            found.append((at, at + len(part), kind))
        parts.append(part)
        at += len(part) + 1
    return " ".join(parts), found


@pytest.fixture(scope="module")
def learned(spark):
    pick = random.Random(4)
    rows = [(i, *text_of(pick)) for i in range(700)]
    docs = spark.createDataFrame(rows, f"data_id long, text string, mentions {tagger.MENTIONS}").cache()
    return docs, tagger.fit(docs.where("data_id >= 200"))


def test_what_is_held_back_is_found(spark, learned):
    docs, model = learned
    held = docs.where("data_id < 200")
    gold = held.select("data_id", F.explode("mentions").alias("m")).select("data_id", "m.*")
    (r,) = tagger.scores(gold, tagger.spans(held, model)).collect()
    assert r["gold"] > 200 and r["f1"] >= 0.9


def test_long_and_odd_texts(spark, learned):
    """A text of many windows has its mentions wherever they stand; nulls, blanks and repeated rows are theirs each."""
    _, model = learned
    mail = "anna.42@mail3.example.com"
    long = " ".join(["abdo eniu"] * 2000 + [mail] + ["boda"] * 331 + [mail])
    docs = spark.createDataFrame([(1, long, 9), (1, long, 9), (2, None, 9), (3, " \n", 9), (None, mail, 9), (4, "é😀 " + mail, 9)], "data_id long, text string, spans int")
    got = sorted((r["data_id"] or 0, r["start_offset"], r["end_offset"], r["entity_type"]) for r in tagger.spans(docs, model).collect())
    a, b = long.index(mail), long.rindex(mail)
    mails = [(d, s, s + len(mail), "EMAIL") for d, s in ((1, a), (1, a), (1, b), (1, b), (4, 3))]
    assert [g for g in got if g[0]] == sorted(mails)
    assert tagger.spans(docs.limit(0), model).count() == 0


def test_spans_feed_masking(spark, learned):
    docs, model = learned
    held = docs.where("data_id < 50").select("data_id", "text")
    found = tagger.spans(held, model).select("data_id", "start_offset", "end_offset", "entity_type")
    texts = {r["data_id"]: r["anonymized_text"] for r in anonymize.by_spans(held, found).collect()}
    for r in docs.where("data_id < 50").select("data_id", "text", "mentions").collect():
        told = {(s["start_offset"], s["end_offset"]) for s in found.where(F.col("data_id") == r["data_id"]).collect()} if r["mentions"] else set()
        for m in r["mentions"]:
            if (m["start_offset"], m["end_offset"]) in told:
                assert r["text"][m["start_offset"] : m["end_offset"]] not in texts[r["data_id"]]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", []), (2, None, None)], f"data_id long, text string, mentions {tagger.MENTIONS}")
    for d in (docs, docs.limit(0)):
        model = tagger.fit(d)
        assert model.kinds == () and tagger.spans(docs, model).count() == 0


def test_training_is_repeatable_and_bounded(spark, learned):
    docs, _ = learned
    one, two = (tagger.fit(d.where("data_id < 120"), rounds=2, most_windows=60) for d in (docs, docs.repartition(5)))
    assert np.allclose(one.weights, two.weights) and one.scale == two.scale
    assert np.count_nonzero(one.weights) > 0


def test_planted_mentions(spark):
    text = "to a.1@b2.example.com or +1 (487) 555-7209 at 1.22.3.4 with 1234567890123456 and " + "0f" * 20
    (r,) = spark.createDataFrame([(text,)], "text string").select(planted(F.col("text")).alias("m")).collect()
    assert [m["entity_type"] for m in r["m"]] == ["EMAIL", "PHONE", "ADDRESS", "CARD", "SECRET"] and len(PLANTED) == 5
    assert [text[m["start_offset"] : m["end_offset"]] for m in r["m"]][1] == "+1 (487) 555-7209"

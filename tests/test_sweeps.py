"""Spans, tokens and offsets of documents with very many of them, against slow versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions import text as tx
from veilframe.operators import entities

SPAN = "data_id long, pos int, entity_id string, entity_type string, identifier_type string, span_text string, start_offset int, end_offset int"
TEXT = "é😀a b\nmr. Anna of Łódź, 12-3 "


def spans(pick, n, length, wide=12):
    out = []
    for i in range(n):
        a = pick.randrange(length)
        out.append((pick.choice([1, 1, 1, 2, None]), i, f"e{i % 50}", pick.choice("XYZ"), pick.choice(["DIRECT", "QUASI", "NO_MASK", None]), "", a, a + pick.choice([0, 1, 3, pick.randrange(wide)])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_covered_tokens_against_slow(spark, seed):
    pick = random.Random(seed)
    gold, system = spans(pick, 80, 200), [(d, "t", a, b) for d, _, _, _, _, _, a, b in spans(pick, 200, 200, 6)]
    got = entities.covered_tokens(spark.createDataFrame(system, "data_id long, token string, start_offset int, end_offset int"), spark.createDataFrame(gold, SPAN))
    want = [(d, t, a, b) for d, t, a, b in system if any(g[0] == d and d is not None and g[4] != "NO_MASK" and g[6] <= a and g[7] >= b for g in gold)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("seed", range(3))
def test_best_overlap_against_slow(spark, seed):
    pick = random.Random(seed)
    mine, labelled = [s for s in spans(pick, 60, 900, 700) if s[0]], [s for s in spans(pick, 90, 900, 700) if s[0]]
    got = {(r["data_id"], r["pos"]): (r["entity_type"], round(r["iou"], 9)) for r in entities.best_overlap_label(spark.createDataFrame(mine, SPAN), spark.createDataFrame(labelled, SPAN)).collect()}
    want = {}
    for s in mine:
        best = ("MISC", 0.0)
        for e in sorted((e for e in labelled if e[0] == s[0]), key=lambda e: e[1]):
            both = min(s[7], e[7]) - max(s[6], e[6])
            if both > 0 and both / (s[7] - s[6] + e[7] - e[6] - both) > best[1]:
                best = (e[3], both / (s[7] - s[6] + e[7] - e[6] - both))
        want[s[0], s[1]] = (best[0], round(best[1], 9))
    assert got == want


def test_recall_by_slices_equals_recall_by_whole_texts(spark):
    pick = random.Random(5)
    whole = "".join(pick.choice(TEXT) for _ in range(3000))
    docs = spark.createDataFrame([(1, whole), (2, whole[:700]), (3, "none")], "data_id long, text string")
    mentions = [s for s in spans(pick, 150, 2900, 40) if s[0]]
    masks = spark.createDataFrame([(d, sorted((a, a + 9) for a in range(d, 2990, 23))) for d in (1, 3)] + [(2, [])], "data_id long, masked array<struct<s:int,e:int>>")
    df = spark.createDataFrame(mentions, SPAN)
    got = entities.mention_recall(docs, df, masks).collect()
    m = df.where("coalesce(identifier_type, '') <> 'NO_MASK'").join(docs, "data_id").join(masks, "data_id")
    parts = tx.tokens(F.col("text"), F.col("start_offset"), F.col("end_offset"))
    hit = F.filter(parts, lambda t: tx.mention_masked(F.col("text"), t["start_offset"], t["end_offset"], F.col("masked")))
    want = m.select("data_id", "entity_id", "pos", tx.mention_masked(F.col("text"), F.col("start_offset"), F.col("end_offset"), F.col("masked")).alias("is_masked"), F.size(parts).alias("n_tokens"), F.size(hit).alias("n_masked_tokens")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 80


def test_a_document_of_very_many_mentions(spark):
    """10^5 mentions and 10^5 tokens of one document, which pairs of would be 10^10."""
    n = 100_000
    tokens = spark.range(n).selectExpr("1L AS data_id", "'t' AS token", "cast(id * 5 AS int) AS start_offset", "cast(id * 5 + 4 AS int) AS end_offset")
    gold = spark.range(n).selectExpr("1L AS data_id", "cast(id AS int) AS pos", "'e' AS entity_id", "'X' AS entity_type", "'DIRECT' AS identifier_type", "'' AS span_text", "cast(id * 5 + id % 2 AS int) AS start_offset", "cast(id * 5 + 4 AS int) AS end_offset")
    began = time.monotonic()
    assert entities.covered_tokens(tokens, gold).count() == n // 2
    best = entities.best_overlap_label(tokens.selectExpr("data_id", "cast(start_offset / 5 AS int) AS pos", "start_offset", "end_offset"), gold)
    assert best.where("entity_type = 'X'").count() == n
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("automaton", [True, False])
def test_search_of_many_mentions_in_one_pass(spark, automaton):
    """10^4 mentions of one document, every third in the anonymized text; overlapping and repeated ones, nulls, a text that is null."""
    words = [f"name{i:05d}x" for i in range(10_000)]
    text = " ".join(words[::3])
    rows = [(1, i, w) for i, w in enumerate(words)] + [(1, -1, "ame00000"), (1, -2, "name00001x name"), (1, -3, ""), (1, -4, None), (2, 0, "x"), (3, 0, "y"), (4, 0, "gone"), (4, 1, "gone"), (4, 2, "é😀")]
    m = spark.createDataFrame(rows, "data_id long, pos int, span_text string")
    began = time.monotonic()
    got = entities.spans_by_search(m, spark.createDataFrame([(1, text), (2, None), (4, "aé😀b")], "data_id long, anonymized_text string"), automaton)
    assert got.columns == m.columns
    assert sorted((r["data_id"], r["pos"]) for r in got.collect()) == sorted([(1, i) for i in range(10_000) if i % 3] + [(1, -2), (4, 0), (4, 1)])
    assert time.monotonic() - began < 60


def test_blocks_of_odd_texts(spark):
    pick = random.Random(2)
    for n in (0, 1, tx.BLOCK - 1, tx.BLOCK, tx.BLOCK + 1, 5000):
        text = "".join(pick.choice(TEXT) for _ in range(n))
        df = spark.createDataFrame([(text,)], "t string").withColumn("b", tx.blocks(F.col("t"))).withColumn("d", tx.offset_directory(F.col("t")))
        r = df.select("b", "d").first()
        assert "".join(r["b"]) == text and all(len(x) == tx.BLOCK for x in r["b"][:-1])
        cuts = [(pick.randrange(n + 3), pick.randrange(40)) for _ in range(20)] + [(0, n), (n, 5), (-2, 6)]
        at = spark.createDataFrame([(a, a + k) for a, k in cuts], "a int, z int").crossJoin(df)
        d, a, z = F.col("d"), F.col("a"), F.col("z")
        got = at.select("a", "z", tx.block_slice(F.col("b"), a, z).alias("s"), tx.byte_of_char(d, a).alias("b"), tx.unit_of_char(d, a).alias("u")).collect()
        for r in got:
            head = text[: max(r["a"], 0)]
            assert r["s"] == text[max(r["a"], 0) : max(r["z"], 0)]
            assert (r["b"], r["u"]) == (len(head.encode()), len(head.encode("utf-16-le")) // 2)


def test_every_offset_of_a_text_and_back(spark):
    pick = random.Random(3)
    text = "".join(pick.choice(TEXT) for _ in range(2500))
    size, units = len(text.encode()), len(text.encode("utf-16-le")) // 2
    df = spark.createDataFrame([(text,)], "t string").withColumn("d", tx.offset_directory(F.col("t")))
    at = spark.range(size + 2).selectExpr("cast(id AS int) AS i").crossJoin(df)
    d, i = F.col("d"), F.col("i")
    bytes_of, units_of = {0: 0}, {0: 0}
    b = u = 0
    for n, ch in enumerate(text, 1):
        b, u = b + len(ch.encode()), u + len(ch.encode("utf-16-le")) // 2
        bytes_of[b], units_of[u] = n, n
    for r in at.select("i", tx.char_of_byte(d, i).alias("b"), tx.char_of_unit(d, i).alias("u"), tx.unit_of_byte(d, i).alias("ub"), tx.byte_of_unit(d, i).alias("bu")).collect():
        n, m = bytes_of.get(r["i"], len(text)), units_of.get(r["i"], len(text))
        assert (r["b"], r["u"]) == (n, m)
        assert (r["ub"], r["bu"]) == (len(text[:n].encode("utf-16-le")) // 2, len(text[:m].encode()))
    assert units < size


def test_many_offsets_of_one_text(spark):
    """10^5 offsets of a text of a million characters: in proportion to the offsets, not to their product with the text."""
    docs = spark.createDataFrame([("é😀ab" * 250_000,)], "t string").withColumn("d", tx.offset_directory(F.col("t"))).cache()
    docs.count()
    at = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda k: k * 10)
    began = time.monotonic()
    got = docs.select(F.transform(at, lambda i: tx.byte_of_char(F.col("d"), i)).alias("b")).first()["b"]
    assert time.monotonic() - began < 60
    assert got[:4] == [0, 22, 40, 62] and len(got) == 100_000

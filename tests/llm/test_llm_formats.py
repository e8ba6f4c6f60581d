"""Chat formatting, Merkle manifest and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import chat, divergence, merkle

CONV = "conv_id long, turn long, role string, text string"
FRAGMENTS = [*chat.CHAT.controls, "<", "[", "/", "\\", "INST]", "s>", " ", "\n", "é", "😀", "x"]
ROLES = ("system", "user", "assistant", "tool", "", "[/ROLE]", "start")


# --- 11 chat --------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.lists(st.sampled_from(FRAGMENTS), max_size=9).map("".join)), max_size=6))
def test_written_turns_are_read_back(turns):
    writer, reader = chat.Writer(chat.CHAT), chat.Reader(chat.CHAT)
    parts = [s for role, text in turns for s in writer.segments(role, text)]
    assert list(reader.turns("".join(t for t, _ in parts))) == turns
    assert "".join(reader.plain(t) for t, loss in parts if loss) == "".join(t for role, t in turns if role == "assistant")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=9).map("".join))
def test_no_control_is_left_in_a_text(text):
    written = chat.Writer(chat.CHAT).escaped(text)
    assert not any(c in written for c in chat.CHAT.controls)
    assert chat.Reader(chat.CHAT).plain(written) == text


@pytest.mark.parametrize("change", [{"controls": ("<",)}, {"controls": ("<\\",)}, {"named": "none"}, {"named": "[/ROLE]["}, {"other": chat.Turn("<s>", "[/TURN]")}, {"follows": {"start": ("nobody",)}}])
def test_ambiguous_templates_are_refused(change):
    with pytest.raises(ValueError):
        replace(chat.CHAT, **change)


def slow_chat(rows):
    """Digests by conversation, from plain lists of (conv_id, turn, role, text, hash)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), r[4], (r[3] or "").encode()))]
        loss = "".join(t for role, t in turns if role == "assistant")
        state, bad = "start", None
        for i, (role, _) in enumerate(turns):
            if role not in chat.CHAT.follows[state] and bad is None:
                bad = i
            state = role if role in chat.CHAT.turns else state
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), bad is None and state in chat.CHAT.ends, bad)
    return out


def conversations(seed=3):
    pick = random.Random(seed)
    text = lambda: pick.choice([None, "", "x" * pick.randrange(40)]) if pick.random() < 0.2 else "".join(pick.choice(FRAGMENTS) for _ in range(pick.randrange(12)))
    rows = []
    for c in range(60):
        roles = pick.choice([["user", "assistant"] * 3, ["system", "user", "assistant"], ["user"], ["assistant", "user"], ["user", "user", "assistant"], [None, "tool", "user", "assistant"]])
        rows += [(c, i, r, text()) for i, r in enumerate(roles)]
    # one conversation of a third of all rows, in several tasks; ties, repeated rows, nulls
    rows += [(7000, i, ("user", "assistant")[i % 2], text()) for i in range(400)]
    rows += [(8000, 1, "user", "a"), (8000, 1, "user", "b"), (8000, 1, "user", "a"), (8000, None, "assistant", None), (None, 0, "user", "q"), (None, None, None, None)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_conversations_against_slow(spark, monkeypatch, size):
    """With pieces of a few turns as well, in more tasks than conversations fit into."""
    monkeypatch.setattr(chat, "PIECE", size)
    df = spark.createDataFrame([(*r, 1, "z") for r in conversations()], f"{CONV}, piece long, h string").repartition(5)
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat.format_conversations(df).cache()
        assert pieces.where("conv_id = 7000").count() > 1
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["bad_turn"]) for r in chat.read_back(pieces).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == slow_chat(rows)
    shown = chat.segments(pieces).where("conv_id = 8000").orderBy("piece", "segment").collect()
    assert "".join(r["text"] for r in shown) == "[OUT]  </s>\n" + "".join(f"<s>[INST] {t} [/INST]" for t in [r[3] for r in sorted((r for r in rows if r[0] == 8000 and r[1]), key=lambda r: r[4])])


def test_no_conversations(spark):
    got = chat.chat_query(spark.createDataFrame([], CONV)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["valid"]) for r in got] == [(-1, 2, 21, True)]


def test_text_that_no_template_wrote_raises(spark):
    df = spark.createDataFrame([(1, 1, True, 1, [("hello", False)], [(0, -1)] * 4)], f"conv_id long, piece long, inner boolean, n_turns long, segments {chat.SEGMENTS}, moves {chat.MOVES}")
    with pytest.raises(Exception, match="no turn begins here"):
        chat.read_back(df).collect()


# --- 12 Merkle ------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(r, more=0):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more, r["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(leaves, arity):
    """(root, for each leaf its runs of brothers with its place in them)."""
    ways, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for i, way in enumerate(ways):
            way.append((runs[at[i] // arity], at[i] % arity))
            at[i] //= arity
        level = [sha("".join(r)) for r in runs]
    return level[0], ways


def slow_merkle(rows, arity, modulus=7):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        members = sorted((((r["doc_id"] is not None, r["doc_id"] or 0), slow_leaf(r), i) for i, r in enumerate(rows) if r["lang"] == lang))
        trees.append((members, *slow_tree([m[1] for m in members], arity)))
    root, crown = slow_tree([t[1] for t in trees], arity)
    for (members, subroot, ways), above in zip(trees, crown):
        for (_, leaf, i), way in zip(members, ways):
            r = rows[i]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == 0
            node, beside = slow_leaf(r, int(hit)), ""
            for run, at in way + above:
                beside += "".join(h for k, h in enumerate(run) if k != at)
                node = sha("".join(node if k == at else h for k, h in enumerate(run)))
            out.append((r["doc_id"], leaf, subroot, root, sha(beside), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity, block", [(2, 4), (2, 1024), (3, 9), (5, 5)])
def test_merkle_against_slow(spark, odd, monkeypatch, arity, block):
    """Trees of one leaf, of one more than a power, of several tiers; one language with most rows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(merkle, "BLOCK", block)
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"), F.element_at(F.array(*map(F.lit, ["en"] * 9 + ["de", "é"])), (F.col("id") % 11 + 1).cast("int")).alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    df = odd.unionByName(many, allowMissingColumns=True)
    got = sorted((tuple(r) for r in merkle.merkle_query(df, arity).collect()), key=repr)
    assert got == slow_merkle(df.collect(), arity)


def test_merkle_of_nothing_and_of_one(spark, none):
    assert merkle.merkle_query(none).count() == 0
    one = spark.createDataFrame([(3, "t", None, "s", 1)], none.schema)
    (r,) = merkle.merkle_query(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == slow_leaf(one.first()) and r["proof_sha256"] == sha("") and r["verified"]


def test_tampering_is_seen(spark, sf):
    from pyspark.sql import functions as F

    got = merkle.merkle_query(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.where((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) == F.col("verified")).count() == 0


def test_parents_fit_their_children(spark, sf):
    """The stored tables alone: a parent's preimage is its children's hashes, each parent's hash stands in the next preimage."""
    from veilframe.llm.common import table, work_dir

    made = merkle.manifest(table(spark, sf, "documents"), merkle.leaf(), work_dir(spark), 2)
    for tier in (*made["parents"], *made["crown"]):
        for block in tier.collect():
            below = [n["hash"] for n in block["nodes"]]
            for level in block["preimages"]:
                assert "".join(below) == "".join(level)
                below = [sha(p) for p in level]
            assert below == [block["top"]]


# --- 13 divergence --------------------------------------------------------------


def slow_divergence(rows, least, top=10):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counts, frequency = {}, Counter()
    for r in rows:
        lang, source, found = r["lang"] or "", r["source"] or "", words(r["text"])
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        frequency.update((lang, w) for w in set(found))
    out, f = [], lambda p, q: (p - q) ** 2 // (p + q)
    for lang, by in counts.items():
        kept = [w for (x, w), n in frequency.items() if x == lang and n >= least]
        smooth = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[w] for w in kept) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: smooth(c) for s, c in by.items()}, smooth(sum(by.values(), Counter()))
        for s, c in by.items():
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in by if o != s]
            term = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if c[w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least, side, text", [(1, 2, 200), (2, 512, 1 << 20), (50, 512, 1 << 20)])
def test_divergence_against_slow(spark, odd, monkeypatch, least, side, text):
    """Also with terms of more sources than one task compares, with texts counted piece by piece, and where no term is kept."""
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "TEXT_BYTES", text)
    pick = random.Random(5)
    words = ["the", "The", "of", "été", "ÉTÉ", "x", "y", "zoo", "naïve", "s'il", "日本", "😀"]
    more = [(100 + i, " ".join(pick.choice(words) for _ in range(pick.randrange(30))), pick.choice(["en", "en", "fr", None, ""]), pick.choice(["a", "b", "c", "é", "Z", None, ""]), 1) for i in range(120)]
    df = odd.where("doc_id is null or doc_id not in (5, 6)").unionByName(spark.createDataFrame([*more, (999, "", "xx", "only", 0)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = divergence.divergence(df, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == slow_divergence(df.collect(), least)


def test_divergence_of_nothing(spark, none):
    assert divergence.divergence(none).count() == 0


def test_divergence_of_large_counts():
    """A shard's arithmetic beyond 64 bits: counts of 10^10 and totals of 10^12."""
    import pyarrow as pa

    n, total, terms = 10**10, 10**12, 10**6
    row = {"lang": "en", "source": "a", "term": "w", "n": n, "all_n": 2 * n, "total": total, "lang_total": 3 * total, "terms": terms, "side": 0, "mine": True}
    rows = pa.Table.from_pylist([row, row | {"source": "b", "n": 1}])
    got = pa.Table.from_batches(divergence._run_sql(divergence.PARTS, rows, "counts", divergence._arrow(divergence.PARTS_SCHEMA), top=10)).to_pylist()
    p = lambda n, t: 1 + 10**9 * (n + 2) // (t + 2 * terms)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    a, b, zero = p(n, total), p(1, total), p(0, total)
    assert [r["value"] for r in got if r["kind"] == "both"] == [f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero)]
    assert [(r["item"], r["value"]) for r in got if r["kind"] == "term"] == [("w", f(a, p(2 * n, 3 * total)))]


# --- Bounds of the other operators ------------------------------------------------


def test_ranges_follow_the_rows():
    from veilframe.llm import exact_dedup

    for rows in (0, 1, 10**6, 10**9, 10**11):
        bits = exact_dedup.range_bits(rows)
        assert rows / 2**bits <= exact_dedup.RANGE_ROWS and bits <= exact_dedup.FP_BITS - 16
    assert exact_dedup.range_bits(10**11) >= 16


def test_pivots_are_few_and_the_same_for_any_partitioning(spark, monkeypatch):
    """More classes of one label than a tile holds: links equal those of one tile."""
    import numpy as np

    from veilframe.llm import embedding_dedup as ed

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist(), "x" if i % 7 else "y") for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    whole = sorted(tuple(r) for r in ed.embedding_dedup(df).collect())
    monkeypatch.setattr(ed, "TILE_ROWS", 60)
    assert sorted(tuple(r) for r in ed.embedding_dedup(df.repartition(6)).collect()) == whole
    assert len({r[2] for r in whole}) > 40


def test_one_id_of_many_rows_is_laid_out_by_several_tasks(spark):
    """10^5 rows of one id: read back whole, in places that follow one another, written by more than one task."""
    import zlib

    from veilframe.llm import bpe, common, token_files

    df = spark.range(100_000).selectExpr("if(id < 99990, 7L, id) AS doc_id", "concat('text ', id % 1000) AS text")
    path = f"{common.work_dir(spark)}/one-id"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path)
    assert files.select("part").distinct().count() > 1
    got = token_files.read_token_files(spark, path)
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got.collect())
    assert len(rows) == 100_000 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:])) and [r[2] for r in rows] == sorted(r[2] for r in rows)
    codec = bpe.ByteBpe(bpe.ByteBpe.read())
    crc = lambda i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*codec.encode(f"text {i}"), 0]))
    assert {r["ids_crc32"] for r in got.select("ids_crc32").distinct().collect()} == {crc(i) for i in range(1000)}


def test_chunks_over_many_bins(spark, monkeypatch):
    """Far more bins than a block has, a chunk in all of them: the same digests, and each chunk encoded once a block."""
    from veilframe.llm import bpe, bpe_chunks

    monkeypatch.setattr(bpe_chunks, "BIN_BYTES", 2000)
    codec = bpe.ByteBpe(bpe.ByteBpe.read())
    pick = random.Random(6)
    common = " ".join(f"shared{pick.randrange(999)}" for _ in range(900))
    texts = [f"own {i} " + (common if i % 3 else "") + " ".join(f"w{pick.randrange(5000)}" for _ in range(pick.randrange(200))) for i in range(150)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: hashlib.sha256(",".join(map(str, codec.encode(t or ""))).encode()).hexdigest() for i, t in enumerate(texts)}
    for block in (1 << 12, 5, 1):
        monkeypatch.setattr(bpe_chunks, "BLOCK_BINS", block)
        assert {r["doc_id"]: r["ids_sha256"] for r in bpe_chunks.encode_decode(docs).collect()} == want


def test_a_chunk_is_encoded_once_for_its_bins():
    import pyarrow as pa

    from veilframe.llm import bpe, bpe_chunks

    class Spec:
        value = bpe.ByteBpe.read()

    rows = [(b"a" * 16, 1, b"hello world"), (b"a" * 16, 1, b"hello world"), (b"a" * 16, 2, None), (b"a" * 16, 2, None), (b"b" * 16, 3, b"alone"), (b"c" * 16, 1, b"x y"), (b"c" * 16, 9, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["h", "bin", "chunk"])
    for cut in range(len(rows)):
        got = [r for b in bpe_chunks._encoded_once(Spec, True)([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
        assert [(r["bin"], r["h"][:1]) for r in got] == [(1, b"a"), (2, b"a"), (1, b"c"), (9, b"c")]
    got = [r for b in bpe_chunks._encoded_once(Spec, False)([batch]) for r in b.to_pylist()]
    assert [(r["bin"], r["h"][:1]) for r in got] == [(1, b"a"), (2, b"a"), (3, b"b"), (1, b"c"), (9, b"c")]

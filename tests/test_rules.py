"""Golden values of the agreement rules, parsers, offsets and similarities."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import agreement, parse, repair, similarity
from veilframe.functions import text as tx
from veilframe.operators import alignment, entities, privacy, spans, stats


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(expr.alias("r")).collect()[0]["r"]


JW = [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("john smith", "jon smith", 0.973333), ("turkish", "turkey", 0.847619), ("a", "ab", 0.85), ("ab", "ba", 0.0), ("engineer", "software engineer", 0.453431), ("bdadc", "ddbacb", 0.844444), ("baaddd", "dabaddda", 0.833333)]


@pytest.mark.parametrize("a,b,want", JW)
def test_jaro_winkler(a, b, want):
    assert round(similarity.jaro_winkler(a, b), 6) == want


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_bounds(a, b):
    assert 0 <= similarity.jaro_winkler(a, b) <= 1 and similarity.jaro_winkler(a, a) == 1


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    assert similarity.lcs_length(a, b) == rows[-1][-1]
    assert len(similarity._lcs_places(a, b)) == rows[-1][-1]


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30), st.sampled_from([1, 3, 128]))
@settings(max_examples=200, deadline=None)
def test_lcs_places(a, b, every):
    """The places that the full table gives, going up on ties."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    i, j, want = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            want.add(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert similarity._lcs_places(a, b, every) == want


def test_long_rouge():
    """20,000 words a side in one line: a table of all pairs of words would need gigabytes."""
    words = [f"w{i * i % 9973}" for i in range(20000)]
    got = similarity.rouge(" ".join(words), " ".join(reversed(words)))
    assert got["rouge1"] == 1 and got["rougeL"] == got["rougeLsum"] < 1


def test_overlap_scores():
    r = similarity.rouge("the cat sat on the mat", "the cat lay on a mat")
    assert round(r["rouge1"], 4) == round(r["rougeL"], 4) == 0.6667
    assert round(similarity.bleu("the cat sat on the mat", "the cat lay on a mat"), 4) == 0.1156
    assert similarity.bleu("a b", "c d") == 0 and similarity.rouge("", "")["rougeL"] == 0


PLACES = [
    ("Seoul / South Korea", "seoul / south korea", None, 1.0), ("Ankara / Turkey", "Ankara / Türkiye", None, 1.0), ("Gangnam / Seoul / South Korea", "Seoul / South Korea", 2, 0.5),
    ("Lancashire / England / UK", "UK", None, 0.5), ("Gangnam / Seoul / South Korea", "Jongno / Seoul / South Korea", 4, 0.5), ("Gangnam / Seoul / South Korea", "Jongno / Seoul / South Korea", 2, 1.0),
    ("Paris / France", "Paris / Texas", 4, 0.5), ("A / B / C", "A / X / Y", 4, 0.0), ("France", "Germany", 4, 0.5), ("", "France", None, 0.0),
]


@pytest.mark.parametrize("a,b,depth,want", PLACES)
def test_locations(spark, a, b, depth, want):
    assert one(spark, agreement.location_score(F.col("a"), F.col("b"), depth), a=a, b=b) == want


AGES = [("30", "35", True), ("30", "36", False), ("20-29", "25", True), ("20–29", "29", True), ("20-30", "25-35", False), ("20-40", "25-29", True), ("30s", "32", False)]


@pytest.mark.parametrize("a,b,want", AGES)
def test_ages(spark, a, b, want):
    r = one(spark, agreement.age_outcome(F.col("a"), F.col("b")), a=a, b=b)
    assert (r["match"], r["error"]) == (want, False)


def test_age_error(spark):
    assert one(spark, agreement.age_outcome(F.col("a"), F.col("b")), a="20-29", b="30s")["error"]


RULES = [("PHONE_NUMBER", "+1-555-0100", "15550100", 1.0), ("PHONE_NUMBER", "+15550100", "5550100", 1.0), ("IDENTIFICATION_NUMBER", "US-ID-1234", "1234", 0.0), ("PASSPORT_NUMBER", "---", "abc", 1.0), ("SEX", "M", "Male", 1.0), ("RELATIONSHIP", "single", "unmarried", 1.0), ("EMAIL_ADDRESS", "A@x.com", "a@x.com ", 1.0), ("NAME", "", "", 1.0), ("NAME", "x", "", 0.0), ("EDUCATION", "PhD", "phd", 1.0)]


@pytest.mark.parametrize("tag,a,b,want", RULES)
def test_rules(spark, tag, a, b, want):
    assert one(spark, agreement.rule_outcome(F.col("a"), F.col("b"), F.col("t"), F.lit(None).cast("double")), a=a, b=b, t=tag)["score"] == want


def test_protection_by_hand(spark):
    rows = [("d1", 0, "NAME", 5, 1.0), ("d1", 0, "AGE", 3, 0.5), ("d1", 0, "SEX", 2, 1.0), ("d1", 1, "NAME", 4, 0.0), ("d2", 0, "NAME", 1, 1.0)]
    e = spark.createDataFrame(rows, "data_id string, subject_id int, tag string, certainty_a int, agreement_score double")
    r = privacy.ipr_cpr(e).collect()[0]
    assert (r["num_subjects"], r["num_pii"], r["ipr"], r["cpr"]) == (2, 3, 0.625, 0.5)
    assert {t["tag"]: (t["cpr"], t["num_pii"]) for t in privacy.cpr_by_tag(e).collect()} == {"NAME": (0.5, 2), "AGE": (0.5, 1)}
    empty = privacy.ipr_cpr(e.where("false")).collect()[0]
    assert (empty["num_pii"], empty["ipr"], empty["cpr"]) == (0, 0.0, 0.0)


MASKED = [("Mr John Smith", 0, 13, [(3, 13)], True), ("Mr John Smith", 0, 13, [(3, 7)], False), ("Mr. John Smith", 0, 14, [(4, 14)], True), ("the 5 of May", 0, 12, [(4, 5), (9, 12)], True), ("John", 0, 4, [], False), ("ab cd", 0, 5, [(0, 2), (1, 3), (3, 5)], True)]


@pytest.mark.parametrize("text,s,e,masks,want", MASKED)
def test_masks(spark, text, s, e, masks, want):
    df = spark.createDataFrame([(text, s, e, masks)], "t string, s int, e int, m array<struct<s:int,e:int>>")
    assert df.select(tx.mention_masked(F.col("t"), F.col("s"), F.col("e"), tx.merged(F.col("m"))).alias("r")).collect()[0]["r"] is want


def test_entity_grouping(spark):
    rows = [("d", 0, "e1", "QUASI"), ("d", 1, "e1", "DIRECT"), ("d", 2, "e2", "NO_MASK"), ("d", 3, "e2", "DIRECT"), ("d", 4, "e3", "NO_MASK"), ("d", 5, None, "DIRECT")]
    m = spark.createDataFrame(rows, "data_id string, pos int, entity_id string, identifier_type string").withColumn("entity_type", F.lit("PERSON"))
    got = {r["entity_id"]: (r["identifier_type"], r["n_maskable"]) for r in entities.group_entities(m).collect()}
    assert got == {"e1": ("QUASI", 2), "e2": ("DIRECT", 1), "e3": ("NO_MASK", 0)}


def test_offsets(spark):
    t = "a😀é b"
    df = spark.createDataFrame([(t, i) for i in range(len(t) + 1)], "t string, i int")
    c, i = F.col("t"), F.col("i")
    for r in df.select("i", tx.byte_offset(c, i).alias("b"), tx.utf16_offset(c, i).alias("u"), tx.char_offset_of_bytes(c, tx.byte_offset(c, i)).alias("back"), tx.char_offset_of_utf16(c, tx.utf16_offset(c, i)).alias("back16")).collect():
        head = t[: r["i"]]
        assert (r["b"], r["u"], r["back"], r["back16"]) == (len(head.encode()), len(head.encode("utf-16-le")) // 2, r["i"], r["i"])
    assert one(spark, tx.char_offset_of_bytes(F.col("t"), F.lit(2)), t=t) == len(t)
    assert one(spark, tx.char_offset_of_utf16(F.col("t"), F.lit(2)), t=t) == len(t)


@pytest.mark.parametrize("o,a,want", [(100, 60, (40, 0.6, False)), (100, 140, (40, 1.4, False)), (100, 59, (41, 0.59, True)), (0, 0, (0, 0.0, True)), (0, 5, (5, float("inf"), True))])
def test_length_check(spark, o, a, want):
    assert tuple(one(spark, tx.length_check(F.col("o"), F.col("a")), o="x" * o, a="x" * a)) == want


@pytest.mark.parametrize("said,want", [("Yes", "yes"), ("less precise", "less precise"), ("No", "no"), ("yes, no doubt", "no"), ("", "no"), (None, "no")])
def test_agreement_answer(spark, said, want):
    assert one(spark, parse.agreement_answer(F.col("s").cast("string")), s=said) == want


def test_alignment_answer(spark):
    text = "---\nReasoning: Result of x\nResult: Matched\nSubject: A_0; B_2\n---\nResult: Unmatched\nSubject: A_1\n---\nresult: matched\nsubject: A-h3; b_4 \n---\nResult: Matched\nSubject: A_0; B_2"
    assert [tuple(p) for p in one(spark, parse.alignment_pairs(F.col("s")), s=text)] == [(0, "0", "2"), (1, "h3", "4")]


def test_valid_pairs(spark):
    p = spark.createDataFrame([("d", 0, "0", "0"), ("d", 1, "0", "1"), ("d", 2, "9", "1")], "data_id string, pos int, a_id string, b_id string")
    ids = spark.createDataFrame([("d", 0, "0"), ("d", 1, "1")], "data_id string, idx int, id string")
    assert [(r["a_idx"], r["b_idx"]) for r in alignment.valid_pairs(p, ids, ids).collect()] == [(0, 0)]


@pytest.mark.parametrize("word", ["Unknown", "Seoul / Unknown", "[redacted]", "N/A", "", "none given", "City unknown"])
def test_not_inferable(spark, word):
    assert tuple(one(spark, parse.normalized_pii(F.col("w"), F.lit(3), F.lit(2)), w=word)) == ("", 0, 0)


def test_subject_count(spark):
    assert one(spark, parse.subject_count(F.col("s")), s="x\nThe Number of Subjects: 8") == 8
    assert one(spark, parse.analysis_part(F.col("s")), s="hm\n**Individual Character Analysis**\na The Number of Subjects: 2 end")["text"].startswith("Individual Character Analysis a")


def test_descriptions(spark):
    assert abs(one(spark, alignment.description_jaccard(F.col("a"), F.col("b")), a="the young doctor", b="the doctor") - 2 / 3) < 1e-9


@pytest.mark.parametrize("answer", ['[{"id":1,"PIIs":[{"tag":"NAME","keyword":"A","certainty":5}]}]', "text ```json\n[{'id': '1', 'PIIs': [{'tag': 'NAME', 'keyword': 'A', 'certainty': 5},]}\n```", '[{"id": 1, "PIIs": {"NAME": {"keyword": "A", "certainty": "5"}}}', "**Person 1:**\nNAME: A (certainty 5)"])
def test_profiles(answer):
    status, people, _ = repair.read_profiles(answer)
    assert status == "success" and people[0][0] == 1 and people[0][2][0][:3] == ("NAME", "A", 5)


def test_inferences():
    got = repair.read_inferences("Type: Location city\nInference: near: the sea\nGuess: A; B\nC\nCertainty: 4\n", ("LOCATION", "AGE"))
    assert got["LOCATION"] == {"inference": "near: the sea", "guess": ["A", "B", "C"], "certainty": "4"} and got["AGE"]["inference"] == "MISSING"


def test_match_stats_odd(spark):
    """Null ids, one side missing, repeated partners, blank and null values."""
    a = spark.createDataFrame([("d", 0, None), ("d", 1, "7"), ("e", 0, "1")], "data_id string, idx int, id string")
    b = spark.createDataFrame([("d", 0, "0"), ("d", 1, "1")], "data_id string, idx int, id string")
    pairs = spark.createDataFrame([("d", 1, 0)], "data_id string, a_idx int, b_idx int")
    values = spark.createDataFrame([("d", "A", 0, "x"), ("d", "A", 0, None), ("d", "A", 1, "y"), ("d", "B", 1, "\u00a0"), ("e", "A", 0, " ")], "data_id string, side string, idx int, keyword string")
    d, e = stats.match_stats(a, b, pairs, values).orderBy("data_id").collect()
    assert tuple(d) == ("d", 2, 2, 1, 1, 0, ["0"], ["1"]) and tuple(e) == ("e", 1, 0, 0, 0, 0, ["1"], [])
    none = stats.run_totals(stats.match_stats(a.limit(0), b.limit(0), pairs.limit(0), values.limit(0))).collect()[0]
    assert none["documents"] == 0 and none["match_ratio"] == 0


def test_corrected_outside(spark):
    """Mentions beyond their text, turned round or without a label go; a null text has none."""
    docs = spark.createDataFrame([("d", "Miss Ann, EUR 5"), ("e", None)], "data_id string, text string")
    rows = [("d", 0, 5, 8, "PERSON"), ("d", 1, 9, 40, "PERSON"), ("d", 2, 8, 5, "ORG"), ("d", 3, 0, 4, None), ("e", 0, 0, 2, "ORG"), ("d", 4, 14, 15, "CARDINAL")]
    m = spark.createDataFrame(rows, "data_id string, pos int, start_offset int, end_offset int, label string")
    got = [tuple(r) for r in entities.corrected(m, docs).orderBy("pos").collect()]
    assert got == [("d", 0, 0, 8, "PERSON"), ("d", 4, 10, 15, "QUANTITY")]
    assert [r["pos"] for r in entities.corrected(m, docs, never=("Ann",)).collect()] == [4]


def test_split_and_trim(spark):
    df = spark.createDataFrame([("d", 0, " (ab|cd), ", 10, 20), ("d", 1, " x. ", 30, 34)], "data_id string, pos int, span_text string, start_offset int, end_offset int")
    got = sorted(tuple(r)[1:] for r in spans.split_spans(df).collect())
    assert got == [(0, 0, "ab", 12, 14), (0, 1, "cd", 15, 17), (1, 0, " x. ", 30, 34)]


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), max_size=4))
@settings(max_examples=8, deadline=None)
def test_masking_hides_everything(spark, raw):
    text = "abcdefghijklmnopqrstuvwxyz0123"
    last, cut = 0, []
    for gap, n in raw:
        s = last + gap % 5
        if s + n <= len(text):
            cut.append((s, s + n, "X"))
            last = s + n
    df = spark.createDataFrame([(text, cut)], "t string, m array<struct<start_offset:int,end_offset:int,entity_type:string>>")
    out = df.select(tx.apply_masks(F.col("t"), F.col("m")).alias("r")).collect()[0]["r"]
    want = text
    for s, e, _ in reversed(cut):
        want = f"{want[:s]}[X]{want[e:]}"
    assert out == want

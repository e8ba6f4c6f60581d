"""Readers, writers, plans with stubs, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe import backends, schemas
from veilframe.operators import entities, scoring
from veilframe.plans import anonymize, evaluate, infer, utility
from veilframe.sources import jsonl
from veilframe.streaming import incremental

DOC = {"metadata": {"data_id": "d1", "number_of_subjects": 1}, "text": "é", "subjects": [{"id": "0", "description": "x", "PIIs": [{"tag": "NAME", "keyword": "A", "certainty": 5, "hardness": 1}]}]}


@pytest.fixture
def folder(tmp_path):
    keyed = {**DOC, "metadata": {"data_id": "d2"}, "subjects": [{"id": 7, "PIIs": {"AGE": {"value": "30", "certainty": 4}}}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(DOC, ensure_ascii=False) + "\n\n")
    (tmp_path / "mixed.jsonl").write_text(json.dumps(DOC) + "\n" + json.dumps(keyed) + "\n")
    return tmp_path


def test_jsonl(spark, folder):
    df = jsonl.read_jsonl(spark, str(folder / "a.jsonl"))
    assert df.count() == 1
    row = jsonl.long_annotations(df).collect()[0]
    assert (row["data_id"], row["tag"], row["keyword"], row["certainty"]) == ("d1", "NAME", "A", 5)
    jsonl.write_jsonl(df, str(folder / "out"))
    assert "é" in "".join(p.read_text() for p in (folder / "out").glob("part*"))
    with pytest.raises(ValueError):
        jsonl.read_jsonl_only(spark, "x.json")
    with pytest.raises(Exception):
        (folder / "bad.jsonl").write_text("{nope\n")
        jsonl.read_jsonl(spark, str(folder / "bad.jsonl")).collect()


def test_flexible_subjects(spark, folder):
    got = {r["data_id"]: (r["subject_id"], r["tag"], r["keyword"], r["certainty"], r["hardness"]) for r in jsonl.flexible_subjects(spark, str(folder / "mixed.jsonl")).collect()}
    assert got == {"d1": ("0", "NAME", "A", 5, 1), "d2": ("7", "AGE", "30", 4, 1)}


def test_reports(spark, tmp_path):
    entry = {"keyword_A": "a", "keyword_B": "b", "certainty_A": 3, "certainty_B": 1, "hardness_A": 1, "hardness_B": 1, "agreement_score": 0.5, "evaluation_method": "RULE", "match": False, "less_precise": True, "mismatch": False}
    report = {"config": {}, "detailed_results": [{"data_id": "d", "number_of_subjects": 1, "subjects": [{"subject_id": 0, "description": "", "evaluations": {"NAME": entry}}]}]}
    (tmp_path / "x_evaluation.json").write_text(json.dumps(report, indent=1))
    rows = scoring.long_evaluations(jsonl.read_report_folder(spark, str(tmp_path))).collect()
    assert [(r["tag"], r["agreement_score"], r["less_precise"]) for r in rows] == [("NAME", 0.5, True)]
    with pytest.raises(Exception):
        jsonl.read_report_folder(spark, str(tmp_path / "none")).collect()


def test_cache_and_annotators(spark, folder):
    (folder / "cache").write_text('{"data_id": "d1", "sa_response": "x"}\n{bad\n{"data_id": "d1", "sa_response": "y"}\n')
    assert jsonl.read_cache(spark, str(folder / "cache")).count() == 1
    assert {r["annotator"] for r in jsonl.read_annotators(spark, str(folder)).collect()} == {"a", "mixed"}
    assert jsonl.same_dataset("/PANORAMA/a", "b_panorama") == "panorama"
    with pytest.raises(ValueError):
        jsonl.same_dataset("/tab/a", "/panorama/b")
    assert jsonl.short_ids(spark, 5).count() == 5


def test_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "data_id int, prompt string")

    def answer(p):
        if p == "boom":
            raise RuntimeError("no")
        return p.upper()

    got = {r["data_id"]: (r["status"], r["response"]) for r in backends.call(df, backends.Stub(answer)).collect()}
    assert got[1] == ("success", "A") and got[2][0] == got[3][0] == "error"
    saved = spark.createDataFrame([(1, "kept")], "data_id int, response string")
    assert {r["data_id"]: r["response"] for r in backends.cached_call(df, saved, backends.Stub(lambda p: "new")).collect()}[1] == "kept"
    assert backends.max_tokens("claude-3-5-haiku-20241022") == 8192 and backends.max_tokens("other") == 32000
    body = json.loads(backends.Http("http://x", "claude-sonnet-4", limit=99999999).request("hi").data)
    assert body["max_tokens"] == 64000 and body["temperature"] == 0.1


def test_inference_merge(spark):
    cols = "data_id int, subject_id int, description string, tag string, pos int, keyword string, certainty int, hardness int"
    code = spark.createDataFrame([(1, 0, "the young doctor", "EMAIL_ADDRESS", 0, "a@b.c", 5, 1), (1, 1, "a cook", "NAME", 0, "Old", 2, 1)], cols)
    free = spark.createDataFrame([(1, 5, "the doctor", "NAME", 0, "Ann", 4, 1), (1, 1, "a cook", "NAME", 0, "unknown", 3, 1)], cols)
    got = {(r["subject_id"], r["tag"]): (r["keyword"], r["certainty"]) for r in infer.merged_profiles(code, free).collect()}
    assert got == {(0, "EMAIL_ADDRESS"): ("a@b.c", 5), (0, "NAME"): ("Ann", 4), (1, "NAME"): ("", 0)}


def test_mask_then_search_recalls_everything(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob at 10.0.0.1, Bob left.")], "data_id int, text string")
    m = spark.createDataFrame([(1, 0, "e1", "PERSON", "DIRECT", "Ann", 0, 3), (1, 1, "e2", "PERSON", "QUASI", "Bob", 8, 11), (1, 2, "e2", "PERSON", "QUASI", "Bob", 25, 28)], "data_id int, pos int, entity_id string, entity_type string, identifier_type string, span_text string, start_offset int, end_offset int")
    masked = anonymize.by_spans(docs, m.select("data_id", "start_offset", "end_offset", "entity_type"))
    assert masked.collect()[0]["anonymized_text"] == "[PERSON] met [PERSON] at 10.0.0.1, [PERSON] left."
    for method in ("auto", "offset_comparison"):
        r = entities.recall_report(entities.entity_recall(docs, m, entities.detected_masks(m, masked, method=method))).collect()[0]
        assert (r["erdi"], r["erqi"], r["token_recall"]) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        entities.detected_masks(m, masked, method="nope")
    assert entities.token_precision(docs, m, m.where("false")).collect()[0]["token_precision"] is None
    compat = entities.match_entities(m, m.where("pos = 0"), compat=True)
    assert compat.count() == 3


def test_utility(spark):
    docs = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", None)], "data_id int, text string, anonymized_text string")
    judged = spark.createDataFrame([(1, 'x {"readability": {"score": 8}, "meaning": {"score": 12}, "hallucinations": {"score": 1}} y')], "data_id int, response string")
    r = utility.combine(utility.overlap_scores(docs), judged).collect()
    assert len(r) == 1 and r[0]["bleu"] == 1.0 and abs(r[0]["utility_model"] - 0.9) < 1e-9 and abs(r[0]["utility_comb"] - 2.8 / 3) < 1e-9
    assert utility.missing_texts(docs).collect()[0]["error"] == "missing anonymized text"
    bad = utility.combine(utility.overlap_scores(docs), judged.withColumn("response", F.lit("no json"))).collect()[0]
    assert (bad["readability"], bad["meaning"], bad["hallucination"]) == (1.0, 1.0, 0.0)


def test_filler(spark):
    d = spark.createDataFrame([("d",)], "data_id string")
    s = spark.createDataFrame([("d", 0, "x"), ("e", 0, "y")], "data_id string, idx int, description string")
    assert evaluate.filler(d, s, schemas.FILLER_TAGS).count() == 16


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stage = lambda df: df.select(F.col("metadata.data_id").alias("data_id"), F.size("subjects").alias("n"))
    for i in range(3):
        (src / f"{i}.jsonl").write_text("".join(json.dumps({**DOC, "metadata": {"data_id": f"d{i}{j}"}}) + "\n" for j in range(4)))
        q = incremental.run(incremental.document_stream(spark, str(src)), stage, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    streamed = sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).select("data_id", "n").collect())
    batch = sorted(tuple(r) for r in stage(jsonl.read_jsonl(spark, str(src))).collect())
    assert streamed == batch and len(batch) == 12


def test_ground_truth_pipeline(spark, tmp_path):
    """From two JSONL files over prompts and a stubbed aligner to protection rates."""

    def doc(i, name, age):
        return {"metadata": {"data_id": f"d{i}"}, "text": "t", "subjects": [{"id": "0", "description": "p", "PIIs": [{"tag": "NAME", "keyword": name, "certainty": 5, "hardness": 1}, {"tag": "AGE", "keyword": age, "certainty": 4, "hardness": 1}]}]}

    (tmp_path / "gold.jsonl").write_text("".join(json.dumps(d) + "\n" for d in (doc(0, "x", "1"), doc(0, "Ann", "30"), doc(1, "Bob", "40"))))
    (tmp_path / "found.jsonl").write_text("".join(json.dumps(d) + "\n" for d in (doc(0, "ann", "33"), doc(1, "Rob", "60"), doc(2, "Eve", "9"))))
    read = lambda f: jsonl.with_ordinal(jsonl.read_jsonl(spark, str(tmp_path / f))).withColumn("data_id", F.col("metadata.data_id"))
    both = evaluate.combine(read("gold.jsonl"), read("found.jsonl"))
    assert {r["data_id"] for r in both.collect()} == {"d0", "d1"} and evaluate.align_errors(both).count() == 0
    told = backends.call(evaluate.align_prompts(both), backends.Stub(lambda p: "Result: Matched\nSubject: A_0; B_0" if "Subject 0 (p): NAME: " in p else "?"))
    people = lambda c: both.select("data_id", F.posexplode(c).alias("idx", "s")).select("data_id", "idx", "s.id", "s.description")
    assert evaluate.matched_pairs(told, people("annotation_A"), people("annotation_B")).count() == 2
    side = lambda c: both.select("data_id", F.posexplode(c).alias("subject_id", "s")).select("data_id", "subject_id", F.posexplode("s.PIIs").alias("pos", "p")).select("data_id", "subject_id", "p.tag", "pos", "p.keyword", "p.certainty", "p.hardness")
    out = evaluate.evaluate_ground_truth(side("annotation_A"), side("annotation_B"))
    r = out["privacy"].collect()[0]
    assert (r["num_subjects"], r["num_pii"], r["ipr"], r["cpr"]) == (2, 4, 0.5, 0.5)
    assert out["statistics"].collect()[0]["total_matches"] == 2 and scoring.nested_evaluations(out["evaluations"]).count() == 2


def test_windows_of_stream_and_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.once_each(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "event_id", "ts", "4000 days")
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r)[:4] for r in incremental.windowed_counts(events).collect())
    assert sorted(tuple(r)[:4] for r in incremental.windowed_counts(spark.table("seen")).collect()) == want
    q = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), delay="4000 days").writeStream.format("memory").outputMode("complete").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r)[:4] for r in spark.table("windows").collect()) == want

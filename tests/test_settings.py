"""Backends by settings, paths of results, and runs of judges and deciders."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe import backends
from veilframe.operators import scoring
from veilframe.plans import evaluate, utility
from veilframe.sources.jsonl import result_path
from veilframe.sources.ledger import Ledger


def test_settings_choose_provider_and_model(tmp_path, monkeypatch):
    b = backends.configured({})
    assert (b.provider, b.model, b.url) == ("openai", "gpt-4.1", "https://api.openai.com/v1/chat/completions")
    b = backends.configured({"DEFAULT_API_PROVIDER": "openai", "DEFAULT_MODEL_NAME": "Claude-x"}, temperature=None)
    assert b.provider == "anthropic" and b.url.endswith("/v1/messages") and json.loads(b.request("p").data)["max_tokens"] == 4096
    b = backends.configured({"OLLAMA_BASE_URL": "http://host:1/"}, "ollama", "llama3.1:8b", top_p=0.5)
    assert b.url == "http://host:1/v1/chat/completions" and json.loads(b.request("p").data)["top_p"] == 0.5
    with pytest.raises(ValueError, match="unknown provider"):
        backends.configured({}, "other")
    monkeypatch.setenv("DEFAULT_MODEL_NAME", "gpt-5-mini")
    assert "temperature" not in json.loads(backends.configured().request("p").data)
    file = tmp_path / ".env"
    file.write_text("# keys\nDEFAULT_API_PROVIDER=ollama\nexport DEFAULT_MODEL_NAME='a b' \n\nOLLAMA_BASE_URL=\"http://h#1\"\nX=1 # one\nnothing\n")
    assert backends.read_settings(str(file)) == {"DEFAULT_API_PROVIDER": "ollama", "DEFAULT_MODEL_NAME": "a b", "OLLAMA_BASE_URL": "http://h#1", "X": "1"}
    assert backends.configured(backends.read_settings(str(file))).model == "a b"


@pytest.mark.parametrize(
    "source, want",
    [
        ("/in/Panorama/x.jsonl", "/out/panorama/x_m_1.jsonl"),
        ("tab_run.jsonl", "/out/tab/tab_run_m_1.jsonl"),
        ("/in/other/x.y.json", "/in/other/x.y_m_1.jsonl"),
        ("plain", "plain_m_1.jsonl"),
        ("/plain", "/plain_m_1.jsonl"),
        ("s3://b/panorama/tab.json", "/out/panorama/tab_m_1.jsonl"),
    ],
)
def test_results_go_to_their_dataset(source, want):
    assert result_path(source, "/out/", "m", "1") == want


def test_decisions_are_asked_once(spark, tmp_path):
    """Two keys with one pair of values are one question; the order of truth matters to the prompt alone."""
    rows = [(1, 0, "OCCUPATION", "baker", "cook"), (2, 0, "OCCUPATION", "baker", "cook"), (3, 0, "OCCUPATION", "baker", "baker"), (4, 0, "OCCUPATION", "", "cook"), (5, 0, "OCCUPATION", None, "cook")]
    pairs = spark.createDataFrame(rows, "data_id long, subject_id int, tag string, keyword_a string, keyword_b string")
    ledger = Ledger(spark, str(tmp_path / "l"))
    got = evaluate.decide(scoring.rule_scores(pairs), backends.Stub(lambda p: "yes" if "same as the truth" in p else "no"), ledger=ledger)
    assert {(r["keyword_a"], r["answer"], r["method"]) for r in got.collect()} >= {("baker", "yes", "MODEL")}
    assert ledger.answers("agree-truth").where(F.col("status") == "success").count() == len({(r["keyword_a"] or "", r["keyword_b"]) for r in got.collect()})


def test_utility_without_a_judge_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a", None), (3, None, "x"), (4, "", "")], "data_id long, text string, anonymized_text string")
    run = utility.evaluate(docs)
    scores = {r["data_id"]: (r["utility_model"], round(r["utility_comb"], 6)) for r in run["scores"].collect()}
    assert scores == {1: (None, 1.0), 4: (None, 0.0)}
    assert sorted((r["data_id"], r["error_type"]) for r in run["errors"].collect()) == [(2, "missing_text"), (3, "missing_text")]
    assert run["summary"].first()["num_samples"] == 2
    none = utility.evaluate(docs.limit(0), backends.Stub(lambda p: "x"))
    assert none["scores"].count() == none["errors"].count() == 0

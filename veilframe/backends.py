"""Model calls: a protocol, a replay table, a deterministic stub and an HTTP client.

Prompts are a column; ``call`` runs a backend over them in ``mapInPandas`` with
a few threads a task, and its result must be written before it is used twice;
``sources.ledger`` does that and asks each prompt once.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.ledger import Ledger, ask_one

#: Answer lengths that a provider allows, by model, the first prefix that fits (fixed values).
MAX_TOKENS = {
    "claude-opus-4": 32000, "claude-opus-4.1": 32000, "claude-opus-4-5": 64000, "claude-sonnet-4": 64000, "claude-sonnet-4-5": 64000, "claude-3-7-sonnet": 64000,
    "claude-3-5-sonnet": 8192, "claude-3-5-haiku": 8192, "claude-3-haiku": 4096, "claude-3-opus": 4096, "claude-3-sonnet": 4096,
}
DEFAULT_MAX_TOKENS = 32000
#: Models that take no temperature (fixed values).
NO_TEMPERATURE = ("gpt-5-nano", "gpt-5-mini", "gpt-5")


def max_tokens(model: str) -> int:
    return MAX_TOKENS.get(model) or next((n for k, n in MAX_TOKENS.items() if model.startswith(k)), DEFAULT_MAX_TOKENS)


class Backend(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Stub:
    """A backend that answers by a function of the prompt; a limit counts words."""

    answer: Callable[[str], str]
    limit: int | None = None

    def limited(self, tokens: int) -> Stub:
        return replace(self, limit=tokens)

    def __call__(self, prompt: str) -> str:
        words = self.answer(prompt)
        return words if self.limit is None else " ".join(words.split(" ")[: self.limit])


@dataclass(frozen=True)
class Http:
    """A chat endpoint: ``openai`` or ``ollama`` (chat completions) or ``anthropic`` (messages).

    Keys come from the environment of the executors (OPENAI_API_KEY or
    ANTHROPIC_API_KEY); a model named claude* is always sent as anthropic.
    """

    url: str
    model: str
    provider: str = "openai"
    temperature: float | None = 0.1
    top_p: float | None = None
    limit: int | None = None
    timeout: float = 300.0
    attempts: int = 3
    pause: float = 10.0

    def limited(self, tokens: int) -> Http:
        return replace(self, limit=tokens)

    def request(self, prompt: str) -> urllib.request.Request:
        provider = "anthropic" if "claude" in self.model.lower() else self.provider
        body: dict = {"model": self.model, "messages": [{"role": "user", "content": prompt}]}
        if self.temperature is not None and self.model not in NO_TEMPERATURE:
            body["temperature"] = min(self.temperature, 1.0) if provider == "anthropic" else self.temperature
        if self.top_p is not None:
            body["top_p"] = self.top_p
        if provider == "anthropic":
            body["max_tokens"] = min(self.limit or 4096, max_tokens(self.model))
        elif self.limit:
            body["max_tokens"] = self.limit
        headers = {"Content-Type": "application/json"}
        if provider == "anthropic":
            headers |= {"x-api-key": os.environ.get("ANTHROPIC_API_KEY", ""), "anthropic-version": "2023-06-01"}
        elif key := os.environ.get("OPENAI_API_KEY"):
            headers["Authorization"] = f"Bearer {key}"
        return urllib.request.Request(self.url, json.dumps(body).encode(), headers)

    def __call__(self, prompt: str) -> str:
        for left in range(self.attempts - 1, -1, -1):
            try:
                with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as r:
                    got = json.load(r)
                return got["content"][0]["text"] if "content" in got else got["choices"][0]["message"]["content"]
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause)
        raise AssertionError


#: Where each provider answers; the last one's host is a setting.
ENDPOINTS = {"openai": "https://api.openai.com/v1/chat/completions", "anthropic": "https://api.anthropic.com/v1/messages", "ollama": "{OLLAMA_BASE_URL}/v1/chat/completions"}
#: Settings and what they are where nothing is set (fixed values).
DEFAULTS = {"DEFAULT_API_PROVIDER": "openai", "DEFAULT_MODEL_NAME": "gpt-4.1", "OLLAMA_BASE_URL": "http://localhost:11434"}


def read_settings(path: str) -> dict[str, str]:
    """The ``NAME=value`` lines of a settings file; comments, quotes around values and ``export`` before names go."""
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and not name.lstrip().startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                found[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return found


def configured(settings: Mapping[str, str] | None = None, provider: str | None = None, model: str | None = None, **more) -> Http:
    """A backend as settings say (the environment, if none are given): provider, model and, for a local server, its address.

    Models named claude* always go to ``anthropic``; an unknown provider raises.
    Keys stay in the executors' environment.  ``more``: other fields of ``Http``.
    """
    known = {**DEFAULTS, **{k: v for k, v in (os.environ if settings is None else settings).items() if k in DEFAULTS and v}}
    provider, model = provider or known["DEFAULT_API_PROVIDER"], model or known["DEFAULT_MODEL_NAME"]
    if provider not in ENDPOINTS:
        raise ValueError(f"unknown provider {provider}, not one of {', '.join(ENDPOINTS)}")
    if "claude" in model.lower():
        provider = "anthropic"
    url = ENDPOINTS[provider].format(OLLAMA_BASE_URL=known["OLLAMA_BASE_URL"].rstrip("/"))
    return Http(url, model, provider, **more)


def call(df: DataFrame, backend: Backend, prompt: str = "prompt", threads: int = 20, partitions: int | None = None, limit: str | None = None) -> DataFrame:
    """Adds status and response.  A failed call is a row with status ``error`` and the message.

    ``limit`` names a column with the most tokens that a row's answer may have; it
    needs a backend with ``limited``.
    """
    if partitions:
        df = df.repartition(partitions)

    def one(text, most=None):
        return ("error", "no prompt") if text is None else ask_one(backend, text, most)

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[prompt].tolist(), *([pdf[limit].tolist()] if limit else [])))
                yield pdf.assign(status=[s for s, _ in got], response=pd.Series([r for _, r in got], index=pdf.index, dtype=object))

    schema = df.withColumn("status", F.lit("")).withColumn("response", F.lit("")).schema
    return df.mapInPandas(run, schema)


def replay(df: DataFrame, answers: DataFrame, key: str = "data_id") -> DataFrame:
    """Adds status and response from a table of saved answers (key, response)."""
    saved = answers.select(key, F.col("response")).dropDuplicates([key])
    return df.join(saved, key, "left").withColumn("status", F.when(F.col("response").isNull(), "error").otherwise("success"))


def cached_call(df: DataFrame, saved: DataFrame, backend: Backend, key: str = "data_id", prompt: str = "prompt", ledger: Ledger | None = None, stage: str = "call") -> DataFrame:
    """Saved responses where there are any, calls through ``ledger`` for the rest."""
    said = saved.select(key, F.col("response").alias("_saved")).dropDuplicates([key])
    both = df.join(said, key, "left")
    asked = (ledger or Ledger(df.sparkSession)).ask(both.withColumn("_prompt", F.when(F.col("_saved").isNull(), F.col(prompt))), backend, stage, "_prompt")
    known = F.col("_saved").isNotNull()
    return asked.withColumn("status", F.when(known, "success").otherwise(F.col("status"))).withColumn("response", F.coalesce("_saved", "response")).drop("_saved", "_prompt")

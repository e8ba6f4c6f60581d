"""Anonymizers as stages over documents (data_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import prompts
from veilframe.functions.parse import after_marker
from veilframe.functions.text import apply_masks, length_check
from veilframe.sources.ledger import Ledger

#: What the rule-based detector looks for and as which type (this project's own patterns).
RULES = (
    ("CODE", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CODE", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("CODE", r"[0-9]{16}"),
    ("CODE", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
)
PATTERN = "|".join(p for _, p in RULES)


def finish(df: DataFrame) -> DataFrame:
    """Length columns and an error for empty results."""
    empty = F.coalesce(F.trim("anonymized_text") == "", F.lit(True))
    return df.withColumn("_l", length_check(F.col("text"), F.col("anonymized_text"))).select(*[c for c in df.columns], "_l.*").withColumn("error", F.when(empty, "empty anonymization"))


def by_rules(documents: DataFrame) -> DataFrame:
    """Masks what the patterns find; no model."""
    from veilframe.functions.text import pieces

    spans = F.transform(pieces(F.col("text"), PATTERN), lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"), F.lit("CODE").alias("entity_type")))
    return finish(documents.withColumn("anonymized_text", apply_masks(F.col("text"), spans)))


def masked(text: Column, spans: Column) -> Column:
    """A text without its spans (start_offset, end_offset, entity_type)."""
    return apply_masks(text, spans)


def by_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Masks given spans (data_id, start_offset, end_offset, entity_type)."""
    g = spans.groupBy("data_id").agg(F.collect_list(F.struct("start_offset", "end_offset", "entity_type")).alias("spans"))
    none = F.array().cast("array<struct<start_offset:int,end_offset:int,entity_type:string>>")
    return finish(documents.join(g, "data_id", "left").withColumn("anonymized_text", apply_masks(F.col("text"), F.coalesce("spans", none))).drop("spans"))


def by_model(documents: DataFrame, backend, method: str = "redact", ledger: Ledger | None = None, attempts: int = 1) -> DataFrame:
    """``redact`` or ``paraphrase`` by a model, asked through ``ledger``; failed calls are errors with an empty text.

    A paraphrase may have as many tokens as half the text's characters, half
    again as many, and 50.
    """
    text, ledger = F.col("text"), ledger or Ledger(documents.sparkSession)
    prompt = {"redact": prompts.redact, "paraphrase": prompts.paraphrase}[method](text)
    asked = documents.withColumn("prompt", prompt)
    if method == "paraphrase":
        most = F.floor(F.floor(F.length(text) / 2) * 1.5).cast("int") + 50
        got = ledger.ask(asked.withColumn("_most", F.coalesce(most, F.lit(50))), backend, method, limit="_most", attempts=attempts).drop("_most")
    else:
        got = ledger.ask(asked, backend, method, attempts=attempts)
    return finish(got.withColumn("anonymized_text", F.when(F.col("status") == "success", F.col("response")).otherwise("")).drop("prompt", "response", "status"))


def adversarial(documents: DataFrame, attacker, defender, rounds: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Rounds of guessing and rewriting, asked through ``ledger``: a round that is run again asks nothing twice."""
    ledger = ledger or Ledger(documents.sparkSession)
    now = documents.withColumn("anonymized_text", F.col("text")).withColumn("rounds", F.array().cast("array<struct<round:int,inferences:string,text:string>>"))
    for r in range(1, rounds + 1):
        guessed = ledger.ask(now.withColumn("prompt", prompts.infer(F.col("anonymized_text"))), attacker, f"guess-{r}").withColumnRenamed("response", "inferences").drop("status", "prompt")
        told = ledger.ask(guessed.withColumn("prompt", prompts.anonymize(F.col("anonymized_text"), F.col("inferences"))), defender, f"rewrite-{r}")
        text = F.when(F.col("status") == "success", after_marker(F.col("response"))).otherwise(F.col("anonymized_text"))
        step = F.struct(F.lit(r).alias("round"), "inferences", text.alias("text"))
        now = told.withColumn("rounds", F.array_append("rounds", step)).withColumn("anonymized_text", text).drop("prompt", "response", "status", "inferences")
    return finish(now)

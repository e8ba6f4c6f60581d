"""Utility of anonymized texts: overlap with the original and a judge's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import prompts
from veilframe.functions.parse import judged_utility
from veilframe.functions.similarity import bleu_udf, rouge_udf
from veilframe.operators import stats
from veilframe.sources.folders import work_folder, written
from veilframe.sources.ledger import Ledger


def overlap_scores(documents: DataFrame) -> DataFrame:
    """bleu and rouge of the documents that have both texts."""
    pairs = documents.where("text is not null and anonymized_text is not null")
    return pairs.withColumn("bleu", bleu_udf("text", "anonymized_text")).withColumn("_r", rouge_udf("text", "anonymized_text")).select(*pairs.columns, "bleu", "_r.*")


def missing_texts(documents: DataFrame) -> DataFrame:
    return documents.where("text is null or anonymized_text is null").select("data_id", F.when(F.col("text").isNull(), "missing text").otherwise("missing anonymized text").alias("error"))


def combine(scores: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """utility_model and utility_comb; without a judge the latter is ROUGE-L alone."""
    if judged is None:
        return scores.withColumn("readability", F.lit(None).cast("double")).withColumn("meaning", F.lit(None).cast("double")).withColumn("hallucination", F.lit(None).cast("double")).withColumn("utility_model", F.lit(None).cast("double")).withColumn("utility_comb", F.col("rougeL"))
    j = judged.select("data_id", judged_utility(F.col("response")).alias("_j")).select("data_id", "_j.*")
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(10.0)) / 10
    both = scores.join(j, "data_id", "left")
    rouge = F.least(F.greatest(F.col("rougeL"), F.lit(0.0)), F.lit(1.0))
    return both.withColumn("utility_model", (unit("readability") + unit("meaning")) / 2).withColumn("utility_comb", F.coalesce((unit("readability") + unit("meaning") + rouge) / 3, F.col("rougeL")))


def evaluate(documents: DataFrame, backend=None, ledger: Ledger | None = None, attempts: int = 1) -> dict[str, DataFrame]:
    """Utility of documents (data_id, text, anonymized_text) as one run, with a judge where there is a backend.

    Returns scores (a row per document that has both texts), errors (missing
    texts and failed calls of the judge, whose documents keep their overlap
    scores) and summary (``stats.utility_aggregate``).  The judge is asked through
    ``ledger``, once a pair of texts.
    """
    spark = documents.sparkSession
    docs = documents.select("data_id", "text", "anonymized_text")
    scores = written(overlap_scores(docs), work_folder(spark), "scores")
    lost = missing_texts(docs).select("data_id", F.lit("missing_text").alias("error_type"), "error")
    judged = None
    if backend is not None:
        asked = scores.select("data_id", prompts.judge(F.col("text"), F.col("anonymized_text")).alias("prompt"))
        told = (ledger or Ledger(spark)).ask(asked, backend, "judge", attempts=attempts).drop("prompt")
        told = written(told, work_folder(spark), "judged")
        judged = told.where("status = 'success'").dropDuplicates(["data_id"])
        lost = lost.unionByName(told.where("status <> 'success'").select("data_id", F.lit("judge").alias("error_type"), F.col("response").alias("error")))
    out = combine(scores, judged)
    return {"scores": out, "errors": lost, "summary": stats.utility_aggregate(out)}

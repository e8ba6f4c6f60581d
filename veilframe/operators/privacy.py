"""Protection rates of subjects and corpora, from the long evaluations table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subject_protection(evaluations: DataFrame, k: int = 3) -> DataFrame:
    """attributes, score_sum and protection of each subject; null protection without attributes of certainty >= k."""
    counted = F.col("certainty_a") >= k
    return evaluations.groupBy("data_id", "subject_id").agg(
        F.count(F.when(counted, 1)).alias("attributes"), F.coalesce(F.sum(F.when(counted, F.col("agreement_score"))), F.lit(0.0)).alias("score_sum")
    ).withColumn("protection", F.when(F.col("attributes") > 0, 1 - F.col("score_sum") / F.col("attributes")))


def _ratio(score, n):
    return F.coalesce(F.when(n > 0, 1 - score / n), F.lit(0.0))


def ipr_cpr(evaluations: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Individual and collective protection rate, overall or ``by`` columns of the documents."""
    subjects = subject_protection(evaluations, k)
    return subjects.groupBy(*(by or [])).agg(
        F.count("protection").alias("num_subjects"),
        F.coalesce(F.sum("attributes"), F.lit(0)).alias("num_pii"),
        F.coalesce(F.avg("protection"), F.lit(0.0)).alias("ipr"),
        _ratio(F.sum("score_sum"), F.sum("attributes")).alias("cpr"),
    )


def cpr_by_tag(evaluations: DataFrame, k: int = 3) -> DataFrame:
    return evaluations.where(F.col("certainty_a") >= k).groupBy("tag").agg(
        _ratio(F.sum("agreement_score"), F.count(F.lit(1))).alias("cpr"), F.count(F.lit(1)).alias("num_pii"), F.sum("agreement_score").alias("score_sum")
    )


def cpr_grouping_sets(evaluations: DataFrame, k: int = 3) -> DataFrame:
    """Collective protection by tag and overall (tag null), in one pass."""
    return evaluations.where(F.col("certainty_a") >= k).rollup("tag").agg(_ratio(F.sum("agreement_score"), F.count(F.lit(1))).alias("cpr"), F.count(F.lit(1)).alias("num_pii"))


def cpr_by_file(evaluations: DataFrame, k: int = 3) -> DataFrame:
    """One row for each report file, in order of baseline and model."""
    per_subject = evaluations.where(F.col("certainty_a") >= k).groupBy("file", "baseline", "model", "data_id", "subject_id").agg(F.count(F.lit(1)).alias("n"), F.sum("agreement_score").alias("s"))
    return per_subject.groupBy("file", "baseline", "model").agg(F.avg(1 - F.col("s") / F.col("n")).alias("ipr"), _ratio(F.sum("s"), F.sum("n")).alias("cpr"), F.sum("n").alias("num_pii")).orderBy("baseline", "model")

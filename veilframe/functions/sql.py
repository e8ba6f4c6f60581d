"""The similarity functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilframe.functions.similarity import bleu_udf, jaro_winkler_udf, rouge_l_udf


def register(spark: SparkSession) -> None:
    """Temporary functions jaro_winkler(a, b), bleu(reference, candidate) and rouge_l(reference, candidate)."""
    for name, f in (("jaro_winkler", jaro_winkler_udf), ("bleu", bleu_udf), ("rouge_l", rouge_l_udf)):
        spark.udf.register(name, f)

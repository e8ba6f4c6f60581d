"""Tag-by-tag agreement of two annotations of the same subjects.

Annotations are long tables: data_id, subject_id, tag, pos, keyword, certainty,
hardness.  The best pair of a tag is the first one, by position, of the highest
score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.agreement import needs_similarity, rule_outcome
from veilframe.functions.similarity import jaro_winkler_udf
from veilframe.functions.text import plain

KEYS = ["data_id", "subject_id", "tag"]
SUBJECT = ["data_id", "subject_id"]


def with_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity`` where string similarity decides, null elsewhere.

    The comparison runs in place: rows that rules decide send nulls to Python, a
    batch compares each distinct pair once, and the join's partitioning stays as
    the windows after it need it (joining distinct pairs back took two shuffles
    more and ran the join twice).
    """
    a, b = F.coalesce("keyword_a", F.lit("")), F.coalesce("keyword_b", F.lit(""))
    wanted = needs_similarity(a, b, F.col("tag"))
    return pairs.withColumn("similarity", jaro_winkler_udf(F.when(wanted, plain(a)), F.when(wanted, plain(b))))


def rule_scores(pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Adds ``score``, ``error`` and ``method`` by rules alone."""
    out = rule_outcome(F.col("keyword_a"), F.col("keyword_b"), F.col("tag"), F.col("similarity"), max_depth)
    return with_similarity(pairs).withColumn("_o", out).withColumn("score", F.col("_o.score")).withColumn("error", F.col("_o.error")).withColumn("method", F.lit("RULE")).drop("_o", "similarity")


def decided(scored: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Second opinions for pairs that the rules score 0.

    ``decisions`` has keyword_a, keyword_b, tag, answer (yes, less precise, no
    or null) and method (MODEL or HUMAN): a model's parsed answers or a table of
    human ones, one row for each distinct pair asked.  A pair without an answer
    keeps 0 and counts as MODEL.
    """
    if decisions is None:
        return scored
    d = decisions.select("keyword_a", "keyword_b", "tag", F.col("answer").alias("_answer"), F.col("method").alias("_method")).dropDuplicates(["keyword_a", "keyword_b", "tag"])
    told = F.when(F.col("_answer") == "yes", 1.0).when(F.col("_answer") == "less precise", 0.5).otherwise(0.0)
    zero = (F.col("score") == 0) & ~F.col("error")
    return scored.join(d, ["keyword_a", "keyword_b", "tag"], "left").withColumn("method", F.when(zero, F.coalesce("_method", F.lit("MODEL"))).otherwise(F.col("method"))).withColumn("score", F.when(zero, told).otherwise(F.col("score"))).drop("_answer", "_method")


def questions(scored: DataFrame) -> DataFrame:
    """The distinct pairs that a model or a person has to judge."""
    return scored.where((F.col("score") == 0) & ~F.col("error")).select("keyword_a", "keyword_b", "tag").distinct()


def best_pairs(scored: DataFrame) -> DataFrame:
    """The best pair of each tag: highest score, then first places; ``error`` if any pair of the tag failed, whichever is best.

    One aggregation, which combines pairs before they are shuffled.
    """
    last = lambda c: F.coalesce(-F.col(c).cast("long"), F.lit(-(1 << 40)))
    rest = [c for c in scored.columns if c not in (*KEYS, "error")]
    best = F.max_by(F.struct(*rest), F.struct("score", last("pos_a"), last("pos_b")))
    return scored.groupBy(*KEYS).agg(best.alias("_b"), F.max("error").alias("error")).select(*KEYS, "_b.*", "error")


def _verdict(df: DataFrame) -> DataFrame:
    return df.select(
        *KEYS,
        "keyword_a",
        F.coalesce("keyword_b", F.lit("")).alias("keyword_b"),
        "certainty_a",
        F.coalesce("certainty_b", F.lit(0)).alias("certainty_b"),
        "hardness_a",
        F.coalesce("hardness_b", F.lit(0)).alias("hardness_b"),
        F.col("score").alias("agreement_score"),
        F.col("method").alias("evaluation_method"),
        (F.col("score") >= 1).alias("match"),
        ((F.col("score") > 0) & (F.col("score") < 1)).alias("less_precise"),
        (F.col("score") == 0).alias("mismatch"),
        F.col("error"),
    )


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*KEYS, *(F.col(c).alias(f"{c}_{side}") for c in ("pos", "keyword", "certainty", "hardness")))


def drop_failed_subjects(evaluations: DataFrame) -> DataFrame:
    """Without every subject of which any comparison failed."""
    failed = F.max(F.col("error").cast("int")).over(Window.partitionBy(*SUBJECT))
    return evaluations.withColumn("_failed", failed).where("_failed = 0").drop("_failed", "error")


def failed_subjects(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("error").select(*SUBJECT, "tag", "keyword_a", "keyword_b").distinct()


def gt_evaluations(a: DataFrame, b: DataFrame, tags=None, max_depth: int | None = None, decisions: DataFrame | None = None, keep_errors: bool = False) -> DataFrame:
    """Ground truth (a) against a model's annotation (b), one row per subject and tag.

    Tags with a value in ``a`` count; values of ``b`` without certainty don't.
    """
    left = _sided(a.where("keyword <> ''"), "a")
    if tags:
        left = left.where(F.col("tag").isin(*tags))
    pairs = left.join(_sided(b.where("certainty <> 0"), "b"), KEYS, "left")
    alone = F.col("pos_b").isNull()
    scored = decided(rule_scores(pairs, max_depth), decisions)
    scored = scored.withColumn("score", F.when(alone, 0.0).otherwise(F.col("score"))).withColumn("method", F.when(alone, "RULE").otherwise(F.col("method")))
    best = _verdict(best_pairs(scored))
    return best if keep_errors else drop_failed_subjects(best)


def inter_evaluations(a: DataFrame, b: DataFrame, min_certainty: int = 0, tags=None, max_depth: int | None = None, decisions: DataFrame | None = None, keep_errors: bool = False) -> DataFrame:
    """Two annotators, over the union of their tags.

    A tag is skipped if the first value of either side is below
    ``min_certainty``.  A tag that only b has, or only a below that certainty,
    fails its subject, as there is no first value to look at.
    """
    left, right = _sided(a, "a"), _sided(b, "b")
    if tags:
        left, right = left.where(F.col("tag").isin(*tags)), right.where(F.col("tag").isin(*tags))
    first_a = left.groupBy(*KEYS).agg(F.min_by("certainty_a", "pos_a").alias("first_a"))
    first_b = right.groupBy(*KEYS).agg(F.min_by("certainty_b", "pos_b").alias("first_b"))
    heads = first_a.join(first_b, KEYS, "full")
    failed = heads.where("first_a is null or (first_b is null and first_a < {})".format(int(min_certainty)))
    used = heads.where(f"first_a >= {int(min_certainty)} or first_b >= {int(min_certainty)}").where("first_a is not null")
    pairs = used.join(left, KEYS).join(right, KEYS, "left").where("pos_b is null or certainty_a <> 0 or certainty_b <> 0").drop("first_a", "first_b")
    alone = F.col("pos_b").isNull()
    scored = decided(rule_scores(pairs, max_depth), decisions)
    scored = scored.withColumn("score", F.when(alone, 0.0).otherwise(F.col("score"))).withColumn("method", F.when(alone, "RULE").otherwise(F.col("method")))
    best = _verdict(best_pairs(scored))
    lost = failed.select(*KEYS)
    for c in best.columns[len(KEYS) : -1]:
        lost = lost.withColumn(c, F.lit(None).cast(dict(best.dtypes)[c]))
    best = best.unionByName(lost.withColumn("error", F.lit(True)))
    return best if keep_errors else drop_failed_subjects(best)


def nested_evaluations(evaluations: DataFrame) -> DataFrame:
    """One row per document with the report's nested form of the long table."""
    names = ["keyword_A", "keyword_B", "certainty_A", "certainty_B", "hardness_A", "hardness_B", "agreement_score", "evaluation_method", "match", "less_precise", "mismatch"]
    entry = F.struct(*(F.col(n.lower()).alias(n) for n in names))
    subjects = evaluations.groupBy(*SUBJECT).agg(F.map_from_entries(F.collect_list(F.struct("tag", entry))).alias("evaluations"))
    return subjects.groupBy("data_id").agg(F.sort_array(F.collect_list(F.struct("subject_id", F.to_json("evaluations").alias("evaluations")))).alias("subjects"))


def long_evaluations(report: DataFrame) -> DataFrame:
    """The long table of a report read from its JSON file."""
    doc = report.select(F.explode("detailed_results").alias("d")).select("d.data_id", F.explode("d.subjects").alias("s"))
    flat = doc.select("data_id", F.col("s.subject_id").alias("subject_id"), F.explode("s.evaluations").alias("tag", "e"))
    return flat.select(*KEYS, *(F.col(f"e.{n}").alias(n.lower()) for n in ("keyword_A", "keyword_B", "certainty_A", "certainty_B", "hardness_A", "hardness_B", "agreement_score", "evaluation_method", "match", "less_precise", "mismatch")))

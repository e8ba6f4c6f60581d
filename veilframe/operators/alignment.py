"""Joins of document collections and person-by-person alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key by ``ordinal``; rows without a key go."""
    others = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def inner_by_id(left: DataFrame, right: DataFrame, key: str, suffixes=("_a", "_b")) -> DataFrame:
    """Equal ids of two collections; other columns get a side's suffix."""
    a = left.select(key, *(F.col(c).alias(c + suffixes[0]) for c in left.columns if c != key))
    b = right.select(key, *(F.col(c).alias(c + suffixes[1]) for c in right.columns if c != key))
    return a.join(b, key)


def with_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every id of either collection and where it stands: both, A or B."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "B").when(F.col("_b").isNull(), "A").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def split_matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` with their partner, ids of ``left`` without one)."""
    return left.where(F.col(key).isNotNull()).join(right, key), left.where(F.col(key).isNotNull()).join(right, key, "left_anti").select(key)


def annotator_pairs(rows: DataFrame, key: str, annotator: str, value: str) -> DataFrame:
    """Documents of exactly two annotators, A the first by name; n tells how many there were."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, annotator).alias("value_a"), F.max_by(value, annotator).alias("value_b"), F.min(annotator).alias("annotator_a"), F.max(annotator).alias("annotator_b"))
    return g.where("n = 2 and annotator_a <> annotator_b").drop("n")


def annotator_violations(rows: DataFrame, key: str) -> DataFrame:
    """Documents that don't have exactly two annotations."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n <> 2")


def count_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Documents whose two annotations have different numbers of subjects."""
    return a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b")), key).where("n_a <> n_b")


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("is_duplicate", F.col("n") > 1)


def description_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-cased word sets; 0 if either is empty."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))

    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def valid_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs whose ids (digits only) exist on both sides, the first of each a id.

    ``pairs``: data_id, pos, a_id, b_id; ``a`` and ``b``: data_id, idx, id.
    Returns data_id, pos, a_idx, b_idx.
    """
    digits = pairs.select("data_id", "pos", F.regexp_replace("a_id", "[^0-9]", "").alias("a_id"), F.regexp_replace("b_id", "[^0-9]", "").alias("b_id"))
    left = a.groupBy("data_id", F.col("id").alias("a_id")).agg(F.max("idx").alias("a_idx"))
    right = b.groupBy("data_id", F.col("id").alias("b_id")).agg(F.max("idx").alias("b_idx"))
    known = digits.join(left, ["data_id", "a_id"]).join(right, ["data_id", "b_id"])
    return keep_first(known, ["data_id", "a_id"], "pos").select("data_id", "pos", "a_idx", "b_idx")


def align_gt(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched subjects in pair order, then those of ``a`` alone, numbered from 0 in each document."""
    left = a.select("data_id", F.col("idx").alias("a_idx"), F.col("description").alias("description_a"))
    right = b.select("data_id", F.col("idx").alias("b_idx"), F.col("description").alias("description_b"))
    both = left.join(pairs, ["data_id", "a_idx"], "left").join(right, ["data_id", "b_idx"], "left")
    order = Window.partitionBy("data_id").orderBy(F.col("pos").isNull(), "pos", "a_idx")
    return both.select("data_id", (F.row_number().over(order) - 1).alias("subject_id"), F.col("pos").isNotNull().alias("matched"), "a_idx", "b_idx", F.col("description_a").alias("description"))


def align_full(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched subjects, those of a alone, those of b alone, numbered in that order."""
    left = a.select("data_id", F.col("idx").alias("a_idx"), F.col("description").alias("description_a"))
    right = b.select("data_id", F.col("idx").alias("b_idx"), F.col("description").alias("description_b"))
    first = left.join(pairs, ["data_id", "a_idx"], "left").join(right, ["data_id", "b_idx"], "left")
    rest = right.join(pairs.select("data_id", "b_idx").distinct(), ["data_id", "b_idx"], "left_anti")
    every = first.select("data_id", "pos", "a_idx", "b_idx", F.col("description_a").alias("description")).unionByName(
        rest.select("data_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("a_idx"), "b_idx", F.col("description_b").alias("description"))
    )
    side = F.when(F.col("pos").isNotNull(), F.lit(None)).when(F.col("a_idx").isNotNull(), "A").otherwise("B")
    order = Window.partitionBy("data_id").orderBy(F.when(F.col("pos").isNotNull(), 0).when(F.col("a_idx").isNotNull(), 1).otherwise(2), "pos", F.coalesce("a_idx", "b_idx"))
    return every.select("data_id", (F.row_number().over(order) - 1).alias("subject_id"), F.col("pos").isNotNull().alias("matched"), side.alias("unmatched_side"), "a_idx", "b_idx", "description")


def blank_piis(piis: Column) -> Column:
    """The same tags without values: what the missing side of an unmatched subject gets."""
    return F.transform(piis, lambda p: F.struct(p["tag"].alias("tag"), F.lit("").alias("keyword"), F.lit(0).alias("certainty"), F.lit(0).alias("hardness")))


def prefer_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """Merge of two profiles (data_id, subject_id, tag, keyword, certainty, hardness).

    Of each subject and tag the second profile's value wins if it is certain,
    else the first one's; a subject or tag of one side alone stays.
    """
    keys = ["data_id", "subject_id", "tag"]
    a = first.select(*keys, F.struct("keyword", "certainty", "hardness").alias("x"))
    b = second.select(*keys, F.struct("keyword", "certainty", "hardness").alias("y"))
    pick = F.when(F.col("y.certainty") > 0, F.col("y")).otherwise(F.coalesce("x", "y"))
    return a.join(b, keys, "full").select(*keys, pick.alias("p")).select(*keys, "p.keyword", "p.certainty", "p.hardness")


def resume(documents: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that have no successful result yet."""
    return documents.join(done.select(key).distinct(), key, "left_anti")


def renumber(df: DataFrame, group: list[str], order: list[str], name: str = "subject_id") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)

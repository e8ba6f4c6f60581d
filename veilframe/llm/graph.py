"""Connected components over a table of links, never gathered in one place."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_path, stored


def with_least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with the smallest v of each u as m.

    The least is aggregated before the shuffle and joined, so that adaptive
    execution can deal the links of a busy node over several tasks, as it can't
    for a window.
    """
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """(node, comp) of every node that has a link; comp is its component's smallest node.

    Alternates large-star and small-star steps: each moves every neighbour of a
    node to the smallest one, until nothing changes, however many rounds that
    takes (their number grows with the logarithm of the longest path).  Each
    round is written to ``folder``, and the one before it dropped.
    """
    spark = links.sparkSession
    u, v = F.col("u"), F.col("v")

    def state_of(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(links.toDF("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), folder, f"{name}-0")
    state, past = state_of(now), f"{folder}/{name}-0"
    for i in itertools.count(1):
        if not state[0]:
            break
        both = now.unionAll(now.select(v.alias("u"), u.alias("v")))
        large = with_least(both).withColumn("m", F.least(u, "m")).where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = with_least(large)
        small = stars.select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = stored(small, folder, f"{name}-{i}")
        drop_path(spark, past)
        past = f"{folder}/{name}-{i}"
        got = state_of(now)
        if got == state:
            break
        state = got
    return now.select(F.col("u").alias("node"), v.alias("comp")).unionAll(now.select(v.alias("node"), v.alias("comp")).distinct())

"""Several outputs as one commit, and counts kept up batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import counts, stats
from veilframe.sources import release
from veilframe.sources.jsonl import is_anonymized, same_dataset

ROW = "data_id long, gt_subjects long, llm_subjects long, matched long, gt_only_piis long, llm_only_piis long, gt_only_ids array<string>, llm_only_ids array<string>"


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "r")
    assert release.manifest(spark, root) is None
    with pytest.raises(LookupError):
        release.read(spark, root, "a")
    one = {n: spark.range(3).withColumn("n", F.lit(n)) for n in ("a", "b", "c")}
    assert release.publish(spark, root, one) == 1
    for stop in ("b", "c"):
        bad = {n: spark.range(9) for n in one} | {stop: spark.range(3).select(F.raise_error(F.lit("stopped")).cast("string").alias("x"))}
        with pytest.raises(Exception, match="stopped"):
            release.publish(spark, root, bad)
        assert [release.read(spark, root, n).count() for n in one] == [3, 3, 3]
    assert release.publish(spark, root, {"a": spark.range(5)}) == 2
    assert release.read(spark, root, "a").count() == 5 and release.read(spark, root, "b", 1).count() == 3
    with pytest.raises(LookupError):
        release.read(spark, root, "b")
    assert release.publish(spark, root, {"a": spark.range(6)}) == 3
    with pytest.raises(LookupError):
        release.read(spark, root, "a", 1)
    # what the stopped writers left is gone with the version that they built on
    assert len(list((tmp_path / "r" / "versions").iterdir())) == 2 and not list((tmp_path / "r" / "manifests").glob("_*"))


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "r")

    class Racing(dict):
        """Outputs while whose writing another writer publishes."""

        def items(self):
            yield from super().items()
            release.publish(spark, root, {"a": spark.range(1)})

    with pytest.raises(RuntimeError, match="taken"):
        release.publish(spark, root, Racing(a=spark.range(2)))
    assert release.manifest(spark, root)["version"] == 1 and release.read(spark, root, "a").count() == 1


def documents(seed, n=60):
    pick = random.Random(seed)
    ids = lambda: [str(pick.randrange(9)) for _ in range(pick.randrange(4))]
    return [(i, pick.randrange(5), pick.randrange(5), pick.randrange(3), pick.randrange(7), pick.randrange(7), ids(), ids()) for i in range(n)]


def test_increments_equal_one_batch(spark, tmp_path):
    """Three batches, two of them given again, documents in several of them, some that fail at first or always."""
    rows = documents(1)
    df = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], ROW)
    always, at_first = F.col("data_id") % 9 == 4, F.col("data_id") % 5 == 2
    store = counts.Counts(spark, str(tmp_path / "c"), blocks=4)
    with pytest.raises(LookupError):
        store.totals()
    for batch, low, high in (("1", 0, 30), ("2", 20, 45), ("1", 0, 30), ("3", 0, 60), ("2", 20, 45)):
        part = df.where((F.col("data_id") >= low) & (F.col("data_id") < high) | F.col("data_id").isNull())
        fails = always | (at_first if batch != "3" else F.lit(False))
        store.add(batch, part.where(~F.coalesce(fails, F.lit(False))), part.where(fails))
    whole = df.where("data_id is not null").distinct()
    want = stats.run_totals(whole.where(~always), whole.where(always)).collect()
    assert store.totals().collect() == want
    assert store.batches() == ["1", "2", "3"]
    assert counts.Counts(spark, str(tmp_path / "c"), blocks=4).totals().collect() == want


def test_an_empty_batch_counts_nothing(spark, tmp_path):
    store = counts.Counts(spark, str(tmp_path / "c"))
    none = spark.createDataFrame([], ROW)
    store.add("1", none)
    assert store.totals().first()["documents"] == 0
    store.add("2", spark.createDataFrame(documents(2, 3), ROW), none)
    assert store.totals().first()["documents"] == 3


def test_paths_of_one_dataset():
    assert same_dataset("/a/TAB/x", "tab_y") == "tab" and same_dataset("panorama.jsonl", "/panorama/1") == "panorama"
    for pair in (("/tab/x", "/panorama/x"), ("x", "y"), ("/tab/x", "y")):
        with pytest.raises(ValueError):
            same_dataset(*pair)


def test_collections_with_anonymized_texts(spark):
    assert is_anonymized(spark.sql("select 'a' as anonymized_text"))
    assert not is_anonymized(spark.sql("select cast(null as string) as anonymized_text")) and not is_anonymized(spark.range(2))

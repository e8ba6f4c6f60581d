"""Answers asked again by a stream with state, against a batch over all answers."""

import random
import time

import pytest

from veilframe.streaming import retries
from veilframe.streaming.retries import ANSWERS


def answers(seed, n=60):
    pick, rows = random.Random(seed), []
    for i in range(n):
        for attempt in range(1, pick.randrange(1, 6)):
            good = pick.random() < 0.3
            row = (f"d{i}", attempt, "success" if good else "error", None if good or pick.random() < 0.1 else f"e{attempt}", f"r{i}-{attempt}" if good else None)
            rows += [row] * pick.choice([1, 1, 2])
    return rows


def streamed(spark, folder, batches, **how):
    """Outcomes of a stream that reads one file after the other."""
    found = []
    before = spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKS)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ANSWERS).coalesce(1).write.parquet(f"{folder}/in/{i}")
            stream = retries.outcomes(retries._stream(spark, f"{folder}/in", ANSWERS), **how)
            stream.writeStream.outputMode("update").foreachBatch(lambda b, _: found.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(retries.PROVIDER, before)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_ends_as_the_batch(spark, tmp_path, seed):
    """Answers by attempt, some delivered twice, in three files that cut documents anywhere."""
    rows = answers(seed)
    order = sorted(rows, key=lambda r: r[1])
    third = len(order) // 3
    found = streamed(spark, str(tmp_path), [order[:third], order[third : 2 * third], order[2 * third :]])
    final = sorted((r for r in found if r[2] != "again"), key=repr)
    assert len({r[0] for r in final}) == len(final)
    assert final == sorted((tuple(r) for r in retries.settled(spark.createDataFrame(rows, ANSWERS)).collect()), key=repr)


def test_batch_against_slow(spark):
    rows = answers(7, 200) + [(None, 1, "success", None, "x"), ("n", None, "error", "e", None), ("late", 4, "success", None, "too late"), ("hole", 3, "error", None, None)]
    want = []
    for d in {r[0] for r in rows} - {None}:
        by = {r[1]: r for r in rows if r[0] == d and r[1]}
        hits = [a for a in sorted(by) if a <= 3 and by[a][2] == "success"]
        if hits:
            want.append((d, hits[0], "done", None, by[hits[0]][4]))
        elif by and max(by) >= 3:
            want.append((d, 3, "failed", by[3][3] or "unknown" if 3 in by else "unknown", None))
    got = sorted((tuple(r) for r in retries.settled(spark.createDataFrame(rows, ANSWERS)).collect()), key=repr)
    assert got == sorted(want, key=repr)


def test_an_answer_that_never_comes_is_an_error(spark, tmp_path):
    """Timers run in a stream that goes on: two of them end a document whose second answer never came."""
    spark.createDataFrame([("a", 1, "error", "down", None), ("b", 1, "success", None, "r")], ANSWERS).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    found, before = [], spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKS)
    stream = retries.outcomes(retries._stream(spark, f"{tmp_path}/in", ANSWERS), wait_ms=1, keep_ms=3_600_000)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: found.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and ("a", 3, "failed", "timeout", None) not in found:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.conf.set(retries.PROVIDER, before)
    assert [r for r in found if r[0] == "a"] == [("a", 1, "again", "down", None), ("a", 2, "again", "timeout", None), ("a", 3, "failed", "timeout", None)]
    assert [r for r in found if r[0] == "b"] == [("b", 1, "done", None, "r")]


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    """The second pass fails as a whole; called again, the run ends as if it hadn't, and settled documents aren't asked again."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(f"d{i}", f"p{i}") for i in range(12)], "data_id string, prompt string")
    state = {"calls": 0}

    def ask(asked):
        state["calls"] += 1
        if state["calls"] == 2:
            raise RuntimeError("the driver stops")
        good = F.substring("data_id", 2, 2).cast("int") % 4 < F.col("attempt")
        return asked.select("data_id", "attempt", F.when(good, "success").otherwise("error").alias("status"), F.when(~good, "down").alias("error_type"), F.when(good, F.col("prompt")).alias("response"))

    with pytest.raises(Exception, match="the driver stops"):
        retries.run(docs, ask, str(tmp_path / "run"))
    got = {r["data_id"]: (r["attempt"], r["outcome"], r["response"]) for r in retries.run(docs, ask, str(tmp_path / "run")).collect()}
    assert got == {f"d{i}": (i % 4 + 1, "done", f"p{i}") if i % 4 < 3 else (3, "failed", None) for i in range(12)}
    asked = spark.read.schema("data_id string, attempt int").option("recursiveFileLookup", "true").parquet(str(tmp_path / "run" / "asked"))
    assert asked.groupBy("data_id", "attempt").count().where("count > 1 or attempt > 3").count() == 0



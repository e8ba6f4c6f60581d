"""Failed calls asked again, with state by document: attempts, last error, a timer.

Answers arrive as a stream.  A document is done with its first success, asked
again after an error, and failed after ``limit`` attempts.  An answer that comes
twice counts once, as it bears its attempt's number.  ``outcomes`` serves streams
that go on and need timers, ``run`` and ``decisions`` tables of any size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veilframe.sources.folders import exists

ANSWERS = "data_id string, attempt int, status string, error_type string, response string"
OUTCOMES = "data_id string, attempt int, outcome string, error_type string, response string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """One document: how often it was asked, its last error, whether it is settled."""

    def __init__(self, limit: int, wait_ms: int | None, keep_ms: int | None):
        self.limit, self.wait_ms, self.keep_ms = limit, wait_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "attempts int, error string, settled boolean", self.keep_ms)

    def close(self) -> None:
        pass

    def _now(self) -> tuple[int, str | None, bool]:
        return tuple(self.state.get()) if self.state.exists() else (0, None, False)

    def _fail(self, key: str, attempt: int, error: str, clock) -> tuple:
        settled = attempt >= self.limit
        self.state.update((attempt, error, settled))
        if self.wait_ms is not None and not settled:
            self.handle.registerTimer(clock.getCurrentProcessingTimeInMs() + self.wait_ms)
        return key, attempt, "failed" if settled else "again", error, None

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        said = pd.concat(list(rows)).sort_values(["attempt", "status"], ascending=[True, False])
        out, (attempts, _, settled) = [], self._now()
        for r in said.itertuples(index=False):
            if settled or r.attempt <= attempts:
                continue
            attempts = min(int(r.attempt), self.limit)
            self._stop_timers()
            if r.status == "success" and r.attempt <= self.limit:
                settled = True
                self.state.update((attempts, None, True))
                out.append((key[0], attempts, "done", None, r.response))
            else:
                out.append(self._fail(key[0], attempts, r.error_type or "unknown", timerValues))
                settled = out[-1][2] == "failed"
        # of several errors in one batch only the last one is still to be acted on
        yield pd.DataFrame(out[-1:], columns=["data_id", "attempt", "outcome", "error_type", "response"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        attempts, _, settled = self._now()
        out = [] if settled else [self._fail(key[0], attempts + 1, "timeout", timerValues)]
        yield pd.DataFrame(out, columns=["data_id", "attempt", "outcome", "error_type", "response"])

    def _stop_timers(self) -> None:
        if self.wait_ms is not None:
            for (at,) in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)


def outcomes(answers: DataFrame, limit: int = 3, wait_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """What each new answer of a stream (``ANSWERS``) leads to: done, again or failed.

    ``wait_ms``: an answer that doesn't come in that time after its request is an
    error of type ``timeout``; timers need a trigger that keeps running, not
    ``availableNow``, which never ends with them.  ``keep_ms``: how long a document without news is
    remembered (always, if None).  The session's state store has to be RocksDB
    (``PROVIDER``, ``ROCKS``).
    """
    timed = "ProcessingTime" if wait_ms is not None or keep_ms is not None else "None"
    rows = answers.where("data_id is not null and attempt is not null")
    return rows.groupBy("data_id").transformWithStateInPandas(Attempts(limit, wait_ms, keep_ms), OUTCOMES, "Update", timed)


def decisions(answers: DataFrame, limit: int = 3, before: DataFrame | None = None) -> DataFrame:
    """The same from tables: what new answers lead to after the outcomes ``before`` them, one row a document that they change."""
    ok, n = F.coalesce(F.col("status") == "success", F.lit(False)), F.col("attempt")
    rows = answers.where("data_id is not null and attempt > 0")
    if before is not None:
        state = before.groupBy("data_id").agg(F.max("attempt").alias("_attempts"), F.max(F.col("outcome") != "again").alias("_settled"))
        rows = rows.join(state, "data_id", "left").where("_attempts is null or (not _settled and attempt > _attempts)")
    hit, capped = ok & (n <= limit), F.least(n, F.lit(limit))
    error = F.coalesce(F.nullif("error_type", F.lit("")), F.lit("unknown"))
    one = rows.groupBy("data_id").agg(
        F.min(F.when(hit, n)).alias("hit"),
        F.min_by(F.when(hit, F.col("response")), F.when(hit, n)).alias("response"),
        F.max(F.when(~hit, capped)).alias("missed"),
        F.max_by(error, F.when(~hit, F.struct(capped, -n))).alias("error"),
    )
    done = F.col("hit").isNotNull()
    outcome = F.when(done, "done").when(F.col("missed") >= limit, "failed").otherwise("again")
    return one.select("data_id", F.coalesce("hit", "missed").alias("attempt"), outcome.alias("outcome"), F.when(~done, F.col("error")).alias("error_type"), F.when(done, F.col("response")).alias("response"))


def settled(answers: DataFrame, limit: int = 3) -> DataFrame:
    """The same from a table of all answers, without the documents that are still open."""
    return decisions(answers, limit).where("outcome <> 'again'")


def _stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def _until_read(query) -> None:
    query.trigger(availableNow=True).start().awaitTermination()


def run(requests: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str, limit: int = 3) -> DataFrame:
    """Passes over requests (data_id, prompt) until each is done or failed; returns the final outcomes.

    ``ask`` makes ``ANSWERS`` of rows (data_id, attempt, prompt).  Requests, answers
    and outcomes are files under ``folder``, read by two streams with checkpoints:
    what a crash interrupted goes on where it was when ``run`` is called again,
    and an answer that is written twice counts once.  A document's state is its
    last outcome in those files, which new answers are joined with: no timer is
    needed here, and no Python call a document.
    """
    spark = requests.sparkSession
    asked, answered, decided = (f"{folder}/{n}" for n in ("asked", "answered", "decided"))
    table = f"{folder}/requests"
    if not exists(spark, f"{table}/_SUCCESS"):
        requests.select(F.col("data_id").cast("string").alias("data_id"), "prompt").write.mode("overwrite").parquet(table)
    todo = spark.read.parquet(table)
    if not exists(spark, f"{asked}/first/_SUCCESS"):
        todo.select("data_id", F.lit(1).alias("attempt")).write.mode("overwrite").parquet(f"{asked}/first")
    for path, schema in ((answered, ANSWERS), (decided, OUTCOMES)):
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(f"{path}/none")

    def answer(batch: DataFrame, number: int) -> None:
        ask(batch.join(todo, "data_id")).select("data_id", "attempt", "status", "error_type", "response").write.mode("overwrite").parquet(f"{answered}/batch-{number}")

    def decide(batch: DataFrame, number: int) -> None:
        # a batch that is decided anew doesn't see what it wrote itself
        before = spark.read.schema(OUTCOMES).parquet(f"{decided}/none", *(f"{decided}/batch-{i}" for i in range(number)))
        decisions(batch, limit, before).write.mode("overwrite").parquet(f"{decided}/batch-{number}")
        again = spark.read.schema(OUTCOMES).parquet(f"{decided}/batch-{number}").where("outcome = 'again'")
        again.select("data_id", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(f"{asked}/batch-{number}")

    for _ in range(limit):
        _until_read(_stream(spark, asked, "data_id string, attempt int").writeStream.foreachBatch(answer).option("checkpointLocation", f"{folder}/ask"))
        _until_read(_stream(spark, answered, ANSWERS).writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/decide"))
    final = spark.read.schema(OUTCOMES).option("recursiveFileLookup", "true").parquet(decided)
    return final.where("outcome <> 'again'")

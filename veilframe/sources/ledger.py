"""A durable ledger of model calls: each prompt of a stage is asked once, every later read is a join.

Answers live in a Parquet table, partitioned by stage and keyed by a hash of the
prompt.  Before a task's answers are committed to the table they go, one by one
as they come, into write-ahead segments of their bucket of keys; a task that is
started again reads those first and asks only what they lack.  So a lost
executor costs the calls that were under way.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.folders import arrow_path, drop_folder, exists, work_folder, written

ANSWERS = "key string, attempt int, status string, response string, stage string"
#: Leading hexadecimal digits of a key that name its bucket, and answers after which a segment is closed.
BUCKET_DIGITS, SEGMENT_ROWS = 3, 200


class Segments:
    """The write-ahead files of one attempt of one stage, seen from a task."""

    def __init__(self, uri: str):
        self.fs, self.root = arrow_path(uri)
        self.lock, self.out, self.rows = threading.Lock(), None, 0

    def read(self, bucket: str) -> dict[str, tuple[str, str]]:
        """Answers of earlier runs by key; a line cut off by a crash is passed over."""
        found = {}
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{bucket}", allow_not_found=True)):
            with self.fs.open_input_stream(f.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        key, status, response = json.loads(line)
                    except ValueError:
                        continue
                    found[key] = (status, response)
        return found

    def begin(self, bucket: str) -> None:
        self.end()
        self.bucket = bucket

    def add(self, key: str, status: str, response: str) -> None:
        with self.lock:
            if self.out is None:
                self.fs.create_dir(f"{self.root}/{self.bucket}", recursive=True)
                self.out, self.rows = self.fs.open_output_stream(f"{self.root}/{self.bucket}/{uuid.uuid4().hex}.jsonl"), 0
            self.out.write((json.dumps([key, status, response]) + "\n").encode())
            self.out.flush()
            self.rows += 1
            if self.rows >= SEGMENT_ROWS:
                self._close()

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def end(self) -> None:
        with self.lock:
            self._close()


def ask_one(backend, prompt: str, most) -> tuple[str, str]:
    """(status, response); a failed call is an error with the message."""
    try:
        return "success", (backend if most is None else backend.limited(int(most)))(prompt)
    except Exception as e:  # noqa: BLE001  any failure of a call is data
        return "error", f"{type(e).__name__}: {e}"


class Ledger:
    """Answers by stage and prompt under ``path`` (a folder that driver and executors share; a new one if none is named).

    One driver at a time writes a stage.  Answers are by prompt: equal prompts of a
    stage, in one table or in two, are one call.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{work_folder(spark)}/ledger").rstrip("/")

    def answers(self, stage: str | None = None) -> DataFrame:
        """key, attempt, status, response, stage of every call so far."""
        table = f"{self.path}/answers"
        df = self.spark.read.schema(ANSWERS).parquet(table) if exists(self.spark, table) else self.spark.createDataFrame([], ANSWERS)
        return df if stage is None else df.where(F.col("stage") == stage)

    def latest(self, stage: str) -> DataFrame:
        """One answer a key: a success if there is one, else the last attempt's error."""
        every = self.answers(stage)
        if every.where("attempt > 1").isEmpty():
            return every.select("key", "status", "response", "attempt")
        best = every.groupBy("key").agg(F.max_by(F.struct("status", "response", "attempt"), F.struct(F.col("status") == "success", "attempt")).alias("a")).select("key", "a.*")
        return written(best, work_folder(self.spark), "latest")

    def ask(self, df: DataFrame, backend, stage: str, prompt: str = "prompt", limit: str | None = None, attempts: int = 1, threads: int = 20) -> DataFrame:
        """``df`` with status and response, in place of columns of that name.

        Its rows are written first, so a source that differs each time it is read
        does no harm.  Null prompts are errors and aren't asked.  ``limit`` names
        a column with the most tokens of an answer; ``attempts``: errors, of this
        or an earlier run, are asked again until a prompt had so many.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", stage):
            raise ValueError(f"not a stage's name: {stage}")
        most = F.col(limit).cast("string") if limit else F.lit(None).cast("string")
        key = F.when(F.col(prompt).isNotNull(), F.sha2(F.concat(F.coalesce(most, F.lit("")), F.lit("\n"), F.col(prompt)), 256))
        rows = written(df.drop("status", "response").withColumn("_key", key), work_folder(self.spark), "asked")
        asked = rows.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(prompt).alias("prompt"), F.first(limit if limit else F.lit(None).cast("int")).alias("most"))
        for attempt in range(1, attempts + 1):
            settled = self.answers(stage).where((F.col("status") == "success") | (F.col("attempt") >= attempt)).select("key").distinct()
            todo = asked.join(settled, "key", "left_anti")
            if attempt > 1 and todo.isEmpty():
                break
            self._call(todo, backend, stage, attempt, threads)
        said = self.latest(stage).select(F.col("key").alias("_key"), "status", "response")
        out = rows.join(said, "_key", "left").drop("_key")
        return out.withColumn("status", F.coalesce("status", F.lit("error"))).withColumn("response", F.coalesce("response", F.lit("no prompt")))

    def _call(self, todo: DataFrame, backend, stage: str, attempt: int, threads: int) -> None:
        wal = f"{self.path}/wal/{stage}/{attempt}"

        def run(batches):
            ahead, bucket, known = Segments(wal), None, {}

            def one(row):
                got = ask_one(backend, row.prompt, None if pd.isna(row.most) else row.most)
                ahead.add(row.key, *got)
                return got

            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    for b, part in pdf.groupby("bucket", sort=False):
                        if b != bucket:
                            bucket, known = b, ahead.read(b)
                            ahead.begin(b)
                        before = [known.get(k) for k in part["key"]]
                        new = iter(list(pool.map(one, [r for r, was in zip(part.itertuples(index=False), before) if was is None])))
                        got = [was or next(new) for was in before]
                        yield pd.DataFrame({"key": part["key"].to_numpy(), "attempt": attempt, "status": [s for s, _ in got], "response": pd.Series([r for _, r in got], dtype=object), "stage": stage})
            ahead.end()

        spread = todo.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).repartition("bucket").sortWithinPartitions("bucket", "key")
        spread.mapInPandas(run, ANSWERS).write.mode("append").partitionBy("stage").parquet(f"{self.path}/answers")
        drop_folder(self.spark, wal)

    def sink(self, backend, stage: str, **how):
        """A function for ``foreachBatch``: a batch that comes again finds its answers."""
        return lambda batch, _: self.ask(batch, backend, stage, **how).count()

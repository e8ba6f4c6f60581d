"""Decisions from tables, batch by batch: against one answer after the other, and without a call by document."""

import random

import pytest

from veilframe.streaming import retries
from veilframe.streaming.retries import ANSWERS, OUTCOMES


def slow(batches, limit=3):
    """Outcomes of batches by the rules, one answer after the other."""
    state, out = {}, []
    for rows in batches:
        last = {}
        for d, n, status, error, response in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2] != "success")):
            attempts, over = state.get(d, (0, False))
            if over or n <= attempts:
                continue
            good, n_ = status == "success" and n <= limit, min(n, limit)
            state[d] = (n_, good or n_ == limit)
            last[d] = (d, n_, "done", None, response) if good else (d, n_, "failed" if n_ == limit else "again", error or "unknown", None)
        out.append(sorted(last.values(), key=repr))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batches_against_slow(spark, tmp_path, seed):
    """Answers late, twice, beyond the limit, without status, error or id, in four batches."""
    pick, rows = random.Random(seed), []
    for i in range(80):
        for n in range(pick.choice([0, 1, 1]), pick.randrange(1, 6)):
            status = pick.choice(["success", "error", "error", None])
            row = (f"d{i}", n, status, None if status == "success" else pick.choice([f"e{n}", "", None]), f"r{i}-{n}" if status == "success" else None)
            rows += [row] * pick.choice([1, 1, 2])
    rows += [(None, 1, "success", None, "x"), ("n", None, "error", "e", None)]
    pick.shuffle(rows)
    if seed % 2:
        rows.sort(key=lambda r: r[1] or 0)
    cut = [rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4] for i in range(4)]
    before, found = spark.createDataFrame([], OUTCOMES), []
    for i, part in enumerate(cut):
        retries.decisions(spark.createDataFrame(part, ANSWERS), 3, before).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.schema(OUTCOMES).parquet(f"{tmp_path}/{i}")
        found.append(sorted((tuple(r) for r in now.collect()), key=repr))
        before = before.unionByName(now)
    assert found == slow(cut)


def test_many_documents(spark, tmp_path, monkeypatch):
    """A run keeps its state without a call of Python by document, whose cost would grow with them."""
    from pyspark.sql import functions as F

    def ask(asked):
        good = F.col("data_id").cast("long") % 5 < F.col("attempt")
        return asked.select("data_id", "attempt", F.when(good, "success").otherwise("error").alias("status"), F.when(~good, "down").alias("error_type"), F.when(good, F.col("prompt")).alias("response"))

    monkeypatch.setattr(retries, "outcomes", lambda *a, **k: pytest.fail("a call by document"))
    docs = spark.range(50_000).selectExpr("cast(id as string) AS data_id", "concat('p', id) AS prompt")
    got = retries.run(docs, ask, str(tmp_path / "run")).groupBy("attempt", "outcome").agg(F.count("*").alias("n"), F.countDistinct("data_id").alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "done", 10_000, 10_000), (2, "done", 10_000, 10_000), (3, "done", 10_000, 10_000), (3, "failed", 20_000, 20_000)]

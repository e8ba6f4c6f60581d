"""Ranges of JSON arrays against Python's reader and Spark's multi-line reader."""

import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.sources import json_array as ja

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text('a"\\[]{},:é\n', max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text('k"\\{,', max_size=3), v, max_size=3), max_leaves=8)


class Memory(ja.Bytes):
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, start, end):
        return np.frombuffer(self.data[start:end], np.uint8)


def by_ranges(data: bytes, split: int):
    source, inside, depth, out = Memory(data), False, 0, []
    for a in range(0, len(data), split):
        b = min(a + split, len(data))
        out += [(at, json.loads(x)) for at, x in ja.elements(source, a, b, inside, depth, more=3) if x.strip()]
        n, free, held = ja.summary(source.read(a, b), source.escaped(a))
        depth += held if inside else free
        inside = inside != (n % 2 == 1)
    assert not inside and depth == 0
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(VALUES, max_size=6), st.integers(1, 40), st.sampled_from([None, 1]), st.booleans())
def test_elements_whatever_the_ranges(values, split, indent, plain):
    data = json.dumps(values, indent=indent, ensure_ascii=plain).encode()
    got = by_ranges(data, split)
    assert [v for _, v in got] == values
    assert [at for at, _ in got] == sorted({at for at, _ in got})


def test_runs_of_backslashes_across_ranges():
    values = ["\\" * n + '"' for n in range(9)] + ["\\" * 10_000, '],["']
    data = json.dumps(values).encode()
    for split in (1, 2, 3, 7, 4096):
        assert [v for _, v in by_ranges(data, split)] == values


def rows(n, seed=1):
    pick = random.Random(seed)
    return [{"doc_id": i, "text": "".join(pick.choice('ab"\\[]{},:é😀\n ') for _ in range(pick.randrange(60))), "more": [{"k": "}],["}] * pick.randrange(3)} for i in range(n)]


def test_equal_to_the_multi_line_reader(spark, tmp_path):
    schema = "doc_id long, text string, more array<struct<k:string>>"
    for i, indent in enumerate((None, 2)):
        (tmp_path / f"a{i}.json").write_text(json.dumps(rows(400, i), indent=indent, ensure_ascii=bool(i)), "utf-8")
    (tmp_path / "none.json").write_text(" [ ] \n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "one.json").write_text('\n {"doc_id": -1, "text": "[,]", "more": []}')
    want = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    for split in (100, 5000, ja.SPLIT):
        got = ja.read_json_array(spark, str(tmp_path), schema, split=split)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.where("doc_id is not null").collect()))
    first = ja.read_elements(spark, str(tmp_path / "a0.json"), 1000).orderBy("offset")
    assert [json.loads(r["json"])["doc_id"] for r in first.collect()] == list(range(400))


def test_what_is_not_an_array(spark, tmp_path):
    (tmp_path / "open.json").write_text('[{"doc_id": 1}, {"doc_id": 2')
    with pytest.raises(Exception, match="isn't closed"):
        ja.read_elements(spark, str(tmp_path / "open.json")).collect()
    (tmp_path / "bad.json").write_text('[{"doc_id": 1}, {"doc_id": "x"}]')
    with pytest.raises(Exception):
        ja.read_json_array(spark, str(tmp_path / "bad.json"), "doc_id long").collect()
    assert [r["doc_id"] for r in ja.read_json_array(spark, str(tmp_path / "bad.json"), "doc_id long", strict=False).collect()] == [1, None]
    with pytest.raises(FileNotFoundError):
        ja.read_elements(spark, str(tmp_path / "nothing*"))


def test_a_large_array_in_many_tasks(spark, tmp_path):
    """200 MB, one array: at least eight tasks have rows."""
    part = ",\n".join(json.dumps(r) for r in rows(20_000)).encode()
    with open(tmp_path / "large.json", "wb") as f:
        f.write(b"[" + part)
        n = 1
        while f.tell() < 200_000_000:
            f.write(b",\n" + part)
            n += 1
        f.write(b"]")
    from pyspark.sql import functions as F

    began = time.monotonic()
    got = ja.read_json_array(spark, str(tmp_path / "large.json"), "doc_id long, text string").withColumn("task", F.spark_partition_id())
    r = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks"), F.sum("doc_id").alias("ids")).first()
    assert (r["n"], r["ids"]) == (20_000 * n, n * 20_000 * 19_999 // 2) and r["tasks"] >= 8
    assert time.monotonic() - began < 120

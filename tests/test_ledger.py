"""Model calls: one a prompt, whatever fails, and every row of an answer kept."""

import os
import random
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from conftest import ROOT
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilframe import backends
from veilframe.plans import anonymize, evaluate, infer
from veilframe.sources.ledger import Ledger, Segments

cloudpickle.register_pickle_by_value(sys.modules[__name__])
GOOD = '[{"id": 0, "PIIs": [{"tag": "NAME", "keyword": "mended"}]}]'


class Counting:
    """A backend that notes each prompt that it answered in a folder that all tasks see."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def limited(self, tokens):
        return self

    def __call__(self, prompt):
        import uuid

        answer = self.answer(prompt)
        (Path(self.folder) / uuid.uuid4().hex).write_text(prompt)
        return answer

    def calls(self):
        return sorted(p.read_text() for p in Path(self.folder).iterdir())


@pytest.fixture
def counted(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return lambda answer: Counting(folder, answer)


def test_random_repairs_keep_every_row(spark, counted):
    """A model that mends half of 200 answers at random: 200 rows and ids, 200 calls, each answer as it was given."""
    backend = counted(lambda p: GOOD if random.random() < 0.5 else "no")
    rows = spark.createDataFrame([(i, f'[{{"id" {i} "PIIs" NAME ((') for i in range(200)], "data_id long, response string")
    got = infer.with_repair(rows, backend)
    first, again = got.collect(), got.collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    assert sorted(r["data_id"] for r in first) == list(range(200))
    assert len(backend.calls()) == 200
    assert all(r["repaired"] == (r["parsed"]["status"] == "success") for r in first)


def test_rows_of_one_id_stay_apart(spark, counted):
    backend = counted(lambda p: GOOD)
    good = '[{"id": 1, "PIIs": [{"tag": "NAME", "keyword": "read"}]}]'
    rows = spark.createDataFrame([(1, good), (1, '[{"id" (('), (1, '[{"id" (('), (2, None), (2, ""), (None, '[{"id" 2 ((')], "data_id long, response string")
    got = sorted((r["data_id"] or 0, r["repaired"], r["parsed"]["status"]) for r in infer.with_repair(rows, backend).collect())
    assert got == [(0, True, "success"), (1, False, "success"), (1, True, "success"), (1, True, "success"), (2, False, "error"), (2, False, "error")]
    assert len(backend.calls()) == 2


def test_parsing_reads_its_rows_once(spark, counted):
    backend = counted(lambda p: random.choice([GOOD, "x", "[{'id': 3, 'PIIs': []}]"]))
    told = backends.call(spark.range(50).select(F.col("id").alias("data_id"), F.concat(F.lit("p"), "id").alias("prompt")), backend)
    assert infer.parse_profiles(told).count() == 50
    infer.parse_profiles(told).select("parsed").collect()
    assert len(backend.calls()) <= 100


def test_adversary_asks_once_a_prompt(spark, counted):
    backend = counted(lambda p: f"#\n{random.random()}")
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "data_id long, text string")
    got = anonymize.adversarial(docs, backend, backend, rounds=2)
    assert got.count() == 20
    assert len({r["anonymized_text"] for r in got.collect()}) == 7
    assert len(backend.calls()) == len(set(backend.calls())) == 4 * 7


def test_errors_are_asked_again_and_successes_never(spark, tmp_path):
    ledger, docs = Ledger(spark, str(tmp_path / "ledger")), spark.createDataFrame([(i, f"p{i % 6}" if i else None) for i in range(30)], "data_id long, prompt string")

    def fails(p):
        raise OSError("down")

    first = {r["data_id"]: (r["status"], r["response"]) for r in ledger.ask(docs, backends.Stub(lambda p: fails(p) if p in ("p1", "p2") else "a" + p), "s").collect()}
    assert first[0] == ("error", "no prompt") and first[1] == ("error", "OSError: down") and first[3] == ("success", "ap3")
    second = {r["data_id"]: r["response"] for r in ledger.ask(docs, backends.Stub(lambda p: fails(p) if p == "p1" else "b" + p), "s", attempts=3).collect()}
    assert (second[1], second[2], second[3]) == ("OSError: down", "bp2", "ap3")
    assert sorted((r["attempt"], r["status"]) for r in ledger.answers("s").collect()) == [(1, "error")] * 2 + [(1, "success")] * 4 + [(2, "error"), (2, "success"), (3, "error")]
    assert ledger.ask(docs, backends.Stub(fails), "s").where("response = 'ap3'").count() == 5
    assert ledger.ask(docs.limit(0), backends.Stub(fails), "other").count() == 0
    with pytest.raises(ValueError):
        ledger.ask(docs, backends.Stub(fails), "a/b")


def test_limits_are_part_of_a_prompt(spark):
    docs = spark.createDataFrame([(1, "p", 2), (2, "p", 3), (3, "p", 2)], "data_id long, prompt string, most int")
    got = {r["data_id"]: r["response"] for r in Ledger(spark).ask(docs, backends.Stub(lambda p: "w w w w"), "s", limit="most").collect()}
    assert got == {1: "w w", 2: "w w w", 3: "w w"}


def test_torn_segments_are_read_up_to_the_tear(tmp_path):
    s = Segments(str(tmp_path))
    s.begin("abc")
    for i in range(450):
        s.add(f"k{i}", "success", "é\n😀")
    s.end()
    files = list((tmp_path / "abc").iterdir())
    assert len(files) == 3
    last = max(files, key=lambda f: f.stat().st_mtime_ns)
    last.write_bytes(last.read_bytes()[:-9])
    found = s.read("abc")
    assert len(found) == 449 and found["k0"] == ("success", "é\n😀") and s.read("none") == {}


CRASH = """
    import os, sys
    sys.path[:0] = [{root!r}, {tests!r}]
    from pathlib import Path
    from pyspark.sql import SparkSession
    from test_ledger import Counting
    from veilframe.sources.ledger import Ledger

    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    folder = Path({calls!r})

    def answer(p):
        if len(list(folder.iterdir())) >= 40 and not os.path.exists({flag!r}):
            open({flag!r}, "w").close()
            os._exit(1)
        return "a" + p

    docs = spark.range(120).selectExpr("id AS data_id", "concat('p', id) AS prompt")
    got = Ledger(spark, {ledger!r}).ask(docs, Counting(folder, answer), "s", threads=1)
    print("ROWS", got.where("response = concat('a', prompt)").count())
"""


def test_a_killed_task_repeats_no_call(tmp_path):
    """The worker dies between two calls after 40 of 120; Spark starts its task again."""
    calls, flag = tmp_path / "calls", tmp_path / "died"
    calls.mkdir()
    code = textwrap.dedent(CRASH).format(root=str(ROOT), tests=str(ROOT / "tests"), calls=str(calls), flag=str(flag), ledger=str(tmp_path / "ledger"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT / 'tests'}"})
    assert "ROWS 120" in done.stdout, done.stderr[-2000:]
    assert flag.exists()
    assert sorted(p.read_text() for p in calls.iterdir()) == sorted(f"p{i}" for i in range(120))
    assert not (tmp_path / "ledger" / "wal" / "s" / "1").exists()


PEOPLE = "array<struct<id:string,description:string,PIIs:array<struct<tag:string,keyword:string,certainty:int,hardness:int>>>>"


def combined(spark, n):
    person = lambda w: [("0", "someone", [("NAME", w, 3, 1)])]
    return spark.createDataFrame([(str(i), f"text {i}", person(f"n{i}") if i % 9 else None, person(f"n{i}")) for i in range(n)], f"data_id string, text string, annotation_A {PEOPLE}, annotation_B {PEOPLE}")


def test_an_aligner_that_fails_at_first(spark, counted, tmp_path):
    """Three passes over failing, unreadable and good answers; the same ledger again asks nothing."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def answer(p):
        n = int(p.split("Text:\ntext ")[1].split("\n")[0])
        mark = seen / f"{n}-{len(list(seen.glob(f'{n}-*')))}"
        mark.touch()
        tries = len(list(seen.glob(f"{n}-*")))
        if tries <= n % 5:
            raise OSError("down")
        return "nothing" if n % 7 == 3 else "Result: Matched\nSubject: A_0; B_0\n"

    docs, ledger = combined(spark, 30), Ledger(spark, str(tmp_path / "ledger"))
    backend = counted(answer)
    got = evaluate.align_documents(docs, backend, ledger)
    lost = {i for i in range(30) if i % 9 and (i % 5 >= 3 or i % 7 == 3)}
    errors = {(r["data_id"], r["error_type"]) for r in got["errors"].collect()}
    assert errors == {(str(i), "alignment") for i in lost} | {(str(i), "missing_annotations") for i in range(0, 30, 9)}
    assert {r["data_id"] for r in got["aligned"].collect()} == {str(i) for i in range(30) if i % 9 and i not in lost}
    tries = {}
    for r in got["passes"].collect():
        tries.setdefault(int(r["data_id"]), []).append((r["attempt"], r["status"]))
    assert all(max(t)[0] == (3 if i in lost else i % 5 + 1) for i, t in tries.items())
    before = len(backend.calls())
    assert evaluate.align_documents(docs, backend, ledger)["totals"].collect() == got["totals"].collect()
    assert len(backend.calls()) == before


def test_a_whole_inference_run(spark, counted, tmp_path):
    """Analysis, both profiles, one of them mended, merged; started again it asks nothing."""

    def answer(p):
        if p.startswith("List every person"):
            return "none" if "lost" in p else "Individual Character Analysis\n- A\nThe Number of Subjects: 1"
        if "EMAIL" in p:
            return '[{"id": 0, "PIIs": [{"tag": "EMAIL_ADDRESS", "keyword": "a@b.c", "certainty": 5, "hardness": 1}]}]'
        if "lost" in p or "broken" in p and not p.startswith("For each person"):
            return GOOD
        return '[{"id" 0 "PIIs" broken ((' if "odd" in p else '[{"id": 0, "PIIs": [{"tag": "NAME", "keyword": "Anna", "certainty": 4, "hardness": 1}]}]'

    docs = spark.createDataFrame([(1, "plain"), (2, "odd"), (3, "lost"), (4, None)], "data_id long, text string")
    backend, ledger = counted(answer), Ledger(spark, str(tmp_path / "ledger"))
    got = infer.run(docs, backend, ledger=ledger)
    assert sorted((r["data_id"], r["tag"], r["keyword"]) for r in got["profiles"].collect()) == [(1, "EMAIL_ADDRESS", "a@b.c"), (1, "NAME", "Anna"), (2, "EMAIL_ADDRESS", "a@b.c"), (2, "NAME", "mended")]
    assert sorted((r["data_id"], r["error_type"]) for r in got["errors"].collect()) == [(3, "analysis"), (4, "analysis")]
    n = len(backend.calls())
    assert n == 3 + 4 + 1
    infer.run(docs, backend, ledger=ledger)
    assert len(backend.calls()) == n

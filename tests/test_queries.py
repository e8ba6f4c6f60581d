"""Every registered query that has SQL against DuckDB on the smallest tables."""

import pytest
from compare import same

from veilframe import queries_documents, queries_files, queries_runs  # noqa: F401
from veilframe.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    same(spark, duck, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()[0]
    assert 0 < row["ipr"] < 1 and 0 < row["cpr"] < 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing but the entry point knows the training-data subpackage."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    own = [p for p in (root / "veilframe").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if "veilframe.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]

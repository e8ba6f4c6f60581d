"""What the optimizer makes of the queries: joins, pruning, pushdown, codegen."""

import pytest

from veilframe import queries_documents, queries_files, queries_runs  # noqa: F401
from veilframe.functions import sql
from veilframe.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, sf):
    text = plan(QUERIES["mention_extract"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["error_filler"](spark, sf))
    assert "LessThan(c_acctbal,0.0)" in text
    text = plan(QUERIES["resume_anti_join"](spark, sf))
    assert "EqualTo(quality,1)" in text and "text" not in text


def test_containment_join_is_by_document(spark, sf):
    text = plan(QUERIES["token_precision_range_semi"](spark, sf))
    assert "HashJoin" in text or "SortMergeJoin" in text


def test_rules_stay_in_the_jvm(spark, sf):
    for name in ("mention_extract", "erdi_erqi", "align_full_outer", "apply_masking", "normalize_non_inferable", "parse_alignment_pairs"):
        text = plan(QUERIES[name](spark, sf))
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_sql_names(spark):
    sql.register(spark)
    assert round(spark.sql("SELECT jaro_winkler('martha', 'marhta')").collect()[0][0], 6) == 0.961111

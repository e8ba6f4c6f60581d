"""Token windows of odd tables: nulls against the SQL, long orders against all windows."""

import duckdb
import pytest
from compare import same

from veilframe import queries_documents  # noqa: F401
from veilframe.queries import ORACLES, QUERIES

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double"


@pytest.fixture
def lineitem(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return put


def test_nulls_as_in_the_sql(spark, lineitem):
    """Null lines come last, null tokens hold their place, and a window of nulls alone has no text."""
    rows = [(1, i, 10 + i, i if i % 3 else None, 1.0, None if i % 2 else 2.0) for i in range(1, 12)]
    rows += [(2, i, None, i, 1.0, 1.0) for i in range(1, 6)] + [(3, 1, None if i in (2, 3, 4) else i, i, 1.0, 1.0) for i in range(1, 8)]
    rows += [(None, i, i, i, float("nan") if i == 1 else None, 1.0) for i in (1, 1, 2)]
    sf, duck = lineitem(rows), duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    same(spark, duck, sf, QUERIES["token_windows"], ORACLES["token_windows"])


@pytest.mark.parametrize("n", [18, 19, 40])
def test_a_long_order_loses_no_line(spark, lineitem, n):
    """The SQL has the windows to the ninth; the query has those and the rest."""
    sf = lineitem([(1, 1, i, i, 1.0, 1.0) for i in range(1, n + 1)])
    got = {r["window"]: r["tokens"] for r in QUERIES["token_windows"](spark, sf).collect()}
    assert got == {w: ",".join(str(i) for i in range(2 * w + 1, min(n, 2 * w + 3) + 1)) for w in range((n + 1) // 2)}

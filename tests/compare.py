"""Order-insensitive comparison of a query with its SQL."""

from __future__ import annotations


def canonical(rows, columns):
    """Rows as sorted tuples of columns by name, numbers rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "NaN" if v != v else round(v, 6)
        return round(float(v), 6) if hasattr(v, "as_tuple") else v

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same(spark, duck, sf, query, sql):
    got = query(spark, sf)
    found = canonical([tuple(r) for r in got.collect()], got.columns)
    cur = duck.execute(sql)
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert found[0] == want[0]
    assert len(found[1]) == len(want[1])
    assert found[1] == want[1]

"""Comparison of Spark results with oracle results."""


def same_rows(df, con, sql):
    """Spark's rows and the oracle's, as sorted text, columns by name."""
    cell = lambda v: repr(v) if isinstance(v, float) else "null" if v is None else str(v)
    cols = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs
    return ours

"""Comparison of a DataFrame with SQL."""


def same(duck, df, sql):
    """Rows of df and of the SQL, as sorted lists of tuples with columns by name."""
    want = duck.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    rows = sorted(duck.sql(f"select {', '.join(names)} from ({sql})").fetchall())
    return got, rows

"""Comparing a DataFrame with a DuckDB relation."""


def same_rows(df, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and the same rows in any order."""
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [list(relation.columns).index(c) for c in columns]
    mine = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(repr(r[i]) for i in at) for r in relation.fetchall())
    assert mine == theirs

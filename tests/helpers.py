"""Shared test helpers."""


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(found, key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

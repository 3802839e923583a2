"""Comparison of two pandas results."""


def same_rows(a, b, digits=6):
    """Equal columns and multisets of rows, doubles rounded."""
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns)

    def norm(df):
        return sorted((tuple(str(round(x, digits) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)))

    assert norm(a) == norm(b)

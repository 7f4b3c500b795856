"""Order-free comparison of two pandas frames."""

import numpy as np
import pandas as pd


def one(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(one, x)) + "]"
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(map(one, r)) for r in df.itertuples(index=False))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b) if x != y][:3] == []

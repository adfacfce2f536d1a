"""Comparison of a Spark result with a SQL one, by value, in any order."""

import numpy as np


def canonical(v):
    if v is None:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return "null" if v != v else repr(float(v) + 0.0)
    return str(v)


def same(df, relation) -> bool:
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    a = sorted(tuple(canonical(r[n]) for n in names) for r in df.collect())
    b = sorted(tuple(canonical(r[i]) for i in at) for r in relation.fetchall())
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
    return True

"""Compares rows of two engines, whatever their order."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return bytes(v) if isinstance(v, bytearray) else v


def assert_same(df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[k]) for k in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(dict(zip(names, r))[k]) for k in order) for r in cursor.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs

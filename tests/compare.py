"""Order-insensitive comparison of two result sets (columns sorted by name)."""

import decimal
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def same(spark_df, cols2, rows2):
    cols1 = spark_df.columns
    rows1 = [tuple(r) for r in spark_df.collect()]
    assert sorted(cols1) == sorted(cols2), (cols1, cols2)
    a, b = canon(cols1, rows1), canon(cols2, rows2)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, (set(a) - set(b), set(b) - set(a))

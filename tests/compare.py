"""Rows of Spark and DuckDB in one form."""

import decimal
import math


def tidy(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return value if math.isinf(value) or math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(tidy, value))
    return value


def rows(found, columns, given):
    """Sorted rows of tuples whose columns come as given, in order of columns' names."""
    at = [given.index(c) for c in sorted(columns)]
    return sorted((tuple(tidy(r[k]) for k in at) for r in found), key=repr)

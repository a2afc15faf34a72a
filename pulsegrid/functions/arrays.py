"""Array-column arithmetic for bounded arrays (one beat, the peaks of one segment). All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(body, *values: Column) -> Column:
    """``body(*values)`` with every value computed once per row.

    An expression used inside a lambda is otherwise evaluated again for each element. Binding it as the
    variable of a one-element ``transform`` makes it a plain field access there.
    """
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda r: body(*[r[f"v{i}"] for i in range(len(values))])), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def _sum_squares(a: Column, m: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))


def sd(a: Column, ddof: int = 1) -> Column:
    def body(v, m):
        return F.when(F.size(v) > ddof, F.sqrt(_sum_squares(v, m) / (F.size(v) - ddof)))
    return let(lambda v: let(body, v, mean(v)), a)


def quantile(a: Column, p: float) -> Column:
    """Linear-interpolation quantile of an array without NULLs."""
    def body(s):
        h = (F.size(s) - 1) * F.lit(float(p))
        lo, hi = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
        return F.when(F.size(s) > 0, lo + (hi - lo) * (h - F.floor(h)))
    return let(body, F.sort_array(a))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def diff(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda y, x: y - x)
                  ).otherwise(F.slice(a, F.lit(1), F.lit(0)))


def first_true(a: Column) -> Column:
    """0-based index of the first true element, NULL if there is none."""
    p = F.array_position(a, F.lit(True))
    return F.when(p > 0, p - 1)


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return let(lambda v: F.array_position(v, F.array_max(v)) - 1, a)


def argmin(a: Column) -> Column:
    return let(lambda v: F.array_position(v, F.array_min(v)) - 1, a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pearson(a: Column, b: Column) -> Column:
    def body(x, y, mx, my):
        cross = F.aggregate(F.zip_with(x, y, lambda u, v: (u - mx) * (v - my)), F.lit(0.0), lambda s, e: s + e)
        scale = _sum_squares(x, mx) * _sum_squares(y, my)
        return F.when(scale > 0, cross / F.sqrt(scale))
    return let(lambda x, y: let(body, x, y, mean(x), mean(y)), a, b)


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b) / F.size(a))

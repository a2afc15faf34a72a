"""Distribution tails as Spark SQL expressions.

Spark SQL has no incomplete beta or gamma function. The commons-math library that Spark itself ships has
both, and ``java_method`` reaches them without leaving the JVM. Keep these in a last ``select``: they are
not foldable, and the frames they are used on hold one row per test.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _call(cls: str, method: str, *args: Column) -> Column:
    ready = [a.cast("double") for a in args]
    value = F.java_method(F.lit(f"org.apache.commons.math3.special.{cls}"), F.lit(method), *ready).cast("double")
    complete = ready[0].isNotNull()
    for a in ready[1:]:
        complete = complete & a.isNotNull()
    return F.when(complete, value)


def regularized_beta(x: Column, a: Column, b: Column) -> Column:
    return _call("Beta", "regularizedBeta", x, a, b)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    return F.when(f >= 0, regularized_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0))


def t_two_sided(t: Column, df: Column) -> Column:
    return regularized_beta(df / (df + t * t), df / 2.0, F.lit(0.5))


def t_upper(t: Column, df: Column) -> Column:
    half = t_two_sided(t, df) / 2.0
    return F.when(t >= 0, half).otherwise(1.0 - half)


def chi2_tail(x: Column, df: Column) -> Column:
    return F.when(x <= 0, F.lit(1.0)).otherwise(_call("Gamma", "regularizedGammaQ", df / 2.0, x / 2.0))


def normal_two_sided(z: Column) -> Column:
    return _call("Erf", "erfc", F.abs(z) / F.sqrt(F.lit(2.0)))


def normal_cdf(z: Column) -> Column:
    return _call("Erf", "erfc", -z / F.sqrt(F.lit(2.0))) / 2.0


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; NULL outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.sqrt(F.lit(2.0)) * _call("Erf", "erfInv", 2.0 * p - 1.0))

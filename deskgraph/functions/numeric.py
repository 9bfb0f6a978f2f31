"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(value: Column, digits: int) -> Column:
    """Round half to even, to ``digits`` places, on the binary value.

    ``round(x, n)`` in Spark works on the shortest decimal text of ``x`` and lifts ties up.
    ``+ 0.0`` turns a negative zero into zero.
    """
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale) / scale + F.lit(0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, 0.0 when the denominator is zero or null."""
    return F.when(
        denominator.cast("double") != 0.0,
        numerator.cast("double") / denominator.cast("double"),
    ).otherwise(F.lit(0.0))


def percent(numerator: Column, denominator: Column, digits: int) -> Column:
    """``100 * numerator / denominator`` rounded, 0.0 for an empty denominator."""
    return round_dp(ratio(numerator, denominator) * F.lit(100.0), digits)


def count_if(condition: Column) -> Column:
    """Number of rows for which ``condition`` is true, as bigint and never null."""
    return F.count(F.when(condition, F.lit(1)))


def harmonic(a: Column, b: Column) -> Column:
    """F1 of precision ``a`` and recall ``b``; 0.0 if both are zero."""
    return ratio(F.lit(2.0) * (a * b), a + b)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of places, rounded half-even on the binary value as ``printf`` in C does.

    Spark's own ``format_string`` rounds the decimal text half-up.
    """
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))

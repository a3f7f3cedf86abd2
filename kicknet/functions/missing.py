"""Missing-value rules of the calculator, as column expressions.

A missing value is a value of its own when rows are matched or counted, and it
spreads through sums. Spark's defaults are the other way round, so every
operator goes through these helpers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(columns: Sequence[str], parent: str | None = None) -> Column:
    """The columns as one struct.

    Structs compare field by field with null equal to null, so ``whole(a) ==
    whole(b)`` is a null-safe match that Spark still plans as an equi-join.
    """
    prefix = f"{parent}." if parent else ""
    fields = ", ".join(f"{prefix}`{c}` as `{c}`" for c in columns)
    return F.expr(f"struct({fields})")


def any_true(flag: Column) -> Column:
    """True if the flag holds in at least one row of the group (null counts as no)."""
    return F.max(F.coalesce(flag, F.lit(False)))


def spreading_sum(value: Column) -> Column:
    """Sum of a group that is null as soon as one value is null."""
    return F.when(F.count(F.when(value.isNull(), 1)) == 0, F.coalesce(F.sum(value), F.lit(0.0)))


def zero_if_missing(value: Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def divide(numerator: Column, denominator: Column) -> Column:
    """Floating-point division that never raises: x/0 is an infinity, 0/0 is NaN."""
    by_zero = (
        F.when(numerator > 0, F.lit(float("inf")))
        .when(numerator < 0, F.lit(float("-inf")))
        .when(numerator == 0, F.lit(float("nan")))
    )
    # NaN sorts above infinity in Spark, so it has to be taken out first
    by_zero = F.when(F.isnan(numerator), numerator).otherwise(by_zero)
    return F.when(denominator == 0, by_zero).otherwise(F.try_divide(numerator, denominator))

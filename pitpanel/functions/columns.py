"""Small column expressions used by every operator (all stay inside codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Round to six decimals; NaN becomes NULL so it never reaches a sink."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(F.isnan(c), None).otherwise(c), 6)


def month_of(c: Column | str) -> Column:
    return F.trunc(F.to_date(c), "MM")


def quarter_of(c: Column | str) -> Column:
    return F.trunc(F.to_date(c), "QUARTER")


def months_from(c: Column | str, origin: Column | str) -> Column:
    """Whole months from ``origin`` to ``c`` (both month starts)."""
    c = F.col(c) if isinstance(c, str) else c
    origin = F.col(origin) if isinstance(origin, str) else origin
    return (F.year(c) - F.year(origin)) * 12 + F.month(c) - F.month(origin)


def cents(c: Column | str) -> Column:
    """Two-decimal amounts as exact decimals: sums do not depend on the order of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.when(b != 0, b)


def ordered(keys: Sequence[str], time: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def past(keys: Sequence[str], time: str, end: int = 0) -> WindowSpec:
    """Everything up to ``end`` rows from here (``end`` <= 0)."""
    return ordered(keys, time).rowsBetween(Window.unboundedPreceding, end)


def trailing(keys: Sequence[str], time: str, n: int) -> WindowSpec:
    return ordered(keys, time).rowsBetween(-(n - 1), 0)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def only_if(cond: Column, value: Column) -> Column:
    return F.when(cond, value)

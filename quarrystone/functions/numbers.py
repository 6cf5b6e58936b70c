"""Numeric column helpers: coercion of text, clamps and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A double, or null where the text is no number."""
    return x.try_cast("double")


def finite(x: Column, default: float | None = None) -> Column:
    """A finite double, else ``default``."""
    d = number(x)
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(ok, d).otherwise(F.lit(default).cast("double"))


def whole(x: Column, default: int | None = None) -> Column:
    """A whole number, cut toward zero; text such as 3.0 counts."""
    return F.coalesce(finite(x).cast("bigint"), F.lit(default).cast("bigint"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as floating-point arithmetic and SQL engines have it: by 0 infinite, and NaN for 0 / 0, not an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(by_zero)).otherwise(F.try_divide(a, b))


def neg_log10(x: Column, floor: float = 1e-50, cap: float = 50.0) -> Column:
    return F.least(F.lit(cap), -F.log10(F.greatest(x, F.lit(floor))))


def rounded(x: Column, places: int) -> Column:
    """``x`` times a power of ten rounded to a whole number, halves away from
    zero, and divided again, as SQL engines round doubles: the product itself
    decides which way a value goes whose next digit is a bare 5."""
    scale = float(10**places)
    return F.round(x * scale) / scale

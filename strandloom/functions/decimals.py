"""Exact decimal thresholds."""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F


def above_cent_text(text: str) -> str:
    """Least two-decimal number strictly above a decimal given as text."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("threshold must be decimal text")
    try:
        value = Decimal(text.strip())
    except InvalidOperation as error:
        raise ValueError(f"invalid decimal {text!r}") from error
    if not value.is_finite():
        raise ValueError("threshold must be finite")
    if value and value.adjusted() < -3:
        cents = 1 if value > 0 else 0  # too small to matter, whatever its digits
    else:
        numerator, denominator = value.as_integer_ratio()
        cents = numerator * 100 // denominator + 1
    sign = "-" if cents < 0 else ""
    return f"{sign}{abs(cents) // 100}.{abs(cents) % 100:02d}"


def above_cent(value: float) -> str:
    """The same for a float, read as its shortest round-trip decimal."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError("threshold must be a real number")
    if not math.isfinite(value):
        raise ValueError("threshold must be finite")
    return above_cent_text(repr(float(value)))


def above_cent_column(value: Column) -> Column:
    """Least two-decimal number strictly above a column, read by its decimal digits.

    Eighteen decimals are kept, so what lies just below a cent stays below it.
    """
    cents = F.floor(value.cast("string").cast("decimal(34,18)") * F.lit(100)) + F.lit(1)
    return (cents / F.lit(100)).cast("decimal(18,2)")


def floor_decimal(raw: float, places: int = 5) -> str:
    """Round a float down to some decimal places, from its shortest repr."""
    return str(Decimal(repr(float(raw))).quantize(Decimal(1).scaleb(-places), rounding=ROUND_FLOOR))


def floor_decimal_column(value: Column, places: int = 5) -> Column:
    scale = 10**places
    return (
        F.floor(value.cast("string").cast("decimal(30,18)") * F.lit(scale)) / F.lit(scale)
    ).cast(f"decimal(20,{places})")

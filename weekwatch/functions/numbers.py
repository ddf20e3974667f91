"""Numbers written as text, rates, seasonal and trend expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from weekwatch.functions.text import clean_code

# Fixed values.
TREND_UP, TREND_DOWN, TREND_FLAT, TREND_NONE = "em alta", "em queda", "estável", "sem base de comparação"
TREND_LIMIT_PCT = 20.0
RATIO_EPS = 1.0

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _to_double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def comma_decimal(c: Column) -> Column:
    """'1.234,5' to 1234.5; anything else, including nan and inf, to null."""
    text = F.replace(F.replace(clean_code(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _to_double(text)


def plain_float(c: Column) -> Column:
    return _to_double(clean_code(c))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def rate_100k(cases: Column, population: Column) -> Column:
    return F.when(population > 0, F.lit(100000.0) * cases / population)


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding of the binary value: scale, round to the nearest even, scale back."""
    scale = 10.0**digits
    return F.rint(c * scale) / scale


def pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, half-even; null for an empty whole."""
    return round_even(F.try_divide(100.0 * part, whole), digits)


def week_angle(week: Column) -> Column:
    return F.lit(2 * math.pi) * week / F.lit(53.0)


def trend_label(change_pct: Column) -> Column:
    return (
        F.when(change_pct.isNull(), TREND_NONE)
        .when(change_pct >= TREND_LIMIT_PCT, TREND_UP)
        .when(change_pct <= -TREND_LIMIT_PCT, TREND_DOWN)
        .otherwise(TREND_FLAT)
    )


def change_pct(now: Column, before: Column) -> Column:
    """Percent change to one digit; 0 to n is +infinity, 0 to 0 is null."""
    return F.when(before > 0, round_even(F.lit(100.0) * (now - before) / before, 1)).when(
        (before == 0) & (now != 0), F.lit(float("inf"))
    )


def between_or_null(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)

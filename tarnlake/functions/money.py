"""Sums and means of money held in DOUBLE columns.

A plain double sum depends on the order rows arrive in. Rounding to cents hides that on a few rows,
but not on the billions a daily total covers at scale, where a retried task may change the result.
These aggregates add whole units (10^-decimals) in two long sums, so every order gives the same
exact total, and what is smaller than a unit in two more, as multiples of 2^-58. They cost a few double
sums; a decimal sum costs some ten times more than one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LARGE = 2.0**30
_LOW_BITS = 20  # low part below 2^20 per row: no overflow below 2^43 rows per group
_COARSE, _FINE = 2.0**36, 2.0**58  # what is below a unit: parts below 2^36 and 2^22 per row


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def money_sum(column: str | Column, decimals: int = 4) -> Column:
    """SUM as DOUBLE, exact for values of at most ``decimals`` decimal places; NULL if all are NULL.

    Every amount is taken apart: whole multiples of 2^30 (only where it has 2^50 units or more), whole units, and
    what is smaller than a unit, which is 0 for amounts of at most ``decimals`` places and otherwise rounded to a
    multiple of 2^-58 (3.5e-18). All of them add up as whole numbers, so the result is the same to the last bit in
    any order, up to totals of 2^83. Only NaN, infinities and amounts of 2^92 or more are added as doubles.
    """
    amount = _column(column)
    unit = float(10**decimals)
    finite = F.abs(amount) < F.lit(2.0**92)
    large = finite & (F.abs(amount) >= F.lit(2.0**50 / unit))
    pieces = (amount / F.lit(_LARGE)).cast("bigint").cast("double")
    base = F.when(large, amount - pieces * F.lit(_LARGE)).when(finite, amount)
    units = F.rint(base * F.lit(unit)).cast("bigint")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(19,0)")
    exact = (high * F.lit(Decimal(1 << _LOW_BITS)) + low) * F.lit(Decimal(1).scaleb(-decimals))
    above = F.coalesce(F.sum(F.when(large, pieces)), F.lit(0.0)) * F.lit(_LARGE)
    rest = base - units.cast("double") / F.lit(unit)
    coarse = F.floor(rest * F.lit(_COARSE))
    fine = F.rint((rest - coarse.cast("double") / F.lit(_COARSE)) * F.lit(_FINE)).cast("bigint")
    below = F.sum(coarse).cast("double") / F.lit(_COARSE) + F.sum(fine).cast("double") / F.lit(_FINE)
    others = F.sum(F.when(~finite, amount))
    total = exact.cast("double") + above + below
    return F.when(others.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + others)


def money_avg(column: str | Column, decimals: int = 4) -> Column:
    """AVG as DOUBLE over the same exact total; NULLs are skipped, an all-NULL group gives NULL."""
    return F.try_divide(money_sum(column, decimals), F.count(_column(column)))

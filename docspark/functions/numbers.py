"""Tolerances of printed arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ABSOLUTE, RELATIVE, GROSS = 0.05, 0.005, 0.05


def within(expected: Column, stated: Column) -> Column:
    delta = F.abs(stated - expected)
    return (delta <= ABSOLUTE) | (delta <= RELATIVE * F.greatest(F.abs(expected), F.lit(1e-9)))


def gross(expected: Column, stated: Column) -> Column:
    return ~within(expected, stated) & (F.abs(stated - expected) / F.greatest(F.abs(expected), F.lit(1e-9)) >= GROSS)


def in_rate_band(qty: Column, rate: Column, stated: Column, decimals: Column) -> Column:
    """Whether a rate that was rounded to its printed decimals can give the stated amount."""
    half = 0.5 * F.pow(F.lit(10.0), -decimals)
    a, b = qty * (rate - half), qty * (rate + half)
    return (stated >= F.least(a, b) - ABSOLUTE) & (stated <= F.greatest(a, b) + ABSOLUTE)

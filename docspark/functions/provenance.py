"""What producer and creator strings give away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of lower-cased names.
WEB_EDITORS = [
    "sejda", "ilovepdf", "smallpdf", "pdfescape", "foxit", "pdf editor", "pdf24", "soda pdf", "sodapdf", "nitro",
    "pdffiller", "docfly", "cleverpdf", "lightpdf", "deftpdf", "online2pdf", "pdfcandy",
]
BROWSERS = ["mozilla", "firefox", "chrome", "chromium", "safari", "edge", "opera"]
VERSION_ONLY = r"^\s*\d+\.\d+(?:\.\d+)?\s*(?:\(\d+(?:\.\d+)*\)\s*)?$"
CEILING = 60


def named_in(c: Column, names: list[str]) -> Column:
    """The first of the names that the lower-cased text contains, else null."""
    low = F.lower(c)
    return reduce(lambda w, n: w.when(low.contains(n), n), names, F)


def version_only(c: Column) -> Column:
    return c.rlike(VERSION_ONLY)


def differ(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.trim(a) != F.trim(b))


def capped(*scores: Column) -> Column:
    """The largest score, never above the ceiling of a stage that only corroborates."""
    return F.least(F.lit(CEILING), F.greatest(F.lit(0), *scores))

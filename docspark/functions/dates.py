"""Dates as PDF metadata writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: D: is optional, and everything after the year is.
PDF_DATE = r"^\s*(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Zz+-])(?:(\d{2})'?(\d{2})?'?)?)?"


def parse_pdf_date(c) -> Column:
    """A TIMESTAMP_NTZ in UTC; null if the text is none or names a day or time there isn't."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(c, PDF_DATE, i), F.lit("")).try_cast("int"), F.lit(default))
    there = c.rlike(PDF_DATE)
    naive = F.try_make_timestamp_ntz(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(8,6)"))
    minutes = part(8, 0) * 60 + part(9, 0)
    sign = F.regexp_extract(c, PDF_DATE, 7)
    shift = F.when(sign == "+", -minutes).when(sign == "-", minutes).otherwise(0)
    return F.when(there, naive + F.make_dt_interval(F.lit(0), F.lit(0), shift))

"""Font names, and what tells one face from another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUBSET = r"^([A-Z]{6})\+(.+)$"
STYLE_WORDS = [
    "bold", "italic", "oblique", "bolditalic", "boldoblique", "regular", "roman", "medium", "light", "semibold",
    "demibold", "black", "heavy", "thin", "condensed", "narrow", "mt", "ps", "psmt",
]
VENDOR = r"(?:PSMT|PS|MT)$"


def subset_tag(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, SUBSET, 1), F.lit(""))


def base(c: Column) -> Column:
    return F.when(c.rlike(SUBSET), F.regexp_extract(c, SUBSET, 2)).otherwise(c)


def family(c: Column) -> Column:
    parts = F.transform(F.split(base(c), "[-,]"), lambda p: F.regexp_replace(p, VENDOR, ""))
    kept = F.filter(parts, lambda p, i: (i == 0) | (~F.lower(p).isin(STYLE_WORDS) & (p != "")))
    return F.array_join(kept, "-")


def placeholder(c: Column) -> Column:
    return F.lower(c).isin("", "unknown")


def subset_split(a: Column, b: Column) -> Column:
    """The same face from two subsets."""
    return (base(a) == base(b)) & subset_tag(a).isNotNull() & subset_tag(b).isNotNull() & (subset_tag(a) != subset_tag(b))


def other_family(a: Column, b: Column) -> Column:
    return (family(a) != family(b)) & ~placeholder(a) & ~placeholder(b)

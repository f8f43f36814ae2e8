"""Dominant values, and rows that deviate from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
PERVASIVE, PERVASIVE_LEAST = 0.30, 8


def dominant(df: DataFrame, by: list[str], value: str, name: str = "dominant") -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones. Two aggregations; the first is
    combined before the shuffle, so a group of any size sends each value once per partition."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best["v"].alias(name), F.count(F.lit(1)).alias("n_distinct"))


def pervasive(df: DataFrame, by: list[str], mixed, share: float = PERVASIVE, least: int = PERVASIVE_LEAST) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(mixed)
    return df.groupBy(*by).agg(n.alias("inspected"), k.alias("mixed"), ((n >= least) & (k / n >= share)).alias("pervasive"))


def form_data_fonts(tokens: DataFrame, by: list[str], font: str, kind: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """by, font: faces that hold ``share`` of a document's amounts and dates, if it has ``least`` of them. One aggregation
    by face, whose few rows are then summed by document."""
    n = tokens.where(F.col(kind).isin("amount", "date") & F.col(font).isNotNull()).groupBy(*by, font).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    return n.join(total, by).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select(*by, font)

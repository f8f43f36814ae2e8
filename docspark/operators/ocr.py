"""Text layer against recognised text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
BASE = {"agree": 0.0, "mismatch": 1.0, "ocr_only": 0.7, "embedded_only": 0.6}
FACTOR = {"amount": 3.0, "date": 3.0, "id": 1.5, "prose": 1.0}
LEAST_WORDS, SPARSE_SHARE, CONFIDENCE = 10, 0.10, 0.50
MASS, MASS_SHARE, ORPHANS, ORPHAN_CAP = 2.0, 0.02, 2, 2
HIGH_MISMATCH, HIGH_ORPHANS, MEDIUM, LOW = 95, 75, 50, 15


def weight(kind: Column, cls: Column) -> Column:
    look = lambda c, d: reduce(lambda w, x: w.when(c == x[0], x[1]), d.items(), F).otherwise(0.0)
    return look(kind, BASE) * look(cls, FACTOR)


def capped_mass(df: DataFrame, by: list[str], kind: str, text: str, w: str, order: list) -> DataFrame:
    """Sum of weights, of equal orphans only the first two. Groups are cut to those before the sum."""
    n = F.row_number().over(W.partitionBy(*by, kind, text).orderBy(*order))
    counted = df.withColumn("_n", n).where((F.col(kind) == "mismatch") | (F.col("_n") <= ORPHAN_CAP))
    return counted.groupBy(*by).agg(F.sum(F.col(w).cast("decimal(18,6)")).cast("double").alias("mass"))


def sparse(n_text: Column, n_ocr: Column) -> Column:
    return (n_text < LEAST_WORDS) | ((n_ocr > 0) & (n_text < SPARSE_SHARE * n_ocr))


def score(routed: Column, compared: Column, mismatches: Column, orphans: Column, mass: Column) -> tuple[Column, Column]:
    """tier and score; mismatches and orphans are those of amounts and dates."""
    rules = [
        (routed | (compared == 0), "inconclusive", None),
        (mismatches > 0, "high", HIGH_MISMATCH),
        (orphans >= ORPHANS, "high", HIGH_ORPHANS),
        (orphans > 0, "medium", MEDIUM),
        (mass >= F.greatest(F.lit(MASS), MASS_SHARE * compared), "medium", MEDIUM),
        (mass > 0, "low", LOW),
    ]
    pick = lambda i: reduce(lambda w, r: w.when(r[0], F.lit(r[i])), rules, F)
    return pick(1).otherwise("low"), pick(2).otherwise(0).cast("int")

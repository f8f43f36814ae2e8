"""Printed equations: line items, totals, and which correction repairs most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.numbers import ABSOLUTE, RELATIVE, gross, within

# Scores.
HIGH_AMOUNT, MEDIUM_GROSS, MEDIUM_MINOR, LOW_RECONCILED, LEAST_CELLS = 92, 65, 45, 10, 4


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def check(expected: Column, stated: Column) -> list[Column]:
    return [expected.alias("expected"), stated.alias("stated"), F.round(stated - expected, 4).alias("delta"),
            within(expected, stated).alias("within"), gross(expected, stated).alias("gross")]


def fixes(expected: Column, new: Column) -> Column:
    """Whether an equation holds once a cell is set to its corrected value."""
    return F.abs(new - expected) <= F.greatest(F.lit(ABSOLUTE), 1e-6 + RELATIVE * F.abs(expected))


def score(cells: Column, relationships: Column, broken: Column, best_convergence: Column, any_gross: Column) -> tuple[Column, Column]:
    """tier and score of a document's arithmetic."""
    short = (cells < LEAST_CELLS) | (relationships < 1)
    tier = (F.when(short, "inconclusive").when(broken == 0, "low").when(best_convergence >= 2, "high").otherwise("medium"))
    points = (F.when(short, F.lit(None).cast("int")).when(broken == 0, LOW_RECONCILED).when(best_convergence >= 2, HIGH_AMOUNT)
              .when(any_gross, MEDIUM_GROSS).otherwise(MEDIUM_MINOR))
    return tier, points


def invoice_check(lines: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """key, tier, score, broken, convergence. lines: key, expected, amount; totals: key, subtotal.

    Lines are summed up once for each document. A broken line whose correction also repairs the subtotal converges; the
    subtotal of a document is one row, so the check joins each broken line with one row, not lines with lines.
    """
    sums = lines.groupBy(key).agg(
        exact_sum(F.col("amount")).alias("total"), F.count("amount").alias("n"),
        F.count_if(~within(F.col("expected"), F.col("amount"))).alias("bad_lines"),
        F.max(gross(F.col("expected"), F.col("amount"))).alias("gross_line"))
    doc = totals.join(sums, key, "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "bad_lines": F.coalesce("bad_lines", F.lit(0)),
        "bad_sum": F.when(F.col("n") >= 2, ~within(F.col("total"), F.col("subtotal"))).otherwise(F.lit(False)),
        "gross_sum": F.when(F.col("n") >= 2, gross(F.col("total"), F.col("subtotal"))).otherwise(F.lit(False))})
    bad = lines.where(~within(F.col("expected"), F.col("amount"))).join(doc.where("bad_sum").select(key, "total", "subtotal"), key)
    repaired = bad.where(fixes(F.col("subtotal"), F.col("total") - F.col("amount") + F.col("expected")))
    best = repaired.groupBy(key).agg(F.lit(2).alias("best"))
    doc = doc.join(best, key, "left")
    broken = F.col("bad_lines") + F.col("bad_sum").cast("int")
    convergence = F.when(broken > 0, F.coalesce("best", F.lit(1))).otherwise(0)
    cells = F.when(F.col("n") >= 1, 3 * F.col("n")).otherwise(0)  # quantity, rate and amount of each line
    tier, points = score(cells, F.col("n"), broken, convergence, F.coalesce("gross_line", F.lit(False)) | F.col("gross_sum"))
    return doc.select(key, tier.alias("tier"), points.alias("score"), broken.cast("int").alias("broken"), convergence.cast("int").alias("convergence"))

"""Guards that keep harmless words out of a comparison, and counts of what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pixels around a page, least confidence, orphans of a page from which on they count.
PAGE_MARGIN, LEAST_CONFIDENCE, ORPHANS = 2.0, 0.5, 8


def on_page(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = PAGE_MARGIN) -> Column:
    """Whether a box's center lies on the page."""
    return ((x0 + x1) / 2).between(-margin, width + margin) & ((y0 + y1) / 2).between(-margin, height + margin)


def confident(confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """A word without a confidence is trusted."""
    return confidence.isNull() | (confidence >= least)


def kept_and_dropped(rows: DataFrame, by: list[str], keep: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def without_graphics(words: DataFrame, boxes: DataFrame, by: list[str], touch: Column, least: int = ORPHANS) -> DataFrame:
    """Recognised words without those that touch no box of the text layer, unless their page has ``least`` of them or more.
    touch compares columns of words and of boxes; ``by`` names the page in both."""
    keyed = words.withColumn("_row", F.monotonically_increasing_id())
    near = words.columns
    touching = keyed.join(boxes, [*by]).where(touch).select(*by, "_row").distinct().withColumn("_touches", F.lit(True))
    flagged = keyed.join(touching, [*by, "_row"], "left").withColumn("_touches", F.coalesce("_touches", F.lit(False)))
    many = flagged.groupBy(*by).agg((F.count_if(~F.col("_touches")) >= least).alias("_many"))
    return flagged.join(many, by).where("_touches OR _many").select(*near)


def diagnostics(rows: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """Counts of a document's comparison, in one aggregation."""
    n = lambda *kinds: F.count_if(F.col(kind).isin(*kinds))
    return rows.groupBy(*by).agg(
        n("offpage").alias("offpage_dropped"), n("low_confidence").alias("low_conf_dropped"), n("agree", "mismatch").alias("matched"), n("agree").alias("agree"),
        n("mismatch").alias("mismatch"), n("agree", "mismatch", "embedded_only", "ocr_only").alias("compared"))


def looks_incomplete(primary_chars: Column, glyph_chars: Column, primary_tokens: Column, glyph_tokens: Column, least: int = 20, ratio: float = 0.5) -> Column:
    """Whether a text layer is a fragment: glyphs give at least ``least`` characters and more than 1 / ratio of what it
    has, or tokens of value that it lacks."""
    return (glyph_chars >= least) & ((primary_chars < ratio * glyph_chars) | (F.size(F.array_except(glyph_tokens, primary_tokens)) > 0))

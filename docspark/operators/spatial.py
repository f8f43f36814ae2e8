"""Joins of boxes. Boxes are dealt into grid cells, so only boxes that share a cell are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.geometry import contains_center, iou


def _cells(boxes: DataFrame, side: str, cell: float) -> DataFrame:
    at = lambda k: F.floor(F.col(f"{side}_{k}") / cell)
    return (boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1")))))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Pairs of boxes (a_*, b_*) of the same page that overlap, each once: in the cell of their common corner."""
    pairs = _cells(a, "a", cell).join(_cells(b, "b", cell), [*by, "_cx", "_cy"])
    corner = lambda k: F.floor(F.greatest(F.col(f"a_{k}"), F.col(f"b_{k}")) / cell)
    return pairs.where((F.col("_cx") == corner("x0")) & (F.col("_cy") == corner("y0"))).drop("_cx", "_cy")


def iou_pairs(a: DataFrame, b: DataFrame, by: list[str], cell: float, least: float = 0.3) -> DataFrame:
    return overlapping(a, b, by, cell).withColumn("iou", iou("a", "b")).where(F.col("iou") >= least)


def first_container(words: DataFrame, boxes: DataFrame, by: list[str], cell: float, word_id: str, box_id: str) -> DataFrame:
    """Each word (a_*) with the first box (b_*) that holds its center; words without one are left out."""
    x, y = (F.col("a_x0") + F.col("a_x1")) / 2, (F.col("a_y0") + F.col("a_y1")) / 2
    points = words.withColumn("_cx", F.floor(x / cell)).withColumn("_cy", F.floor(y / cell))
    found = points.join(_cells(boxes, "b", cell), [*by, "_cx", "_cy"]).where(contains_center("b", "a"))
    return found.groupBy(*by, word_id).agg(F.min(box_id).alias(box_id))

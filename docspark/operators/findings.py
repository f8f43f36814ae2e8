"""Findings as rows: made from a stage's own rows, ordered, grouped for display, and joined with boxes and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators.fusion import rank

#: The columns that findings of all stages share.
COMMON = ["stage", "tier", "reason", "page", "object_ids", "before", "after", "high_value"]
KINDS = {"string": ("stage", "tier", "reason", "before", "after", "high_value"), "int": ("page",), "array<string>": ("object_ids",)}


def adapt(rows: DataFrame, keys: list[str], stage: str, columns: dict[str, Column]) -> DataFrame:
    """A stage's rows as findings: keys and the common columns, null where the stage has none."""
    kind = {c: k for k, cs in KINDS.items() for c in cs}
    given = {"stage": F.lit(stage), **columns}
    return rows.select(*keys, *[given.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in COMMON])


def arithmetic(relations: DataFrame) -> DataFrame:
    """relations (convergence, stated, within among its columns) that are broken, with tier and high_value."""
    converges = F.col("convergence") >= 2
    shown = F.col("stated")
    high = F.coalesce(text.kind(shown), F.when(text.parse_amount(shown).isNotNull(), "amount"))
    return relations.where(~F.col("within")).withColumns({"tier": F.when(converges, "high").otherwise("medium"), "high_value": high})


def ordered(findings: DataFrame, document: list[str], order: list, name: str = "place") -> DataFrame:
    """Numbers a document's findings from 1 by the given order."""
    return findings.withColumn(name, F.row_number().over(W.partitionBy(*document).orderBy(*order)))


def arithmetic_order(tier="tier", convergence="convergence", page="page", x0="x0") -> list:
    return [rank(tier).desc(), F.desc(convergence), page, x0]


def font_order(page="page", tier="tier", x0="x0") -> list:
    return [page, rank(tier).desc(), x0]


def localizable(findings: DataFrame, box: str = "bbox", page: str = "page") -> DataFrame:
    return findings.where(F.col(box).isNotNull() & F.col(page).isNotNull())


def shown_groups(findings: DataFrame, keys: list[str], kind: str, token_class: str) -> DataFrame:
    """Findings by type and token class, a missing class as an empty one."""
    return findings.groupBy(*keys, kind, F.coalesce(token_class, F.lit("")).alias(token_class)).agg(F.count(F.lit(1)).alias("n"))


def explain(findings: DataFrame, glossary: DataFrame, kind: str, fallback: tuple[str, str]) -> DataFrame:
    """findings with meaning and implication. glossary (type, meaning, implication) is a table of the program, a row per type."""
    joined = findings.join(F.broadcast(glossary), findings[kind] == glossary["type"], "left").drop("type")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in zip(("meaning", "implication"), fallback)})


def with_payload(findings: DataFrame, payload: DataFrame, keys: list[str], at: str, order: list, skip: Column) -> DataFrame:
    """Joins each finding with the row of its stage's payload at the same place, after the rows that ``skip`` names are left out."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = payload.where(~skip).withColumn(at, F.row_number().over(w) - 1)
    return findings.join(rows, [*keys, at], "left")


def guarded_box(boxes: Column, same_page: Column, same_object: Column, width: Column, height: Column) -> Column:
    """The union of boxes (an array of structs x0, y0, x1, y1), null unless page and object agree, the page has a size and
    the boxes are not all zero."""
    edge = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    union = F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))
    some = F.exists(boxes, lambda b: (b["x0"] != 0) | (b["y0"] != 0) | (b["x1"] != 0) | (b["y1"] != 0))
    return F.when(same_page & same_object & (width > 0) & (height > 0) & (F.size(boxes) > 0) & some, union)


def uncited(advisories: DataFrame, cited: DataFrame, supplied: DataFrame, key: str, finding: str) -> DataFrame:
    """advisories with grounded: whether every finding that one cites was supplied to it; else a template is to be used."""
    strange = cited.join(supplied, [key, finding], "left_anti").select(key).distinct().withColumn("_strange", F.lit(True))
    return advisories.join(strange, key, "left").withColumn("grounded", F.col("_strange").isNull()).drop("_strange")

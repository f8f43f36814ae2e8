"""Objects that a later version of a file writes: their values, what kind of change each is, and what findings follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a finding says of an object change without text evidence.
FLAGGED = {"overlay": "overlay", "field_edit": "field_edit", "form_fill": "form_fill"}
COVERING = ["/Stamp", "/Redact"]
PLUMBING = ["/XRef", "/ObjStm"]
TREE = ["/Catalog", "/Pages"]
UNFILLED = ["", "()", "/", "b''"]


def value_signature(value: Column) -> Column:
    """Equal for equal serialised values; null for none, so compare with eqNullSafe."""
    return F.sha2(value, 256)


def unfilled(value: Column) -> Column:
    """Whether a form field's value counts as not filled in."""
    v = F.trim(value)
    return value.isNull() | (F.lower(v) == "null") | v.isin(UNFILLED)


def classify(objects: DataFrame) -> DataFrame:
    """objects with change and page. Columns: signature, form, metadata, contents_changed, overlaps, is_stream (boolean);
    old_value, new_value, type, subtype (string); annot_page, content_page, page_no (int, null if the object isn't one).

    The first rule that fits decides; all roles of an object have been joined to its row before, so this is one projection.
    """
    c = F.col
    plain, old, new = ~c("is_stream"), c("old_value"), c("new_value")
    of = lambda name, *values: F.coalesce(c(name).isin(*values), F.lit(False))
    edited = c("form") & ~value_signature(old).eqNullSafe(value_signature(new))
    annot = c("annot_page").isNotNull() | (plain & of("type", "/Annot"))
    covers = of("subtype", *COVERING) | (c("annot_page").isNotNull() & c("overlaps"))
    none = F.lit(None).cast("int")
    rules = [
        (c("signature") | (plain & of("type", "/Sig")), "signature", none),
        (edited & unfilled(old) & ~unfilled(new), "form_fill", none),
        (edited, "field_edit", none),
        (annot & covers, "overlay", c("annot_page")),
        (annot, "markup", c("annot_page")),
        (c("content_page").isNotNull(), "content", c("content_page")),
        (plain & of("type", "/Page") & c("contents_changed"), "content", c("page_no")),
        (c("is_stream") & of("subtype", "/Form"), "content", none),
        (c("metadata") | (c("is_stream") & (of("subtype", "/XML") | of("type", *PLUMBING))) | (plain & of("type", *TREE)), "meta", none),
        (plain & of("type", "/Page"), "markup", none),
    ]
    pick = lambda i, last: reduce(lambda w, r: w.when(r[0], r[i] if i == 2 else F.lit(r[i])), rules, F).otherwise(last)
    return objects.withColumns({"change": pick(1, F.lit("content")), "page": pick(2, none)})


def class_sets(changes: DataFrame, by: list[str], change: str = "change") -> DataFrame:
    """by, classes: the sorted distinct classes of change."""
    return changes.groupBy(*by).agg(F.sort_array(F.collect_set(change)).alias("classes"))


def written(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """The objects that any of the parts of an increment writes, once each."""
    return reduce(DataFrame.unionByName, [p.select(*by) for p in parts]).distinct()


def revision_findings(texts: DataFrame, changes: DataFrame, pair: list[str]) -> DataFrame:
    """pair, kind, page, objects. texts: pair, page (one row per page whose text differs); changes: pair, object, change, page.

    A text finding lists the content objects of its pair that lie on its page, or whose page is not known; overlays, field
    edits and form fills are findings of their own; content that changed where no page of the pair differs is one, too.
    """
    content = changes.where(F.col("change") == "content")
    near = content.select(*pair, F.col("page").alias("_at"), "object")
    same = [F.col("t." + k) == F.col("o." + k) for k in pair] + [F.col("t.page").isNull() | F.col("_at").isNull() | (F.col("t.page") == F.col("_at"))]
    found = texts.alias("t").join(near.alias("o"), same, "left").groupBy(*[F.col("t." + k) for k in pair], F.col("t.page")).agg(F.sort_array(F.collect_set("o.object")).alias("objects"))
    alone = changes.where(F.col("change").isin(*FLAGGED)).select(*pair, F.col("change").alias("kind"), "page", F.array("object").alias("objects"))
    unseen = content.join(texts.select(*pair).distinct(), pair, "left_anti").select(*pair, F.lit("content_without_text").alias("kind"), "page", F.array("object").alias("objects"))
    return found.select(*pair, F.lit("text").alias("kind"), "page", "objects").unionByName(alone).unionByName(unseen)

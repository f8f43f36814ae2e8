"""Rule trees over the findings of one stage: revisions, fonts, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import dates, fonts, provenance

# Scores.
REVISION = {"content_no_text": 60, "overlay": 55, "field_edit": 50, "recon_failure": 40}
FONT = {"high_value": 95, "high_id": 80, "subset_split": 55, "whole_token": 55, "baseline": 45, "intra_token": 50, "low_document": 20, "low": 15}


def _tree(rules: list[tuple[Column, str, int | None]], tier: str, points: int | None) -> tuple[Column, Column]:
    pick = lambda i, last: reduce(lambda w, r: w.when(r[0], F.lit(r[i])), rules, F).otherwise(F.lit(last))
    return pick(1, tier), pick(2, points).cast("int")


def revision_score(revisions: Column, content: Column, high_value: Column, changed: Column, present: dict[str, Column]) -> tuple[Column, Column]:
    """tier and score. content: an object with text changed; changed: its text differs; high_value: the kind that did."""
    real = content & changed
    rules = [
        (revisions <= 1, "inconclusive", None), (real & high_value.isin("amount", "date"), "high", 95), (real & (high_value == "id_like"), "high", 85), (real, "high", 75),
    ]
    rules += [(present[k], "medium", v) for k, v in sorted(REVISION.items(), key=lambda x: -x[1]) if k in present]
    return _tree(rules, "low", 15)


def font_score(glyphs: Column, n_fonts: Column, present: dict[str, Column]) -> tuple[Column, Column]:
    """tier and score; present: which kinds of finding there are."""
    has = lambda k: present.get(k, F.lit(False))
    rules = [(((glyphs < 2) | (n_fonts <= 1)), "inconclusive", None), (has("high_value"), "high", 95), (has("high_id"), "high", 80)]
    rules += [(has(k), "medium", FONT[k]) for k in ("subset_split", "whole_token", "intra_token", "baseline")]
    return _tree([*rules, (has("low_document"), "low", 20)], "low", 15)


def token_font_mix(glyphs: DataFrame, token: list[str], font: str = "fontname") -> DataFrame:
    """token, dominant, n_subset, n_family: glyphs of a token that come from another subset of its dominant face, or from
    another family. Spaces are left out by the caller."""
    counts = glyphs.groupBy(*token, font).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*token).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(font).alias("f"))).alias("b")).select(*token, F.col("b.f").alias("dominant"))
    rows = counts.join(best, token)
    of = lambda test: F.sum(F.when(test(F.col(font), F.col("dominant")), F.col("n")).otherwise(0))
    return rows.groupBy(*token, "dominant").agg(of(fonts.subset_split).alias("n_subset"), of(fonts.other_family).alias("n_family"))


def provenance_findings(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, score, tier: one row per signal of a document's metadata. meta: producer, creator, creation_date,
    mod_date, xmp_producer, id_first, id_second, any of them null."""
    c = F.col
    editor = F.coalesce(provenance.named_in(c("producer"), provenance.WEB_EDITORS), provenance.named_in(c("creator"), provenance.WEB_EDITORS))
    web = editor.isNotNull()
    version = ~web & F.coalesce(provenance.version_only(c("producer")), F.lit(False))
    browser = provenance.named_in(c("creator"), provenance.BROWSERS).isNotNull()
    later = F.coalesce(dates.parse_pdf_date("mod_date") > dates.parse_pdf_date("creation_date"), F.lit(False))
    signals = [
        ("web_editor_producer", web, 45), ("version_only_producer", version, 35), ("browser_creator", browser, 20), ("moddate_after_creation", later, 25),
        ("xmp_info_producer_mismatch", provenance.differ(c("xmp_producer"), c("producer")), 40), ("id_halves_mismatch", provenance.differ(c("id_first"), c("id_second")), 35),
        ("composite_edit_footprint", (web | version) & (browser | later), 55),
    ]
    rows = F.array(*[F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("score"))) for k, test, s in signals])
    found = meta.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s")).select(key, "s.kind", "s.score")
    return found.withColumn("tier", F.when(F.col("score") >= 40, "medium").otherwise("low"))


def provenance_score(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tier, score: never above medium, never above the ceiling; unreadable metadata tells nothing."""
    found = provenance_findings(meta, key).groupBy(key).agg(F.max("score").alias("top"), F.max((F.col("tier") == "medium").cast("int")).alias("m"))
    fields = ["producer", "creator", "creation_date", "mod_date", "xmp_producer", "id_first", "id_second"]
    rows = meta.select(key, F.coalesce(*fields).isNull().alias("unread")).join(found, key, "left")
    tier = F.when(F.col("unread"), "inconclusive").when(F.col("m") == 1, "medium").otherwise("low")
    points = F.when(~F.col("unread"), F.least(F.lit(provenance.CEILING), F.coalesce("top", F.lit(0))))
    return rows.select(key, tier.alias("tier"), points.cast("int").alias("score"))

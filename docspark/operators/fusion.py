"""From stage results to one verdict, and what may leave the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values.
TIERS = {"inconclusive": 0, "low": 1, "medium": 2, "high": 3}
CORROBORATORS = ["provenance_metadata"]
BONUS, FLOOR, MOST, LOW_SCORE = 20, 70, 100, 15
ALLOWED = ["finding_id", "stage", "type", "tier", "score", "token_class", "page", "bbox"]


def rank(tier) -> Column:
    tier = F.col(tier) if isinstance(tier, str) else tier
    return reduce(lambda w, t: w.when(tier == t[0], t[1]), TIERS.items(), F)


def tier_of(r: Column) -> Column:
    return reduce(lambda w, t: w.when(r == t[1], t[0]), TIERS.items(), F)


def fuse(results: DataFrame, key: str, corroborators=CORROBORATORS) -> DataFrame:
    """key, tier, score, stages. results: key, stage, tier, score, ok. One aggregation by document.

    A corroborating stage escalates a medium verdict but never makes one.
    """
    ok, sub = F.col("ok"), F.col("ok") & ~F.col("stage").isin(corroborators)
    of = lambda tier: sub & (F.col("tier") == tier)
    top = lambda cond: F.max(F.when(cond, F.col("score")))
    fires = ok & F.col("stage").isin(corroborators) & F.col("tier").isin("medium", "high")
    a = results.groupBy(key).agg(
        *[F.count_if(of(t)).alias(t) for t in ("high", "medium", "low")], *[top(of(t)).alias(f"s_{t}") for t in ("high", "medium", "low")],
        F.count_if(fires).alias("fires"), F.count_if(ok & (F.col("tier") == "low")).alias("cleared"), top(ok & (F.col("tier") == "low")).alias("s_cleared"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("stage")))), ",").alias("stages"))
    escalates = (F.col("medium") >= 2) | (F.col("fires") > 0)
    base = F.coalesce("s_medium", F.lit(50))
    rules = [
        (F.col("high") > 0, "high", F.coalesce("s_high", F.lit(FLOOR))),
        ((F.col("medium") > 0) & escalates, "high", F.least(F.lit(MOST), F.greatest(F.lit(FLOOR), base + BONUS))),
        (F.col("medium") > 0, "medium", base),
        (F.col("low") > 0, "low", F.coalesce("s_low", F.lit(LOW_SCORE))),
        (F.col("fires") > 0, "low", F.lit(LOW_SCORE)),
        (F.col("cleared") > 0, "low", F.coalesce("s_cleared", F.lit(LOW_SCORE))),
    ]
    pick = lambda i: reduce(lambda w, r: w.when(r[0], F.lit(r[i]) if isinstance(r[i], str) else r[i]), rules, F)
    return a.select(key, pick(1).otherwise("inconclusive").alias("tier"), pick(2).cast("int").alias("score"), "stages")


def roll_up(findings: DataFrame, keys: list[str], tier: str = "tier", page: str = "page") -> DataFrame:
    """One row per group: its highest tier, count and sorted distinct pages."""
    return findings.groupBy(*keys).agg(
        tier_of(F.max(rank(tier))).alias("tier"), F.count(F.lit(1)).alias("n_findings"),
        F.array_join(F.transform(F.array_sort(F.collect_set(page)), lambda p: p.cast("string")), ",").alias("pages"))


def finding_ids(findings: DataFrame, document: str, stage: str, order: list) -> DataFrame:
    """Adds finding_id, numbered from 0 within a document's stage."""
    n = F.row_number().over(W.partitionBy(document, stage).orderBy(*order)) - 1
    return findings.withColumn("finding_id", F.concat_ws("-", F.col(stage), n.cast("string")))


def project_allowed(findings: DataFrame) -> DataFrame:
    """Only the allowed columns; fails on a column beyond them, before anything runs."""
    extra = [c for c in findings.columns if c not in ALLOWED]
    if extra:
        raise ValueError(f"columns that may not leave: {extra}")
    return findings.select(*[c for c in ALLOWED if c in findings.columns])

"""Words of a text layer matched with recognised boxes, and what the matches say."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text

LEAST_IOU = 0.30


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.maximum(0.0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]))
    h = np.maximum(0.0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))
    both = w * h
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    return np.divide(both, area - both, out=np.zeros(len(b)), where=both > 0)


def match_page(words: np.ndarray, boxes: np.ndarray, least: float = LEAST_IOU) -> list[int]:
    """For each word the place of its box, or -1. First the first box that holds the word's center; the words left take,
    in order, the box of the best IoU among those that no word has (ties: the first)."""
    took = np.full(len(words), -1)
    if not len(words) or not len(boxes):
        return took.tolist()
    for i, (x0, y0, x1, y1) in enumerate(words):
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        holds = (boxes[:, 0] <= x) & (x <= boxes[:, 2]) & (boxes[:, 1] <= y) & (y <= boxes[:, 3])
        if holds.any():
            took[i] = int(np.argmax(holds))
    free = np.ones(len(boxes), bool)
    free[took[took >= 0]] = False
    for i in np.flatnonzero(took < 0):
        v = np.where(free, _iou(words[i], boxes), 0.0)
        best = int(np.argmax(v))
        if v[best] >= least:
            took[i], free[best] = best, False
    return took.tolist()


def match_words(words: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, embedded (texts in reading order), recognised: a row per box with words, per word without a box (recognised
    is null) and per box without words (embedded is null). Both sides: by, pos (order on the page), text, x0, y0, x1, y1."""
    sides = ("x0", "y0", "x1", "y1")
    kinds = dict(words.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", embedded array<string>, recognised string"

    def run(key, left, right):
        import pandas as pd

        left, right = (x.reindex(columns=["pos", "text", *sides]).sort_values("pos") for x in (left, right))  # a missing side has no columns
        a, b = (x[list(sides)].to_numpy(float).reshape(-1, 4) for x in (left, right))
        took = match_page(a, b)
        texts, seen = left["text"].tolist(), right["text"].tolist()
        held: dict[int, list[int]] = {}
        for i, j in enumerate(took):
            if j >= 0:
                held.setdefault(j, []).append(i)
        center = lambda i: ((a[i, 1] + a[i, 3]) / 2, (a[i, 0] + a[i, 2]) / 2)
        rows = [([texts[i] for i in sorted(held[j], key=center)], seen[j]) for j in sorted(held)]
        rows += [([texts[i]], None) for i, j in enumerate(took) if j < 0] + [(None, x) for j, x in enumerate(seen) if j not in held]
        out = pd.DataFrame(rows, columns=["embedded", "recognised"])
        for c, k in reversed(list(zip(by, key))):
            out.insert(0, c, k)
        return out

    return words.groupBy(*by).cogroup(boxes.groupBy(*by)).applyInPandas(run, schema)


def same_bag(a: Column, b: Column) -> Column:
    """The same folded tokens, more than one, in any order."""
    bag = lambda c: F.array_sort(F.transform(text.tokens(c), text.fold))
    return (F.size(text.tokens(a)) > 1) & (bag(a) == bag(b))


def _most_sensitive(tokens: Column) -> Column:
    classes = F.transform(tokens, lambda t: text.token_class(t))
    has = lambda k: F.array_contains(classes, k)
    return F.when(has("amount"), "amount").when(has("date"), "date").when(has("id"), "id").otherwise("prose")


def classify(matched: DataFrame) -> DataFrame:
    """matched with kind (agree, mismatch, embedded_only, ocr_only) and cls. A line of several tokens with an amount or date
    agrees if each of these is in the recognised text and the line is within the tolerance of prose."""
    line = F.array_join("embedded", " ")
    rows = matched.withColumn("_line", line)
    rows = rows.withColumn("_tokens", text.tokens(F.coalesce(F.col("_line"), F.col("recognised"))))
    rows = rows.withColumn("cls", _most_sensitive(F.col("_tokens")))
    strict = F.col("cls").isin("amount", "date")
    a, b = F.col("_line"), F.col("recognised")
    high = F.filter("_tokens", lambda t: text.token_class(t) == F.col("cls"))
    intact = F.forall(high, lambda t: F.contains(text.fold(b), text.fold(t)))
    agree = F.when(strict & (F.size("_tokens") > 1), intact & text.within_tolerance(a, b, F.lit("prose"))).otherwise(
        text.within_tolerance(a, b, F.col("cls")) | (~strict & same_bag(a, b)))
    kind = F.when(b.isNull(), "embedded_only").when(a.isNull(), "ocr_only").when(agree, "agree").otherwise("mismatch")
    return rows.withColumn("kind", kind).drop("_line", "_tokens")

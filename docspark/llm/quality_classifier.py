"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled good; all other text is unlabelled. The class prior is estimated from scores
that tell positives from unlabelled text: the least ratio of their upper tails. The classifier then minimises the
non-negative unbiased risk  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]).
Features are counts over the whole text; labels, language, source and id are none of them. Every document's features
are computed once; the model is fitted on a bounded sample of them.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tidy, whole_text, without

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_MARKS = ("#", "*", "$", "%", "&", "|", "<", ">", "!", "?", ".", ",", "@", "/", ":", "=", "_", "-", "{", ";", "(", "\n")
_SENTENCE = re.compile(r"[.!?]\s")


def features(text: str) -> list[float]:
    """Of one whole text; all zero but the constant for an empty one."""
    raw, words = text.encode(), text.split()
    chars, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    short = sum(1 for w in words if len(w) <= 3)
    share = lambda drop: 1 - len(raw.translate(None, drop)) / chars
    capital = len(raw) - len(raw.translate(None, _UPPER))
    marks = [np.log1p(100 * text.count(m) / n) for m in _MARKS]
    letters = share(_LETTERS) if raw else 0.0
    return [
        np.log1p(len(words)), min(30.0, len(raw) / n), short / n,
        np.log1p(100 * capital / chars), np.log1p(100 * (share(_DIGITS) if raw else 0.0)), letters,
        distinct / n, np.log1p(distinct) / np.log1p(n), np.log1p(n / max(1, len(lines))),
        sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(_SENTENCE.findall(text)))), *marks,
    ]


WIDTH = 12 + len(_MARKS)


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [features(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(pa.float32()))], ["id", "h", "x"])

    text = whole_text(text_col)
    return docs.select(id_col, F.xxhash64(text).alias("h"), text).mapInArrow(tidy(run), f"id {dict(docs.dtypes)[id_col]}, h long, x array<float>")


class Model:
    """Standardised features, their squares, and a logistic score."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def _adam(gradient, w, steps, rate=0.05):
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


_sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def class_prior(score_p: np.ndarray, score_u: np.ndarray, least_tail: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of the upper tails of both, over tails that hold at
    least ``least_tail`` of the positives, with a margin for the size of the samples."""
    p, u = np.sort(score_p), np.sort(score_u)
    cuts = np.quantile(p, np.linspace(0, 1 - least_tail, 200))
    tail = lambda s: 1 - np.searchsorted(s, cuts, "left") / len(s)
    tp, tu = tail(p), tail(u)
    ratio = (tu + np.sqrt(0.5 * np.log(20) / len(u))) / np.maximum(tp - np.sqrt(0.5 * np.log(20) / len(p)), 1e-3)
    best = int(np.argmin(ratio))
    return float(np.clip(tu[best] / max(tp[best], 1e-9), 0.02, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 400, decay: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> Model:
    """xp: features of trusted positives, xu: of unlabelled texts. Without either, a model that scores one half."""
    if not len(xp) or not len(xu):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH + 1), 0.5)
    both = np.vstack([xp, xu])
    model = Model(both.mean(0), both.std(0) + 1e-3, None, None)
    p, u = model.inputs(xp), model.inputs(xu)
    zero = np.zeros(p.shape[1])

    def apart(w):  # logistic regression of positives against unlabelled texts, on the even rows
        return -p[::2].T @ (1 - _sigmoid(p[::2] @ w)) / len(p[::2]) + u[::2].T @ _sigmoid(u[::2] @ w) / len(u[::2]) + decay * w

    w = _adam(apart, zero, steps // 2)
    half_p, half_u = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    model.prior = pi = class_prior(half_p @ w, half_u @ w)

    def risk(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        positive = -pi * p.T @ (1 - sp) / len(p)
        negative = u.T @ su / len(u) - pi * p.T @ sp / len(p)
        value = -np.log(np.maximum(1 - su, 1e-12)).mean() + pi * np.log(np.maximum(1 - sp, 1e-12)).mean()
        return (positive + negative if value >= -beta else -gamma * negative) + decay * w

    model.weights = _adam(risk, zero, steps)
    return model


def held_out(id_col: str) -> Column:
    """Rows whose labels may not be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, positives: int, unlabelled: int) -> DataFrame:
    """id, h (hash of the text), held_out, score."""
    x = materialise(feature_table(docs, id_col, text_col).withColumn("held_out", held_out("id")), "features")
    train = x.where(~F.col("held_out"))
    good = labels.where("quality = 1").select(F.col(id_col).alias("id")).distinct()

    def sample(rows, n):
        got = rows.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(n).toPandas()
        return np.stack(got["x"].to_numpy()).astype(float) if len(got) else np.empty((0, WIDTH))

    model = fit(sample(train.join(good, "id", "left_semi"), positives), sample(train, unlabelled))

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("held_out"), pa.array(model.score(flat.astype(float)))], ["id", "h", "held_out", "score"])

    return x.mapInArrow(tidy(run), f"id {dict(x.dtypes)['id']}, h long, held_out boolean, score double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          positives: int = 20_000, unlabelled: int = 20_000) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    labels has the id and ``quality``; only rows labelled 1 that are not held out are used. The model is fitted on at
    most ``positives`` labelled and ``unlabelled`` other rows, those with the smallest hashes of their ids. Null and
    empty texts are scored, too. Repeated rows are scored each; without positives or texts every score is one half.
    """
    rows = scored(docs, labels, id_col, text_col, positives, unlabelled)
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
              positives: int = 20_000, unlabelled: int = 20_000) -> DataFrame:
    """The rows of docs, with their columns, that score at least ``threshold``."""
    rows = scored(docs, labels, id_col, text_col, positives, unlabelled)
    return without(docs, rows.where(F.col("score") < threshold), id_col, text_col)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

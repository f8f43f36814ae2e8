"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, table, whole_text

#: Frequent function words of four languages.
STOP_WORDS = sorted({
    *"the of and to in a is that for it with as on be at by this are or from an was".split(),
    *"der die das und in von zu mit ist auf für ein eine den des dem nicht sich als".split(),
    *"le la les de des et un une en que est dans pour qui au du sur pas par".split(),
    *"de la que el en y los del las por con para una un no se es al su".split(),
})

#: rule, metric, least, most (None: no bound). A document is kept if every metric lies within its bounds.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("mean_word_length", "mean_word_chars", 2.0, 20.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.06, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
]

_SYMBOLS = "#*$%&|<>"
#: Word windows are sorted as (40 bits of a hash, 24 bits of place) in one long.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are hashed and sorted as plain longs; those
    whose hash has an equal neighbour are then compared as words, so the count is exact and takes n log n steps."""
    def gram(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    places = F.sequence(F.lit(0), (n - 3).cast("int"))
    packed = F.sort_array(F.transform(places, lambda i: F.shiftleft(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long"))))
    packed = F.when((n >= 3) & (n <= _PLACE), packed).otherwise(F.array().cast("array<bigint>"))

    def like_neighbour(a: Column) -> Column:
        same = lambda x, j: F.coalesce(F.shiftright(x, _PLACE_BITS) == F.shiftright(F.get(a, j), _PLACE_BITS), F.lit(False))
        return F.filter(a, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def verified(maybe: Column) -> Column:
        return F.array_sort(F.transform(maybe, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))

    def twice(a: Column) -> Column:
        same = lambda x, j: F.coalesce(x["g"] == F.get(a, j)["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(a, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    return places, packed, like_neighbour, verified, twice


def quality_metrics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct column of the metrics, and that column's name, which docs don't have. Null and empty texts have
    no words and zero counts. The struct hangs on the row's number, which isn't deterministic to Spark, so a filter on it
    is never moved below it, where every mention of a metric would be written out again."""
    own = fresh(docs, "metrics")
    t, w, k, packed_, m, v, at, lines, base = (f"{own}_{x}" for x in ("t", "w", "n", "p", "m", "v", "i", "l", "b"))
    n = F.col(k)
    df = docs.withColumn(t, whole_text(F.col(f"`{text_col}`")))
    df = df.withColumn(w, F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumn(k, F.size(w))
    _, packed, like_neighbour, verified, twice = _repeat_words(F.col(w), n)
    df = df.withColumn(packed_, packed)
    maybe = F.transform(like_neighbour(F.col(packed_)), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))
    every = F.when(n > _PLACE, F.sequence(F.lit(0), (n - 3).cast("int"))).otherwise(maybe)
    df = df.withColumn(m, every)
    df = df.withColumn(v, verified(F.col(m))).drop(packed_)
    df = df.withColumn(at, twice(F.col(v)))
    # a window covers its first word and the next two, but what the next repeated window starts is that one's
    covered = F.aggregate(
        F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col(at), j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    stop = F.size(F.filter(w, lambda x: x.isin(STOP_WORDS)))
    df = df.withColumn(base, F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"),
        stop.cast("long").alias("n_stop_words"),
    ))
    b, ratio = F.col(base), lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    df = df.withColumn(own, F.when(F.monotonically_increasing_id() >= 0, F.struct(
        f"{base}.*",
        ratio(b.word_chars, b.n_words).alias("mean_word_chars"),
        ratio(b.n_symbols, b.word_chars).alias("symbol_ratio"),
        ratio(b.n_stop_words, b.n_words).alias("stop_ratio"),
        ratio(b.n_dup_lines, b.n_lines).alias("dup_line_ratio"),
        ratio(b.n_repeat_words, b.n_words).alias("repeat_ratio"),
    )))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], own), own


def verdict(q: Column, thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    tests = [q[m] >= F.lit(lo) for _, m, lo, _ in thresholds if lo is not None]
    tests += [q[m] <= F.lit(hi) for _, m, _, hi in thresholds if hi is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per input row: id, n_words, the counts, base_failed, kept, and the ratios.

    Null and empty texts have zero words, fail the base and are not kept. Ids are passed through, null or repeated
    as they may be; other columns are not read. An empty table gives an empty result.
    """
    df, own = quality_metrics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    q = F.col(own)
    failed = (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)
    return df.select(
        F.col("_id").alias(id_col), *[q[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & verdict(q, thresholds)).alias("kept"),
        *[q[x].alias(x) for x in ("n_stop_words", "n_lines")],
    )


def keep_good(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs, with their columns, that the rules keep."""
    df, own = quality_metrics(docs, text_col)
    q = F.col(own)
    return df.where(verdict(q, thresholds) & ~(100 * q.n_repeat_words > 50 * q.n_words)).drop(own)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), f AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n >= 2
), c AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM f, (VALUES (0), (1), (2)) AS v(k)) GROUP BY r
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 20.0 AND n_symbols / word_chars <= 0.1
         AND n_stop_words / n_words >= 0.06 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept,
       n_stop_words, n_lines
FROM b
"""

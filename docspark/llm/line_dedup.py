"""Line deduplication by site-relative frequency.

A line that more than ``ratio`` of a site's pages contain, and at least ``min_pages`` of them, is boilerplate of that
site and is dropped from all its pages. Pages are counted once for each line and site; counts are combined within
partitions before they are shuffled, so a line that a third of all pages hold is one row per partition.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialise, table, tidy

_FLUSH = 200_000
_SPACES = re.compile(SPACE)


def line_key(site: str | None, line: str) -> bytes | None:
    """128 bits of the site and of the line with white space collapsed; None for a blank line."""
    line = _SPACES.sub(" ", line).strip(" ")
    return hashlib.blake2b(f"{site is None}\n{site or ''}\n{line}".encode(), digest_size=16).digest() if line else None


def _count(batches):
    counts: Counter[bytes] = Counter()
    sites: dict[bytes, str | None] = {}

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([sites[k] for k in counts], pa.string()), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["site", "key", "n"])

    for batch in batches:
        for site, text in zip(batch.column(0), batch.column(1)):
            site = site.as_py()
            for k in {line_key(site, x) for x in (text.as_py() or "").split("\n")} - {None}:
                counts[k] += 1
                sites[k] = site
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
                sites.clear()
    yield out()


def boilerplate(docs: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """site, key, n of the lines to drop."""
    site = F.col(f"`{site_col}`").cast("string")
    totals = docs.groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    # the site is part of the key, so it needs no place in the grouping; its total is looked up for candidates only
    lines = docs.select(site.alias("site"), F.col(f"`{text_col}`")).mapInArrow(tidy(_count), "site string, key binary, n long")
    lines = lines.groupBy("key").agg(F.sum("n").alias("n"), F.first("site").alias("site")).where(F.col("n") >= min_pages)
    lines = materialise(lines, "frequent-lines")
    return lines.join(totals, lines["site"].eqNullSafe(totals["site"])).where(F.col("n") > ratio * F.col("pages")).select(lines["site"], "key", "n")


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.02, min_pages: int = 5,
                     broadcast_bytes: int = 32 << 20, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")) -> DataFrame:
    """docs with its columns, the text without its boilerplate lines, and the long columns that ``counts`` names (of a
    text's lines and of those dropped; None: neither). It is an error if docs has columns of these names.

    Lines are compared with white space collapsed and trimmed; blank lines are never boilerplate. Null and empty texts
    stay as they are (null counts as a page without lines). A site may be of any type that Spark casts to a string; a null
    site is a site of its own. Row order, ids and other columns play no part, and repeated rows count as pages each. An
    empty table gives an empty result. The keys to drop are broadcast if they take at most ``broadcast_bytes`` in Python,
    as counted; beyond that they are joined, spread over salts.
    """
    spark, columns = docs.sparkSession, docs.columns
    if counts and set(counts) & set(columns):
        raise ValueError(f"docs has columns {counts}; name others by counts")
    names = list(counts or ())
    bad = materialise(boilerplate(docs, site_col, text_col, ratio, min_pages), "boilerplate")
    count = bad.count()
    if count * 128 <= broadcast_bytes:
        sent = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in bad.select("key").collect()))

        def clean(site, text, keys):
            return _clean(site, text, sent.value)

        own = fresh(docs, "bad")
        rows = docs.withColumn(own, F.lit(None).cast("array<binary>"))
    else:
        rows, own = _with_keys(docs, bad, site_col, text_col)

        def clean(site, text, keys):
            return _clean(site, text, frozenset(keys or ()))

    fields = {f.name: f for f in docs.schema.fields}
    at_text, width = columns.index(text_col), len(columns)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [clean(*x) for x in zip(part.column(width).to_pylist(), part.column(at_text).to_pylist(), part.column(width + 1).to_pylist())]
                arrays = [pa.array([x[0] for x in found], part.column(i).type) if i == at_text else part.column(i) for i in range(width)]
                arrays += [pa.array([x[j + 1] for x in found], pa.int64()) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *names])

    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in columns] + [f"`{c}` long" for c in names])
    site = F.col(f"`{site_col}`").cast("string").alias(fresh(docs, "site"))  # as counted: Spark's own way to write it
    return rows.select(*[F.col(f"`{c}`") for c in columns], site, own).mapInArrow(tidy(run), schema)


def _clean(site, text, keys):
    if not text:
        return text, 0, 0
    lines = text.split("\n")
    kept = [x for x in lines if line_key(site, x) not in keys]
    return ("\n".join(kept) if len(kept) < len(lines) else text), len(lines), len(lines) - len(kept)


def _with_keys(docs: DataFrame, bad: DataFrame, site_col: str, text_col: str, salts: int = 32) -> tuple[DataFrame, str]:
    """docs with the keys of its own lines that are to be dropped, by joins whose keys are spread over salts, and the name of
    that column. A page is known by site, text and one of ``salts`` numbers, so pages that repeat a text don't meet in one task."""
    def keys(batches):
        for batch in batches:
            rows = [(i, k) for i, (s, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                    for k in {line_key(s, x) for x in (t or "").split("\n")} - {None}]
            pick = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array([k for _, k in rows], pa.binary())], ["doc", "key"])

    doc, own = fresh(docs, "doc"), fresh(docs, "bad")
    site, text = F.col(f"`{site_col}`").cast("string"), F.col(f"`{text_col}`")
    number = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(salts)).cast("string")
    docs = docs.withColumn(doc, F.concat_ws(":", F.xxhash64(site, text), F.md5(F.coalesce(text, F.lit(""))), number))  # equal texts of a site lose equal lines
    lines = docs.select(doc, site, text).mapInArrow(tidy(keys), "doc string, key binary").distinct()
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    spread = bad.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    found = lines.join(spread, ["key", "salt"]).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("key").alias(own))
    return docs.join(found, doc, "left").drop(doc), own


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT r, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d WHERE text <> ''),
k AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key FROM x),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT k.source, key FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WHERE key <> ''
      GROUP BY k.source, key, pages HAVING count(DISTINCT r) >= 5 AND count(DISTINCT r) > 0.02 * pages),
m AS (SELECT k.*, b.key IS NOT NULL AS bad FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS text FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(t.text, '')) AS text_sha256
FROM d LEFT JOIN t USING (r)
"""

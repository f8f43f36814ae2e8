"""Exact duplicates by a tree-merge of sorted digest runs. DataFrame operations only.

Each input partition becomes a run: its rows' digests in order, one entry per text with the smallest id and the count. Runs
then merge in binomial rounds: a round takes ``steps`` steps of a binomial tree at once, so the 2^steps runs whose numbers
differ in as many low bits meet and are merged into one, slice by slice of the digest space: no task holds more than one
slice of 2^steps runs. A merge sorts what it gets, which comes as sorted runs, and reduces neighbours; every level is
written in that order. The root knows the smallest id of each text. Its answer goes down the same tree: an entry of a level
is joined with one entry of the level above, and an entry above has at most 2^steps partners. A text that a third of all
rows share is thus never one task's work on the way up or down.

Entries agree only if SHA-256, length in bytes and an independent 64-bit hash agree; this is verified at every level, since
all three are part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, table, whole_text

KEY = ["digest", "n_bytes", "witness"]


def sorted_run(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries of equal keys reduced to one, with the smallest id (a null one only if there is no other) and the count, in
    the order of the keys. A minimum of structs is not hashed by Spark: the entries are sorted and neighbours reduced."""
    return entries.groupBy(*by, *KEY).agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def merge(level: DataFrame, steps: int) -> DataFrame:
    """The runs of the next level: 2^steps runs become one."""
    near = level.withColumn("run", F.shiftright("run", steps)).withColumn("slice", F.substring("digest", 1, 2))
    near = near.repartition("run", "slice").sortWithinPartitions("run", "slice", *KEY)
    return sorted_run(near, ["run", "slice"]).drop("slice")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is replaced by one space; null counts as empty.
    Ties: the smallest id stays. Rows that repeat an id with the same text count in group_size, and all are
    marked kept, being the same document; a null id stays only where the whole group has none. An empty table
    gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    leaf = docs.select(F.col(id_col).alias("id"), F.regexp_replace(whole_text(text_col), SPACE, " ").alias("norm"))
    leaf = leaf.select(
        "id",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("witness"),
    )
    leaf = materialise(leaf, "digests")
    runs = (leaf.agg(F.max("run")).first()[0] or 0) + 1

    entries = leaf.withColumns({"keep": F.struct(F.col("id").isNull().alias("none"), "id"), "n": F.lit(1).cast("long")})
    levels = [materialise(sorted_run(entries, ["run"]), "runs0")]
    while runs > 1:
        runs = -(-runs >> steps)
        levels.append(materialise(merge(levels[-1], steps), f"runs{len(levels)}"))

    found = levels.pop()
    while levels:
        child = levels.pop().drop("keep", "n").withColumn("parent", F.shiftright("run", steps))
        found = child.join(found.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return leaf.join(found, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep.id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

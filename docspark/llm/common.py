"""What the operators share: reading tables, cutting lineage in the shared folder, words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that is unset, a folder of
    this machine will do only if everything runs on it, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "docspark-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's own switch to delete the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here, and lost
    executors cost no recomputation of what came before. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/docspark-{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._docspark_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes tables that materialise() made, once all that was made of them is itself written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._docspark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable, clear: Callable[[], object] | None = None) -> Callable:
    """run, for mapInArrow, which at the end of its task empties its caches by clear and returns freed memory to the
    system: Spark keeps Python workers for later tasks, so what they hold would add up over the stages of a job."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


def whole_text(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df starts with, in any case."""
    taken, found = [c.lower() for c in df.columns], f"__docspark_{name}"
    while any(c.startswith(found) for c in taken):
        found = "_" + found
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts_for(rows: int, each: int = 1 << 20, least: int = 64) -> int:
    """How many salts leave at most about ``each`` rows of one group in a task, though the group be all rows."""
    return max(least, -(-rows // each))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, most_bytes: int = 16 << 20) -> DataFrame:
    """docs, with its columns, without the rows that gone names by ``id`` and ``h``, the xxhash64 of the text. The list
    is broadcast only if its ids and hashes take at most ``most_bytes``, as summed up; else it is joined by a shuffle."""
    own_id, own_h = fresh(docs, "gone"), fresh(docs, "hash")
    gone = materialise(gone.select(F.col("id").alias(own_id), F.col("h").alias(own_h)).distinct(), "gone")
    taken = gone.agg(F.sum(F.coalesce(F.octet_length(F.col(own_id).cast("string")), F.lit(0)) + 32)).first()[0] or 0
    gone = F.broadcast(gone) if taken <= most_bytes else gone
    same = docs[id_col].eqNullSafe(gone[own_id]) & (F.xxhash64(whole_text(text_col)) == gone[own_h])
    return docs.join(gone, same, "left_anti")

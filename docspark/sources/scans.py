"""Where rows come from and go to."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """path, length, content of the files of a folder, not of its subfolders, whose names end with suffix in any case.
    Other files are not opened; for files that cannot be read see ``stage_rows``."""
    any_case = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", any_case)
    return found.option("ignoreCorruptFiles", "true").load(folder).select("path", "length", "content")


def requested(spark: SparkSession, paths: list[str]) -> DataFrame:
    """requested, path, length, content, error of each path asked for. A path that is missing, is a folder or cannot be
    read has an error and no content; no path raises. Only names are looked up on the driver, one for each path."""
    conf, rows = spark._jsc.hadoopConfiguration(), []
    for name in dict.fromkeys(paths):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            fs = path.getFileSystem(conf)
            status = fs.getFileStatus(path) if fs.exists(path) else None
            error = "file not found" if status is None else "is a directory" if status.isDirectory() else None
            rows.append((name, None if error else status.getPath().toString(), error))
        except Py4JJavaError as e:
            rows.append((name, None, f"cannot be looked up: {e.java_exception.getClass().getSimpleName()}"))
    asked = spark.createDataFrame(rows, "requested string, path string, error string")
    there = list(dict.fromkeys(path for _, path, error in rows if error is None))
    if not there:
        return asked.select("requested", "path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), "error")
    escaped = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", path) for path in there]  # Spark reads names as patterns
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(escaped).select("path", "length", "content")
    unread = F.when(F.col("error").isNull() & F.col("content").isNull(), "cannot be read")
    return asked.join(read, "path", "left").select("requested", "path", "length", "content", F.coalesce("error", unread).alias("error"))


def stage_rows(found: DataFrame, stages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files that stages can work on, and a failed row for each stage and each other path: stage, ok, tier, score, error."""
    failed = found.where(F.col("error").isNotNull()).select(
        "requested", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"), F.lit(False).alias("ok"), F.lit("inconclusive").alias("tier"), F.lit(None).cast("int").alias("score"), "error")
    return found.where(F.col("error").isNull()).drop("error"), failed


def sniff_html(c: str) -> Column:
    """Whether text starts as an HTML document does."""
    return F.lower(F.ltrim(F.substring(c, 1, 256))).rlike(r"^(<!doctype html|<html)")


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """Composed Unicode form; only for text that isn't ASCII."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Lines, tokens and tables from ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "session") -> DataFrame:
    """Numbers runs of rows: a row for which ``breaks`` holds starts a new run. breaks may use lag over the order."""
    w = W.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w)).drop("_new")


def last_before(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value of the rows before."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def header_fill(df: DataFrame, by: list[str], order: list, header: Column, name: str = "header") -> DataFrame:
    """Gives each row the number of headers up to it; 0 before the first."""
    return df.withColumn(name, F.sum(F.when(header, 1).otherwise(0)).over(W.partitionBy(*by).orderBy(*order)))


def cluster_lines(df: DataFrame, by: list[str], value: str, tie: str, tolerance: float, name: str = "line") -> DataFrame:
    """Running-mean clustering: sorted by descending value, a row joins the first cluster whose mean lies within the
    tolerance, and the mean moves. Each step depends on the last, so a page's rows are folded in one batch."""
    fields = df.schema.simpleString()[len("struct<") : -1]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` int"
    assert fields

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            page = page.sort_values([value, tie], ascending=[False, True], kind="stable").reset_index(drop=True)
            means: list[float] = []
            counts: list[int] = []
            found = []
            for v in page[value]:
                k = next((i for i, m in enumerate(means) if abs(v - m) <= tolerance), len(means))
                if k == len(means):
                    means.append(float(v))
                    counts.append(1)
                else:
                    counts[k] += 1
                    means[k] += (float(v) - means[k]) / counts[k]
                found.append(k)
            yield page.assign(**{name: pd.Series(found, dtype="int32")})

    return df.groupBy(*by).applyInPandas(lambda page: next(run(iter([page]))), schema)


_SALTS = 64


def assign_columns(cells: DataFrame, columns: DataFrame, by: list[str], at: str, center: str, role: str) -> DataFrame:
    """Nearest column: bands end half-way between neighbouring centers, the outer ones are open. columns is one row per
    column of a table, so it is turned into bands once and joined by table and range. Bands go to a number of salts, over
    which the cells of a table are dealt in turn, since few tables may have most cells."""
    w = W.partitionBy(*by).orderBy(center)
    bands = columns.select(*by, role, ((F.lag(center).over(w) + F.col(center)) / 2).alias("_lo"), ((F.lead(center).over(w) + F.col(center)) / 2).alias("_hi"))
    salts = max(_SALTS, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bands = bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    x = F.col(at)
    inside = (F.col("_lo").isNull() | (x >= F.col("_lo"))) & (F.col("_hi").isNull() | (x < F.col("_hi")))
    dealt = cells.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return dealt.join(bands, [*by, "_salt"]).where(inside).drop("_lo", "_hi", "_salt")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def union_box(df: DataFrame, by: list[str], box: tuple = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """The box around a group's boxes."""
    x0, y0, x1, y1 = box
    return df.groupBy(*by).agg(F.min(x0).alias(x0), F.min(y0).alias(y0), F.max(x1).alias(x1), F.max(y1).alias(y1))


def context_window(tokens: Column, reach: int = 3) -> Column:
    """For each token of a line, the tokens within ``reach`` places before and after it, joined by spaces."""
    size = F.size(tokens)
    near = lambda i: F.concat(F.slice(tokens, F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach))), F.slice(tokens, i + 2, F.lit(reach)))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(near(i), " "))


def row_cells(tokens: DataFrame, by: list[str], x: str, text: str, value: str) -> DataFrame:
    """by, text, value: tokens of a cell joined from left to right; the value is that of its only number."""
    return tokens.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(x, text))), lambda t: t[text]), " ").alias("text"),
        F.when(F.count(value) == 1, F.max(value)).alias("value"))


def reading_order(words: DataFrame, by: list[str], y: Column, x: Column, text: str, name: str = "text") -> DataFrame:
    """Words of a match from top to bottom, then from left to right."""
    parts = F.sort_array(F.collect_list(F.struct(y.alias("y"), x.alias("x"), F.col(text).alias("t"))))
    return words.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(name))


def inferred_table(pages: DataFrame, by: list[str], order: list, schema: str, name: str = "columns") -> DataFrame:
    """pages with the columns of their own header or, on a page without one, of the last page before that has one, and
    whether they are inferred."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumns({name: F.last(schema, ignorenulls=True).over(w), "inferred": F.col(schema).isNull()})

"""Versions of a document: pairs of neighbours, and what changed."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.text import PRIORITY, tokens

# Scores.
SCORES = {"amount": 95, "date": 95, "id_like": 85}
HIGH_PROSE, LOW_DEFAULT = 75, 15


def consecutive(versions: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Each version with its predecessor's text; first versions have none and are left out."""
    w = W.partitionBy(*by).orderBy(order)
    return versions.withColumn("before", F.lag(text).over(w)).withColumnRenamed(text, "after").where("before IS NOT NULL")


def _row_changes(before: Column, after: Column) -> Column:
    """array<struct<token, change>> of one pair: tokens, marked by side with white space, which no token holds, are
    sorted; runs of equal ones are counted, and the two sides of a token, now neighbours, are summed."""
    at = lambda a, i: F.get(a, i - 1)  # noqa: E731  (i from 1 on)
    once = lambda a, f: F.transform(F.array(a), f)[0]  # noqa: E731  (a is worked out once, not for each element)
    side = lambda c, mark: F.transform(F.coalesce(tokens(c), F.array().cast("array<string>")), lambda t: F.concat(t, F.lit(mark)))
    places = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    word = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)

    def runs(a: Column) -> Column:
        ends = F.filter(places(a), lambda i: ~at(a, i).eqNullSafe(F.get(a, i)))
        return once(ends, lambda e: F.transform(places(e), lambda j: F.struct(at(a, at(e, j)).alias("t"), (at(e, j) - F.coalesce(F.get(e, j - 2), F.lit(0))).alias("n"))))

    def summed(r: Column) -> Column:
        def change(j: Column) -> Column:
            own, then = at(r, j), F.get(r, j)
            less = own["t"].endswith("\n")
            both = ~less & F.coalesce(then["t"] == F.concat(word(own["t"]), F.lit("\n")), F.lit(False))
            taken = less & F.coalesce(F.get(r, j - 2)["t"] == F.concat(word(own["t"]), F.lit("\t")), F.lit(False))  # counted with its other side
            n = F.when(taken, 0).when(less, -own["n"]).when(both, own["n"] - then["n"]).otherwise(own["n"])
            return F.struct(word(own["t"]).alias("token"), n.cast("long").alias("change"))

        return F.filter(F.transform(places(r), change), lambda x: x["change"] != 0)

    return once(F.sort_array(F.concat(side(after, "\t"), side(before, "\n"))), lambda a: once(runs(a), summed))


def changed_tokens(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, token, change: how many more (or, negative, fewer) times a token occurs after than before.

    A pair alone under its keys is counted within its row, so a task holds texts, not a group for each of their tokens;
    only pairs that share their keys are summed by an aggregation.
    """
    known = pairs.select(*by, "before", "after", F.count(F.lit(1)).over(W.partitionBy(*by)).alias("_pairs"))
    own = lambda rows: rows.select(*by, F.inline(_row_changes(F.col("before"), F.col("after"))))
    shared = own(known.where("_pairs > 1")).groupBy(*by, "token").agg(F.sum("change").alias("change")).where("change <> 0")
    return own(known.where("_pairs = 1")).unionByName(shared)


def _edits(a: str | None, b: str | None) -> Iterator[tuple[str, str, str]]:
    """Token changes in order: replaced blocks paired one to one, the rest inserted or deleted."""
    x, y = (a or "").split(), (b or "").split()
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        for k in range(max(i2 - i1, j2 - j1)):
            old, new = (x[i1 + k] if i1 + k < i2 else ""), (y[j1 + k] if j1 + k < j2 else "")
            yield ("replace" if old and new else "delete" if old else "insert"), old, new


_EDITS = 4096  # changes that leave a Python worker at once


def sequence_changes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, op, old, new: a row for each token change of each pair. The pairs are dealt evenly, as the comparison takes
    longer than the move; a worker holds one batch of texts, one pair's tokens and at most _EDITS changes."""
    rows = pairs.select(*by, "before", "after").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*rows.schema.fields[: len(by)], *[T.StructField(c, T.StringType()) for c in ("op", "old", "new")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            edits: list[tuple[str, str, str]] = []

            def packed() -> pa.RecordBatch:
                keys = [column.take(pa.array(at, pa.int32())) for column in batch.columns[: len(by)]]
                return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, pa.string()) for c in zip(*edits)]], names=[*by, "op", "old", "new"])

            for i in range(batch.num_rows):
                for edit in _edits(batch.column(len(by))[i].as_py(), batch.column(len(by) + 1)[i].as_py()):
                    at.append(i)
                    edits.append(edit)
                    if len(edits) == _EDITS:
                        yield packed()
                        at, edits = [], []
            if edits:
                yield packed()

    return rows.mapInArrow(run, schema)


def join_pages(before: DataFrame, after: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """keys, page, text_before, text_after, changed: pages of two versions side by side; a page that one lacks is empty."""
    a, b = (x.select(*keys, page, F.col(text).alias(n), F.lit(True).alias(f"_{n}")) for x, n in ((before, "text_before"), (after, "text_after")))
    both = a.join(b, [*keys, page], "full_outer").withColumns({c: F.coalesce(c, F.lit("")) for c in ("text_before", "text_after")})
    return both.withColumns({"changed": F.col("text_before") != F.col("text_after"), "unpaired": F.col("_text_before").isNull() | F.col("_text_after").isNull()}).drop("_text_before", "_text_after")


def best_kind(changes: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """by, best: the kind of highest priority among a document's changes, null if none has one."""
    place = reduce(lambda w, p: w.when(F.col(kind) == p[0], p[1]), PRIORITY.items(), F)
    return changes.groupBy(*by).agg(F.min_by(kind, place).alias("best"))


_SPANS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]]))


@F.pandas_udf(_SPANS)
def char_spans(before: pd.Series, after: pd.Series) -> pd.Series:
    """How one token became another: spans of characters that stayed, were replaced, inserted or deleted."""
    return pd.Series([[dict(zip(("op", "a0", "a1", "b0", "b1"), s)) for s in difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes()] for a, b in zip(before, after)])

import difflib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.operators import guards, layout, objects, versions


def test_character_spans(spark):
    df = spark.createDataFrame([("1871.23", "18071.23"), (None, "a"), ("same", "same")], "a string, b string")
    for r in df.select("a", "b", versions.char_spans("a", "b").alias("s")).collect():
        assert [tuple(x) for x in r.s] == difflib.SequenceMatcher(None, r.a or "", r.b or "", autojunk=False).get_opcodes()


@pytest.mark.parametrize("n, kept", [(7, 1), (8, 9)])
def test_orphans_count_from_eight_on(spark, n, kept):
    words = spark.createDataFrame([(1, i, 100.0 * i) for i in range(n)] + [(1, 99, 5000.0)], "page int, word int, x double")
    boxes = spark.createDataFrame([(1, 5000.0)], "page int, box double")
    assert guards.without_graphics(words, boxes, ["page"], F.abs(F.col("x") - F.col("box")) < 1).count() == kept


def test_guards_keep_the_margin_and_unknown_confidence(spark):
    df = spark.createDataFrame([(-3.0, -1.0, None), (-5.0, -1.0, 0.5), (10.0, 12.0, 0.49)], "x0 double, x1 double, c double")
    at = guards.on_page(F.col("x0"), F.col("x0"), F.col("x1"), F.col("x1"), F.lit(100.0), F.lit(100.0))
    assert [(r[0], r[1]) for r in df.select(at, guards.confident(F.col("c"))).collect()] == [(True, True), (False, True), (True, False)]


def test_context_of_short_lines(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c", "d", "e"],)], "w array<string>")
    assert [r[0] for r in df.select(layout.context_window(F.col("w"))).collect()] == [[], [""], ["b c d", "a c d e", "a b d e", "a b c e", "b c d"]]


def test_page_without_known_number_meets_all_content(spark):
    texts = spark.createDataFrame([(1, 0)], "doc int, page int")
    changes = spark.createDataFrame([(1, "5 0", "content", None), (1, "6 0", "content", 1), (2, "7 0", "content", 3), (1, "8 0", "overlay", 2)], "doc int, object string, change string, page int")
    got = sorted((r.doc, r.kind, r.page, tuple(r.objects)) for r in objects.revision_findings(texts, changes, ["doc"]).collect())
    assert got == [(1, "overlay", 2, ("8 0",)), (1, "text", 0, ("5 0",)), (2, "content_without_text", 3, ("7 0",))]


def test_sequence_changes_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(versions, "_EDITS", 3)
    rows = [(1, 0, "a b c", "a x c d e f g"), (1, 1, "same", "same"), (2, 0, None, "n"), (2, 1, "p q r s t u v", ""), (2, 1, "k", "l")]
    df = spark.createDataFrame(rows, "conv int, turn int, before string, after string").coalesce(1)
    found = versions.sequence_changes(df, ["conv", "turn"])
    assert found.columns == ["conv", "turn", "op", "old", "new"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted([(1, 0, "replace", "b", "x"), *[(1, 0, "insert", "", t) for t in "defg"], (2, 0, "insert", "", "n"), *[(2, 1, "delete", t, "") for t in "pqrstuv"], (2, 1, "replace", "k", "l")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # no list of all changes of a batch, taken apart later


def test_changed_tokens_are_counted_in_their_row(spark):
    draw = random.Random(5)
    line = lambda: draw.choice([None, "", " ", *[" ".join(draw.choice(["a", "aa", "a\x08", "ab", "B", "\xe9", "\U0001d51e", "\xa0"]) for _ in range(draw.randrange(1, 12))) + draw.choice(["", "\n", "\t\x0b x"]) for _ in range(9)]])
    rows = [(i // 2 if i < 60 else i, draw.choice([1, None]), line(), line()) for i in range(200)]  # keys shared, keys of their own, null keys
    found = versions.changed_tokens(spark.createDataFrame(rows, "conv int, turn int, before string, after string"), ["conv", "turn"])
    want = Counter()
    for conv, turn, before, after in rows:
        for text, n in ((after, 1), (before, -1)):
            for t in filter(None, re.split("[ \t\n\x0b\f\r]+", text or "")):
                want[conv, turn, t] += n
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*k, n)) for k, n in want.items() if n)
    plan = found.where("change > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "(_pairs" in plan and "Union" in plan  # groups of tokens only where keys are shared


def test_cells_of_one_table_are_dealt(spark):
    cells = spark.range(4000).select(F.lit(1).alias("page"), F.col("id"), (F.col("id") % 40).cast("double").alias("x"))
    columns = spark.createDataFrame([(1, 10.0, "qty"), (1, 20.0, "rate"), (1, 32.0, "amount"), (2, 1.0, "none")], "page int, c double, role string")
    found = layout.assign_columns(cells, columns.hint("merge"), ["page"], "x", "c", "role")
    assert found.columns == ["page", "id", "x", "role"]
    assert {(r.x, r.role) for r in found.collect()} == {(float(x), "qty" if x < 15 else "rate" if x < 26 else "amount") for x in range(40)} and found.count() == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_parts = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(in_parts) > 1 and max(in_parts) < 3000

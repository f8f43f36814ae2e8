import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import quality_classifier as qc
from docspark.llm import quality_rules as qr
from tests.conftest import SF
from tests.llm.data import LONG, ROWS, awkward, empty, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}))


def test_rules_equal_brute_force(spark):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.quality_rules(awkward(spark)).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in ROWS)
    assert qr.quality_rules(empty(spark)).count() == 0


def test_rules_filter_keeps_columns(spark):
    df = awkward(spark).withColumns({c: F.lit("x") for c in ("_n", "_w", "_p", "_m", "_v", "_i", "_l", "_b", "_q", "_row", "__docspark_metrics")})
    got = qr.keep_good(df)
    assert got.columns == df.columns and got.count() == 0  # all short, or repeating themselves
    good = " ".join(f"the word{i} of" for i in range(40))
    assert qr.keep_good(spark.createDataFrame([(1, good), (2, "## ** || " + good[:50])], "doc_id long, text string")).count() == 1


def test_rules_filter_ends(spark):
    """A filter must not write the metrics out again for each mention."""
    df = qr.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(df.where("kept")._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert df.where("kept").count() == sum(r.kept for r in df.collect())


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = qc.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_classifier_awkward(spark):
    df = awkward(spark)
    got = qc.score(df, labels(spark))
    assert got.count() == df.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert qc.score(empty(spark), labels(spark)).count() == 0
    none = qc.score(df, labels(spark).limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert qc.keep_good(df, labels(spark).limit(0), threshold=0.6).count() == 0
    assert qc.keep_good(df, labels(spark).limit(0), threshold=0.4).columns == df.columns


def test_class_prior():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, 5000), np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert qc.class_prior(p, u) == pytest.approx(0.7, abs=0.08)


def test_long_text_is_read_whole():
    assert brute(LONG)[0] == 120_000 and qc.features(LONG)[0] == np.log1p(120_000)

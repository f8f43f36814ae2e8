import zlib

import public_tokenizers
from tokenizers import Tokenizer

from docspark.llm import line_dedup, ngram_join, quality_classifier, quality_rules
from tests.conftest import SF


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline as cp

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "ngram_join", "packing"]

    a = cp.STAGES[0][1](spark, docs, SF)
    good = {r.doc_id for r in quality_classifier.score(docs, labels).where("predicted = 1").collect()}
    assert a.columns == columns and {r.doc_id for r in a.collect()} == good
    b = cp.STAGES[1][1](spark, a, SF)
    kept = {r.doc_id for r in quality_rules.quality_rules(a).where("kept").collect()}
    assert b.columns == columns and {r.doc_id for r in b.collect()} == kept
    c = cp.STAGES[2][1](spark, b, SF)
    texts = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(b).collect()}
    assert c.columns == columns and {r.doc_id: r.text for r in c.collect()} == texts and all(r.n_chars == len(r.text) for r in c.collect())
    d = cp.STAGES[3][1](spark, c, SF)
    one = {r.doc_id for r in ngram_join.jaccard_components(c, n=5, percent=80).where("doc_id = component_id").collect()}
    assert d.columns == columns and {r.doc_id for r in d.collect()} == one

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(texts[i], add_special_tokens=False).ids, 0] for i in one}
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == one and sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        x = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, repeated ids, clashing names and no rows: every stage keeps the columns, and what it keeps is whole rows."""
    import corpus_pipeline as cp
    from tests.llm.data import awkward, empty, labels

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"the word{i} of" for i in range(40))
    more = spark.createDataFrame([(20, good, "en", "a", 9), (20, good + " end", "en", "a", 9), (21, good, "en", None, 9), (None, good + " a", "en", "a", 9)], empty(spark).schema)
    df = awkward(spark).unionByName(more, allowMissingColumns=True)
    rows = {(r.doc_id, r.text) for r in df.collect()}
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns and {(r.doc_id, r.text) for r in got.collect()} <= rows
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
    kept = cp.STAGES[1][1](spark, df, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {20, 21, None}
    left = cp.STAGES[3][1](spark, kept, str(tmp_path)).collect()
    assert len(left) == 2 and {r.doc_id for r in left} == {20, None}
    assert cp.STAGES[-1][1](spark, kept, str(tmp_path)).count() > 0 and cp.STAGES[-1][1](spark, empty(spark), str(tmp_path)).count() == 0

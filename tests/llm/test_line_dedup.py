import pytest

from docspark.llm import line_dedup
from tests.llm.data import awkward, empty


@pytest.mark.parametrize("room", [1 << 20, 0])  # keys broadcast, keys joined
def test_drops_what_a_site_repeats(spark, room):
    rows = [(i, f"own {i}\n  site   line \n\nmore {i}", "s") for i in range(20)] + [(100 + i, f"x {i}\nsite line", "t") for i in range(300)]
    rows += [(400 + i, f"y {i}", "t") for i in range(20_000 // 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, ratio=0.7, broadcast_bytes=room).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "own 3\n\nmore 3" and got[3]._n_dropped == 1
    assert got[100].text == "x 0\nsite line"  # 300 of 500 pages are not over 0.7


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_awkward(spark, room):
    df = awkward(spark)
    got = line_dedup.drop_boilerplate(df, ratio=0.1, min_pages=2, broadcast_bytes=room)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"] and got.count() == df.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (7, 10)}
    assert by[3].text is None and by[4].text == "" and by[5].text == " \n\t "
    assert by[1].text == "" and by[2].text is not None and by[9].text == "same\nsame\nsame"  # once in one page
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_sites_of_any_type_and_clashing_names(spark, room):
    df = spark.createDataFrame([(i, True, 1.5, f"own {i}\nsite line") for i in range(10)], "_n_lines long, flag boolean, rate double, text string")
    df = df.withColumn("__docspark_bad", df.text)
    for site in ("flag", "rate"):
        got = line_dedup.drop_boilerplate(df, site, ratio=0.5, broadcast_bytes=room, counts=None)
        assert got.columns == df.columns and sorted(r.text for r in got.collect()) == sorted(f"own {i}" for i in range(10))
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df, "flag")

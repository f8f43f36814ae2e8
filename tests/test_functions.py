import pytest
from pyspark.sql import functions as F

from docspark.functions import dates, fonts, geometry, numbers, provenance, text
from docspark.operators import fusion, layout, versions


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("1,00,000.00", 100000.0), ("12,32", 1232.0), ("12.5%", None), ("12.3.4", None), ("(1,200.00)", -1200.0), ("-Rs 50", -50.0), ("₹ 5", 5.0), ("", None), ("abc", None), (".5", 0.5),
])
def test_parse_amount(spark, given, want):
    assert one(spark, text.parse_amount(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("₹1,000", "amount"), ("Rs", "amount"), ("01/02/2024", "date"), ("2024-02-01", "date"), ("INV00123", "id_like"), ("a b", None)])
def test_kind(spark, given, want):
    assert one(spark, text.kind(F.lit(given))) == want


def test_text(spark):
    assert one(spark, text.normalize_label(F.lit("CGST @9%"))) == "cgst9"
    assert one(spark, text.normalize(F.lit(" a​b \t c "))) == "ab c"
    assert one(spark, text.fold(F.lit("Rn O0 lI"))) == one(spark, text.fold(F.lit("m 00 11")))
    assert one(spark, text.within_tolerance(F.lit("abc def"), F.lit("abc dxf"), F.lit("prose")))
    assert not one(spark, text.within_tolerance(F.lit("100"), F.lit("160"), F.lit("amount")))
    assert one(spark, text.displayed_decimals(F.lit("12.345"))) == 3
    assert one(spark, text.page_range(F.array(F.lit(0), F.lit(2)))) == "pages 1–3"
    assert one(spark, text.humanize(F.lit("line_item"))) == "Line item"


@pytest.mark.parametrize("given, want", [
    ("D:20240102030405+05'30'", "2024-01-01 21:34:05"), ("D:2024", "2024-01-01 00:00:00"), ("20240102030405Z", "2024-01-02 03:04:05"), ("D:20241302", None), ("x", None),
])
def test_pdf_date(spark, given, want):
    got = one(spark, dates.parse_pdf_date(F.lit(given)))
    assert (got and str(got)) == want


def test_numbers(spark):
    line = lambda e, s: (one(spark, numbers.within(F.lit(e), F.lit(s))), one(spark, numbers.gross(F.lit(e), F.lit(s))))
    assert line(249.69, 249.69) == (True, False) and line(249.69, 24019.69) == (False, True) and line(100.0, 101.0) == (False, False)
    band = lambda s: one(spark, numbers.in_rate_band(F.lit(2434.87), F.lit(0.08), F.lit(s), F.lit(2)))
    assert band(204.53) and not band(300.0)


def test_geometry(spark):
    box = lambda r: one(spark, geometry.canonical(*(F.lit(x) for x in (0.0, 0.0, 10.0, 20.0)), F.lit(100.0), F.lit(200.0), F.lit(r)))
    assert tuple(box(0)) == pytest.approx((0, 0.9, 0.1, 1)) and tuple(box(90)) == pytest.approx((0, 0, 0.1, 0.1)) and box(45) is None


def test_fonts(spark):
    a, b = F.lit("ABCDEF+Helvetica"), F.lit("GHIJKL+Helvetica")
    assert one(spark, fonts.subset_split(a, b)) and not one(spark, fonts.other_family(a, b))
    assert one(spark, fonts.family(F.lit("ArialMT,Bold"))) == "Arial" and one(spark, fonts.family(F.lit("Helvetica-BoldOblique"))) == "Helvetica"


def test_provenance(spark):
    assert one(spark, provenance.named_in(F.lit("Smallpdf Pro"), provenance.WEB_EDITORS)) == "smallpdf"
    assert one(spark, provenance.version_only(F.lit(" 4.3.2 (1.2)"))) and not one(spark, provenance.version_only(F.lit("Word 4.3")))


@pytest.mark.parametrize("results, want", [
    ([("a", "high", 92, True), ("provenance_metadata", "low", 0, True)], ("high", 92)),
    ([("a", "medium", 65, True), ("provenance_metadata", "medium", 55, True)], ("high", 85)),
    ([("a", "medium", 45, True), ("provenance_metadata", "medium", 55, True)], ("high", 70)),
    ([("a", "medium", 45, True), ("b", "medium", 50, True)], ("high", 70)),
    ([("a", "medium", 65, True)], ("medium", 65)),
    ([("a", "low", 10, True), ("provenance_metadata", "medium", 55, True)], ("low", 10)),
    ([("a", "inconclusive", None, True), ("provenance_metadata", "medium", 55, True)], ("low", 15)),
    ([("a", "inconclusive", None, True), ("provenance_metadata", "low", 25, True)], ("low", 25)),
    ([("a", "inconclusive", None, True)], ("inconclusive", None)),
    ([("a", "high", 92, False)], ("inconclusive", None)),
])
def test_fuse(spark, results, want):
    df = spark.createDataFrame([(1, *r) for r in results], "doc long, stage string, tier string, score int, ok boolean")
    assert fusion.fuse(df, "doc").select("tier", "score").first() == want


def test_project_allowed_refuses(spark):
    with pytest.raises(ValueError):
        fusion.project_allowed(spark.range(1).select(F.lit("x").alias("text")))


def test_sequence_changes(spark):
    df = spark.createDataFrame([("Rs 5,000 due", "Rs 50,000 due now")], "a string, b string")
    got = df.select(versions.sequence_changes("a", "b").alias("c")).first().c
    assert [tuple(x) for x in got] == [("replace", "5,000", "50,000"), ("insert", "", "now")]


def test_cluster_lines(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([100.0, 99.8, 80.0, 79.7, 99.9])], "page int, k int, y double")
    got = {r.k: r.line for r in layout.cluster_lines(df, ["page"], "y", "k", 0.5).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 2: 1, 3: 1}

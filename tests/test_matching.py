import numpy as np

from docspark.operators import matching
from docspark.plans.queries import QUERIES
from tests.conftest import SF

BOX = "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double"


def box(page, pos, text, x, width=10.0, y=0.0):
    return (page, pos, text, float(x), y, x + width, y + 10.0)


def test_passes():
    words, boxes = ([[x, 0, x + 10, 10] for x in xs] for xs in ((0, 20, 40, 60), (2, 26, 200)))
    assert matching.match_page(np.array(words, float), np.array(boxes, float)) == [0, -1, -1, -1]  # 4 / 16 is under 0.30
    assert matching.match_page(np.array([[0, 0, 10, 10], [1, 0, 11, 10]], float), np.array([[5.2, 0, 14.4, 10]], float)) == [-1, 0]
    assert matching.match_page(np.array([[0, 0, 10, 10], [0, 0, 10, 10]], float), np.array([[5.1, 0, 9.9, 10], [0, 0, 4.9, 10]], float)) == [1, 0]


def test_divergences(spark):
    words = [box(1, 0, "Total", 0), box(1, 1, "5,000.00", 12), box(2, 0, "5,000.00", 0), box(3, 0, "alpha", 0), box(3, 1, "gamma", 12), box(4, 0, "alone", 0)]
    boxes = [box(1, 0, "Total 5,000.00", 0, 30.0), box(2, 0, "6,000.00", 0), box(3, 0, "gamma alpha", 0, 30.0), box(5, 0, "2024-01-02", 0)]
    got = matching.classify(matching.match_words(spark.createDataFrame(words, BOX), spark.createDataFrame(boxes, BOX), ["page"])).collect()
    assert {r.page: (r.kind, r.cls) for r in got} == {
        1: ("agree", "amount"), 2: ("mismatch", "amount"), 3: ("agree", "prose"), 4: ("embedded_only", "prose"), 5: ("ocr_only", "date")}


def test_queries(spark):
    kinds = {r.kind for r in QUERIES["ocr_match"](spark, SF).select("kind").distinct().collect()}
    assert {"agree", "mismatch", "embedded_only"} <= kinds
    assert QUERIES["ocr_token_bag"](spark, SF).where("same_bag").count() > 0

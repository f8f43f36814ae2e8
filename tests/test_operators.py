import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import detectors, invoices, spatial
from docspark.sources import scans
from tests.test_bytes import PDF

def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(PDF)
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r.length for r in scans.files(spark, str(tmp_path)).collect()] == [len(PDF)]


@pytest.mark.parametrize("label, role", [("Unit Price", "rate"), ("Qty.", "qty"), ("CGST", "cgst"), ("Grand Total", "grand_total"), ("Total", "amount"), ("xyz", None)])
def test_roles(spark, label, role):
    assert spark.range(1).select(invoices.role_of(F.lit(label)).alias("r")).first().r == role


def test_logical_invoices(spark):
    columns = "doc_id long, page int, tables int, anchor string, title boolean, roles string, continued boolean, triples int, terminal boolean"
    full = "qty,rate,amount"
    df = spark.createDataFrame([
        (1, 0, 1, "INV-A", False, full, False, 3, True), (1, 1, 1, "INV-B", False, full, False, 3, True),  # a bundle
        (2, 0, 1, "INV-A", False, full, False, 3, False), (2, 1, 1, None, False, full, False, 3, True),  # the header repeated
        (3, 0, 1, "INV-A", False, full, False, 3, False), (3, 1, 1, None, False, None, True, 2, True),  # no header
        (4, 0, 1, "INV-A", False, full, False, 3, False), (4, 1, 1, None, True, None, False, 0, True),  # a title, no header
    ], columns)
    got = {(r.doc_id, r.page): (r.invoice, r.confidence) for r in invoices.logical_invoices(df).collect()}
    assert [got[1, p] for p in (0, 1)] == [(0, "high"), (1, "high")]
    assert [got[2, p] for p in (0, 1)] == [(0, "high"), (0, "high")]
    assert [got[3, p] for p in (0, 1)] == [(0, "medium"), (0, "medium")]
    assert [got[4, p] for p in (0, 1)] == [(0, "ambiguous"), (0, "ambiguous")]


def folded(pages):
    """Invoice and confidence of a document's pages in order, one after the other."""
    anchor = roles = None
    groups = []
    closed = True
    for tables, own, title, head, continued, triples, terminal in pages:
        if tables > 1:
            start, sure = True, 2
        elif not groups or (own and anchor and own != anchor):
            start, sure = True, 0
        elif own and own == anchor:
            start, sure = False, 0
        elif closed and (head or title):
            start, sure = True, 0
        elif head and head == roles:
            start, sure = False, 0
        else:
            start, sure = False, 1 if not head and (triples >= 2 or continued or tables == 0) and not title else 2
        if start:
            groups.append([])
            anchor = roles = None
        groups[-1].append(sure)
        anchor, roles, closed = anchor or own, head or roles, terminal
    return [(i, ("high", "medium", "ambiguous")[max(g)]) for i, g in enumerate(groups) for _ in g]


def test_logical_invoices_without_python(spark):
    draw = random.Random(7)
    documents = {d: [(draw.choice([0, 1, 1, 1, 1, 2]), draw.choice([None, None, "", "A", "B"]), draw.random() < 0.2, draw.choice([None, "", "x", "y"]), draw.random() < 0.3, draw.randrange(4), draw.random() < 0.4)
                     for _ in range(draw.randrange(1, 30))] for d in range(300)}
    rows = [(d, n, *p) for d, pages in documents.items() for n, p in enumerate(pages)]
    draw.shuffle(rows)
    found = invoices.logical_invoices(spark.createDataFrame(rows, "doc_id long, page int, tables int, anchor string, title boolean, roles string, continued boolean, triples int, terminal boolean"))
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # a Python group per document takes about a millisecond or more
    got = {(r.doc_id, r.page): (r.invoice, r.confidence) for r in found.collect()}
    assert got == {(d, n): x for d, pages in documents.items() for n, x in enumerate(folded(pages))}


def test_provenance_score(spark):
    df = spark.createDataFrame([
        (1, "Smallpdf", "Mozilla", None, None, None, None, None), (2, "Billing 1", None, "D:20240101", "D:20240102", None, None, None),
        (3, "Billing 1", None, "D:20240101", "D:20240101", None, "a", "a"), (4, *[None] * 7),
    ], "doc_id long, producer string, creator string, creation_date string, mod_date string, xmp_producer string, id_first string, id_second string")
    got = {r.doc_id: (r.tier, r.score) for r in detectors.provenance_score(df).collect()}
    assert got == {1: ("medium", 55), 2: ("low", 25), 3: ("low", 0), 4: ("inconclusive", None)}


def test_overlapping_pairs_come_once(spark):
    box = lambda s: spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (1, 10.0, 10.0, 95.0, 95.0)], f"page int, {s}_x0 double, {s}_y0 double, {s}_x1 double, {s}_y1 double")
    assert spatial.overlapping(box("a"), box("b"), ["page"], 16.0).count() == 4

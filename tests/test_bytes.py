import zlib

from docspark.sources import pdf_bytes, scans


def part(before: bytes, objects: bytes, trailer: bytes = b"") -> bytes:
    """before and an increment with a classic table, whose startxref names the table."""
    head = before + b"1 0 obj\n"
    return head + b"xref\n" + objects + b"trailer\n" + trailer + b"startxref\n%d\n%%%%EOF\n" % len(head)


ONE = part(b"%PDF-1.4\n", b"0 2\n0000000000 65535 f \n0000000009 00000 n \n")
PDF = part(ONE, b"2 1\n0000000100 00001 n \n", b"<< /Prev 17 >>\n")


def frame(spark, *rows):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "path string, content binary")


def test_revisions(spark):
    df = frame(spark, ("a", PDF), ("b", b"nothing"), ("c", None))
    got = pdf_bytes.revisions(df).orderBy("idx").collect()
    assert [(r.path, r.idx, r.valid, r.objects) for r in got] == [("a", 0, True, ["1 0"]), ("a", 1, True, ["2 1"])]
    assert got[1].end_off == len(PDF)
    assert [r.from_off for r in pdf_bytes.consecutive(pdf_bytes.revisions(df)).orderBy("idx").collect()] == [None, got[0].end_off]


def test_a_pointer_beside_the_table_writes_nothing():
    assert pdf_bytes.written(PDF, 0, len(ONE)) == [(1, 0)]
    assert pdf_bytes.written(ONE.replace(b"startxref\n17", b"startxref\n19"), 0, len(ONE)) == []
    assert pdf_bytes.written(PDF, len(ONE), len(PDF) + 1) == [] == pdf_bytes.written(PDF, 5, 5)


def xref_stream(predictor: int, before: bytes = b"%PDF-1.5\n") -> bytes:
    rows = [bytes((1, 0, 16, 0)), bytes((2, 0, 9, 3)), bytes((0, 0, 0, 255)), bytes((1, 1, 2, 2))]
    width, data, above = 4, b"", bytes(4)
    for row in rows:
        if predictor:
            left = bytes(1) + row[:-1]
            near = {10: bytes(4), 11: left, 12: above, 13: bytes((a + b) // 2 for a, b in zip(left, above))}[predictor]
            data += bytes((predictor - 10,)) + bytes((x - y) & 255 for x, y in zip(row, near))
        else:
            data += row
        above = row
    data = zlib.compress(data)
    parms = b"/DecodeParms << /Columns %d /Predictor %d >>" % (width, predictor) if predictor else b""
    head = b"7 0 obj\n<< /Type /XRef /W [1 2 1] /Index [3 2 10 2] /Size 12 /Filter /FlateDecode " + parms + b" /Length %d >>\nstream\r\n" % len(data)
    return before + head + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(before)


def test_cross_reference_streams():
    for predictor in (0, 10, 11, 12, 13):
        content = xref_stream(predictor)
        assert pdf_bytes.written(content, 0, len(content)) == [(3, 0), (4, 0), (7, 0), (11, 2)], predictor
    broken = xref_stream(0).replace(b"/FlateDecode", b"/LZWDecode")
    assert pdf_bytes.written(broken, 0, len(broken)) == []
    assert pdf_bytes.stream_records(b"\x01\x02", [0, 1], [5, 3]) == {(5, 0), (6, 0)}  # without a kind, in use
    assert pdf_bytes.stream_records(b"x", [0, 0], [0, 1]) == set() == pdf_bytes.stream_records(b"", [1], [0, 9])
    assert pdf_bytes._unpredicted(bytes((4, 5, 1, 4, 2, 250)), 2) == bytes((5, 6, 7, 1))  # Paeth


def test_boundaries(spark):
    fake = b"stream %%EOF\rstartxref\n1\n/Prev 3 /Prev 4\n"
    df = frame(spark, ("a", PDF), ("b", fake + b"%%EOF"), ("c", b"x"))
    got = {(r.path, r.idx): r for r in pdf_bytes.boundaries(pdf_bytes.scan(df)).collect()}
    assert {k: (r.valid, r.startxref, r.prev, r.from_off) for k, r in got.items()} == {
        ("a", 0): (True, "17", None, 0), ("a", 1): (True, str(len(ONE) + 8), "17", len(ONE)),
        ("b", 0): (False, None, None, 0), ("b", 1): (False, "1", "4", 13)}
    assert (got["a", 1].end_off, got["b", 0].end_off, got["b", 1].off) == (len(PDF), 13, len(fake))


def test_detected(spark):
    df = frame(spark, ("one", b" \n" + ONE), ("two", PDF), ("in", b"%PDF- %%EOF"), ("odd", b"x"), ("empty", b""), ("null", None))
    got = {r.path: (r.valid, r.invalid, len(r.notes), r.notes[0]) for r in pdf_bytes.detected(df, pdf_bytes.boundaries(pdf_bytes.scan(df))).collect()}
    assert got == {
        "one": (1, 0, 1, "one revision: this method alone is inconclusive"), "two": (2, 0, 1, "2 revisions before load tests"), "in": (0, 1, 2, "no end marker closes a revision"),
        "odd": (0, 0, 2, "no %PDF- header at the start"), "empty": (0, 0, 1, "empty file"), "null": (0, 0, 1, "empty file")}


def test_reconstructed(spark):
    locked = part(b"%PDF-1.4\n", b"0 2\n0000000000 65535 f \n0000000009 00000 n \n", b"<< /Encrypt 4 0 R >>\n")
    df = frame(spark, ("a", ONE + b"startxref\n3\n%%EOF\n" + part(PDF, b"5 1\n0000000100 00000 n \n")[len(ONE):].replace(b"%d" % (len(PDF) + 8), b"17")), ("b", locked), ("s", xref_stream(12)), ("x", b"x"))
    got = [(r.path, r.boundary, r.idx, (r.reason or "").split(":")[0]) for r in pdf_bytes.reconstructed(df, pdf_bytes.boundaries(pdf_bytes.scan(df))).orderBy("path", "boundary").collect()]
    assert got == [("a", 0, 0, ""), ("a", 1, None, "unloadable"), ("a", 2, None, "unloadable"), ("a", 3, 1, ""), ("b", 0, None, "encrypted"), ("s", 0, 0, "")]


def test_requested_paths_never_raise(spark, tmp_path):
    (tmp_path / "a [1], b.PDF").write_bytes(PDF)
    (tmp_path / "sub.pdf").mkdir()
    names = [str(tmp_path / n) for n in ("a [1], b.PDF", "none.pdf", "sub.pdf")]
    found = scans.requested(spark, names)
    good, failed = scans.stage_rows(found, ["fonts", "revisions"])
    assert [(r.requested, r.length, bytes(r.content)) for r in good.collect()] == [(names[0], len(PDF), PDF)]
    got = sorted((r.requested, r.stage, r.ok, r.tier, r.score, r.error) for r in failed.collect())
    assert got == [(n, s, False, "inconclusive", None, e) for n, e in ((names[1], "file not found"), (names[2], "is a directory")) for s in ("fonts", "revisions")]
    nothing, failed = scans.stage_rows(scans.requested(spark, names[1:2]), ["fonts"])
    assert nothing.count() == 0 and failed.count() == 1


ODD = [("a", PDF), ("b", b"startxref\n1\n%%EOF\r\n/Prev 3 /Prev 4 startxref startxref 7\n%%EOF%%EOF"), ("c", b"nothing"), ("d", None), ("e", b""), ("f", b"\n %PDF- /Prev %%EOF startxref\n99%%EOF\r"),
       ("g", ONE + b"startxref\n3\n%%EOF\n" + PDF[len(ONE):]), ("h", xref_stream(12)), ("i", xref_stream(0, PDF)), ("j", part(PDF, b"5 1\n0000000100 00000 n \n", b"<< /Encrypt 4 0 R >>\n") + b"%%EOF")]


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boundaries_in_one_pass(spark):
    df = frame(spark, *ODD)
    found = pdf_bytes.file_boundaries(df)
    assert plain(found) == plain(pdf_bytes.boundaries(pdf_bytes.scan(df))) and "Exchange" not in executed(found)


def test_detected_in_one_pass(spark):
    df = frame(spark, *ODD)
    found = pdf_bytes.detected(df)
    assert plain(found) == plain(pdf_bytes.detected(df, pdf_bytes.boundaries(pdf_bytes.scan(df)))) and "Exchange" not in executed(found)


def test_reconstructed_in_one_pass(spark):
    df = frame(spark, *ODD)
    found = pdf_bytes.reconstructed(df)
    assert plain(found) == plain(pdf_bytes.reconstructed(df, pdf_bytes.boundaries(pdf_bytes.scan(df)))) and "Exchange" not in executed(found)
    for _, content in ODD:
        for _, _, end, *_ in pdf_bytes._ends(content or b""):
            assert pdf_bytes.unloadable(content, end) == pdf_bytes.unloadable(content[:end])


def test_files_share_batches(spark, monkeypatch):
    monkeypatch.setattr(pdf_bytes, "_ROWS", 3)
    found = pdf_bytes.revisions(frame(spark, *[(str(i), PDF) for i in range(5)]).coalesce(1))
    assert [(r.path, r.idx, r.objects) for r in found.orderBy("path", "idx").collect()] == [(str(i), k, [o]) for i in range(5) for k, o in enumerate(("1 0", "2 1"))]
    assert "InPandas" not in executed(found)  # there each file made a table of its own

import base64
import hashlib
import struct
import uuid

import pytest
import zstandard

from docspark.llm import warc
from docspark.llm.common import shared_dir

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é\r\n\r\n" * 50_000),
         (6, "http://a/6\r\nWARC-Type: x", "<p>y</p>"), (None, "http://a/n", "<p>x</p>"), (7, "u", "<p>z</p>"), (7, "u", "<p>z</p>")]


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(df, folder, least_bytes=least, file_bytes=4_000)
    rows = warc.read_archives(spark, files, folder, with_payload=True).collect()
    assert len(rows) == len(PAGES) == files.agg({"n_records": "sum"}).first()[0]
    best = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(best.get(h or "", i), i)
    for i, u, h in PAGES:
        p = (h or "").encode()
        to = best.get(h or "")
        again = i is not None and to is not None and i < to
        r = next(r for r in rows if r.page_id == i)
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", to) if again else ("response", None))
        assert (bytes(r.payload) if not again else b"") == (p if not again else b"")


def test_dictionary_leads_and_records_stand_alone(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>page {i} of the archive</body></html>" * 20) for i in range(300)], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = warc.write_archives(df, folder).first().path.removeprefix("file://")
    content = open(path, "rb").read()
    magic, n = struct.unpack_from("<II", content)
    assert magic == warc.MAGIC and n > 0
    part = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n])).decompressobj()
    assert part.decompress(content[8 + n :]).startswith(b"WARC/1.1\r\n") and part.unused_data


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(df, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").count() == 0


def test_damaged_record():
    with pytest.raises(ValueError):
        warc.read_record(warc.make_record(1, "u", b"abc").replace(b"abc", b"abd"))


@pytest.mark.parametrize("pages", [[(5, "A"), (9, "A"), (5, "B")], [(5, "A"), (5, "C"), (9, "A"), (8, "C")]])
def test_repeated_id_with_other_payloads(spark, pages):
    df = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in pages], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.read_archives(spark, warc.write_archives(df, folder), folder, with_payload=True).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert sorted((r.page_id, r.payload_digest) for r in rows) == sorted((i, digest(h)) for i, h in pages)
    best = {h: max(i for i, x in pages if x == h) for _, h in pages}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h for _, h in pages}
    assert all(r.refers_to == (best[h] if best[h] != i else None) for i, h in pages for r in rows if (r.page_id, r.payload_digest) == (i, digest(h)))

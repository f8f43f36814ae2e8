"""Dictionary-compressed WARC archives: written, and read back.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from archived
records; each record then is a frame of its own, compressed with it. Records whose payload another record holds
are written as revisits of it. Files go to a folder that driver and executors share; each is written under a
temporary name and renamed when whole. Names hold the number of the task's attempt, and only files that a finished attempt
reports are read, so a lost executor or a late attempt leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, salts_for, shared_dir, table

MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own


# -- records ----------------------------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def make_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as in an uncompressed file. The HTTP head tells the payload's size in revisits, too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, payload size that the HTTP head tells, and payload (empty in revisits). Raises if it's not whole."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("record is not whole")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if headers["WARC-Type"] == "response" and (len(payload) != size or "sha1:" + payload_digest(payload) != headers["WARC-Payload-Digest"]):
        raise ValueError("payload differs from its digest")
    return headers, size, payload


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary trained on the records; of few or tiny records, or of equal ones, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def leading_frame(words: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(words)) + words


def records(content: bytes):
    """The records of an archive."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the file")
    words, at = content[8 : 8 + n], 8 + n
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        part = expand.decompressobj()
        out = part.decompress(view[at:])
        at = len(content) - len(part.unused_data)
        yield out


# -- files ------------------------------------------------------------------------------------------------------

def _write(folder: str, name: str, content: bytes) -> None:
    """Whole or not at all."""
    where, scratch = urlparse(folder), f".{name}.{uuid.uuid4().hex}"
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        with open(f"{where.path}/{scratch}", "wb") as f:
            f.write(content)
        os.replace(f"{where.path}/{scratch}", f"{where.path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{scratch}") as f:
            f.write(content)
        store.move(f"{path}/{scratch}", f"{path}/{name}")


def choose_responses(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page, digest, size and the id of the response, for pages that revisit another. Payloads are equal if SHA-256 and
    size agree. Groups are reduced within salts first and then joined salt by salt, so no task gets a whole group; there are
    the more salts the more rows there are."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page"), payload.alias("p"))
    rows = rows.select("page", F.unhex(F.sha2("p", 256)).alias("digest"), F.octet_length("p").alias("size"))
    rows = materialise(rows.where(F.col("size") >= least_bytes), "payloads")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts_for(rows.count()))))
    part = rows.groupBy("digest", "size", "salt").agg(F.max("page").alias("m"), F.count(F.lit(1)).alias("n"))
    part = materialise(part, "payload-parts")
    top = part.groupBy("digest", "size").agg(F.max("m").alias("response"), F.sum("n").alias("n")).where("n > 1").drop("n")
    part = part.select("digest", "size", "salt").join(top, ["digest", "size"])
    return rows.join(part, ["digest", "size", "salt"]).where("page < response").select("page", "digest", "size", "response")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, sample_records: int = 1_000, sample_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10,
                   file_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Writes pages as archives into folder and returns one row per file: path, n_records.

    Of pages with equal payloads of at least least_bytes bytes, the one with the largest id is the response and the
    others revisit it; pages whose id is null or repeated with the same payload are responses each. A repeated id may have
    several payloads, of which each is looked up by itself. A null html is an
    empty payload, a null url leaves the target out. The dictionary is built from about ``sample_records`` records, at most, of the
    whole table, taken by a hash of the row and each cut so that all take ``sample_bytes`` bytes; only how well records are
    compressed hangs on it. An empty table gives no files.
    """
    import zstandard

    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    start = p.select("page", "url", F.substring("payload", 1, sample_bytes // sample_records).alias("payload"))
    below = min((1 << 63) - 1, (sample_records << 64) // max(1, pages.count()) - (1 << 63))
    few = start.where(F.xxhash64("page", "url", "payload") <= below).limit(2 * sample_records).collect()  # the limit is for equal rows
    few = sorted(make_record(r.page, r.url, bytes(r.payload)) for r in few)[:sample_records]
    words = spark.sparkContext.broadcast(dictionary(few, dictionary_bytes) if few else b"")
    revisits = choose_responses(pages, id_col, html_col, least_bytes)
    revisits = materialise(revisits.distinct(), "revisits")
    p = p.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")}).join(revisits, ["page", "digest", "size"], "left")
    p = p.select("page", "url", "payload", "response")

    def write(batches):
        from pyspark import TaskContext

        context, lead = TaskContext.get(), leading_frame(words.value)
        task = f"{context.partitionId():06d}-{context.taskAttemptId():06d}"  # an attempt never writes over another's files
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words.value)) if words.value else zstandard.ZstdCompressor(level=level)
        out, n, names = io.BytesIO(), 0, []

        def done():
            name = f"part-{task}-{len(names):05d}.warc.zst"
            _write(folder, name, lead + out.getvalue())
            names.append((f"{folder}/{name}", n))

        for batch in batches:
            for page, url, payload, response in zip(*(batch.column(c) for c in ("page", "url", "payload", "response"))):
                response = response.as_py()
                record = make_record(page.as_py(), url.as_py(), payload.as_py(), response, response is not None)
                out.write(press.compress(record))
                n += 1
                if out.tell() >= file_bytes:
                    done()
                    out, n = io.BytesIO(), 0
        if n:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.int64())], ["path", "n_records"])

    return materialise(p.mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(spark: SparkSession, files: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """One row per record of the files that ``files`` names: page_id, payload_bytes, payload_digest, record_type,
    refers_to; with_payload adds url and payload (null in revisits). Every response is checked against its digest."""
    found = spark.read.format("binaryFile").load(folder + "/*.warc.zst").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    known = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    found = found.join(known, "name", "left_semi").select("content")
    number = id_type in ("bigint", "int", "smallint", "tinyint")
    kind = pa.int64() if number else pa.string()

    def page(x: str):
        x = x[len("<urn:page:") : -1]
        return None if x == "" else int(x) if number else x

    def read(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.binary()]
        width = 7 if with_payload else 5
        for batch in batches:
            for content in batch.column(0):
                cols = [[] for _ in range(width)]

                def out():
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:width])

                for record in records(content.as_py()):
                    h, size, payload = read_record(record)
                    old = h["WARC-Type"] == "revisit"
                    row = (page(h["WARC-Record-ID"]), size, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"],
                           page(h["WARC-Refers-To"]) if old else None, h.get("WARC-Target-URI"), None if old else payload)
                    for c, v in zip(cols, row):
                        c.append(v)
                    if len(cols[0]) >= 2_000:
                        yield out()
                        cols = [[] for _ in range(width)]
                yield out()

    schema = "page_id {0}, payload_bytes long, payload_digest string, record_type string, refers_to {0}".format("long" if number else "string")
    return found.mapInArrow(read, schema + ", url string, payload binary" * with_payload)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/docspark-warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder)
    if not files.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, files, folder)

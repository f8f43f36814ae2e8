"""Revisions of a file from its bytes: end markers, pointers, the objects that an increment writes, load tests."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the scan looks for: how marks begin, and marks.
_NAMES = (b"%%EOF", b"startxref", b"/Prev")
_MARK = re.compile(rb"(?P<eof>%%EOF)(?:\r\n|\r|\n)?|(?P<start>startxref)\s+(\d+)|(?P<prev>/Prev)\s+(\d+)")
_TAIL = re.compile(rb"startxref\s+(\d+)\s*\Z")
_WINDOW = 128  # bytes before an end marker in which its startxref must lie
_START, _STREAM = re.compile(rb"startxref\s+(\d+)"), re.compile(rb"/XRefStm\s+(\d+)")
_XREF = re.compile(rb"[ \t]*xref\b[ \t]*(?:\r\n|\r|\n)?")
_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_SECTION = re.compile(rb"(\d+)[ \t]+(\d+)\Z")
_ENTRY = re.compile(rb"(\d{10})[ \t]+(\d{5})[ \t]+([nf])")
_OBJECT = re.compile(rb"[ \t\r\n]*(\d+)[ \t]+(\d+)[ \t]+obj\b")
_BODY = re.compile(rb"\bstream\r?\n")


# -- cross-reference sections -------------------------------------------------------------------------------------

def classic_table(content: bytes, at: int, end: int | None = None) -> set[tuple[int, int]]:
    """Number and generation of the objects in use of the table at an offset, up to its trailer or what is no header."""
    found: set[tuple[int, int]] = set()
    end = len(content) if end is None else end
    head = _XREF.match(content, at, end)
    if not head:
        return found
    at, left = head.end(), 0  # left: entries that the last header still announces
    while at < end:
        line = _LINE.match(content, at, end)
        at, line = line.end(), line[0].strip()
        if b"trailer" in line:
            break
        if left:
            if (e := _ENTRY.match(line)) and e[3] == b"n":
                found.add((number, int(e[2])))
            number, left = number + 1, left - 1
        elif line:
            if not (h := _SECTION.match(line)):
                break
            number, left = int(h[1]), int(h[2])
    return found


def _entry(head: bytes, name: bytes) -> list[int] | None:
    m = re.search(rb"/" + name + rb"\s*(?:\[([\d\s]*)\]|(\d+))", head)
    return [int(x) for x in (m[1] if m[1] is not None else m[2]).split()] if m else None


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows of PNG filters, one byte a sample, undone."""
    out, above = bytearray(), bytearray(width)
    for lo in range(0, len(data) - width, width + 1):
        kind, row = data[lo], bytearray(data[lo + 1 : lo + 1 + width])
        for i in range(width):
            a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + near) & 255
        out += row
        above = row
    return bytes(out)


def stream_records(data: bytes, widths: list[int], index: list[int]) -> set[tuple[int, int]]:
    """Objects of a decoded cross-reference stream: records in use, and those within object streams as generation 0."""
    found, at, size = set(), 0, sum(widths)
    if size <= 0:
        return found
    for first, n in zip(index[::2], index[1::2]):
        for number in range(first, first + n):
            record = data[at : at + size]
            if len(record) < size:
                return found
            at, place, field = at + size, 0, []
            for w in widths:
                field.append(int.from_bytes(record[place : place + w], "big") if w else None)
                place += w
            kind = 1 if field[0] is None else field[0]
            if kind in (1, 2):
                found.add((number, (field[2] or 0) if kind == 1 and len(field) > 2 else 0))
    return found


def stream_section(content: bytes, at: int, end: int) -> set[tuple[int, int]]:
    """Objects of the cross-reference stream whose object starts at an offset, itself included; none if it is malformed,
    is filtered by anything but Flate, or is no such stream."""
    head = _OBJECT.match(content, at, end)
    body = head and _BODY.search(content, head.end(), end)
    if not body:
        return set()
    entries = content[head.end() : body.start()]
    widths, size = _entry(entries, b"W"), _entry(entries, b"Size") or [0]
    index = _entry(entries, b"Index") or [0, size[0]]
    if not widths or not re.search(rb"/Type\s*/XRef\b", entries):
        return set()
    stop = content.find(b"endstream", body.end(), end)
    data = content[body.end() : stop if stop >= 0 else end]
    records, columns = sum(index[1::2]), (_entry(entries, b"Columns") or [1])[0]
    predicted = (_entry(entries, b"Predictor") or [1])[0] >= 10
    most = min(records, 1 << 24) * (sum(widths) + 1) + 1  # what its records can take
    if filters := re.search(rb"/Filter\s*\[?\s*/(\w+)", entries):
        if filters[1] != b"FlateDecode":
            return set()
        try:
            data = zlib.decompressobj().decompress(data, max(1, most))
        except zlib.error:
            return set()
    if predicted:
        data = _unpredicted(data, columns)
    return stream_records(data, widths, index) | {(int(head[1]), int(head[2]))}


def section(content: bytes, at: int, end: int) -> set[tuple[int, int]]:
    return classic_table(content, at, end) if _XREF.match(content, at, end) else stream_section(content, at, end)


def _found(content: bytes, name: bytes, pattern: re.Pattern, start: int, end: int) -> Iterator[re.Match]:
    """Matches of a pattern that begins with a name, the last one first."""
    at = content.rfind(name, start, end)
    while at >= 0:
        if m := pattern.match(content, at, end):
            yield m
        at = content.rfind(name, start, at)


def written(content: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """Number and generation of the objects that the increment of bytes [start, end) writes: those of the section that
    its last startxref names and of the stream that its last /XRefStm names, each if it lies in the increment."""
    found = set()
    if 0 <= start < end <= len(content):
        for name, pattern in ((b"startxref", _START), (b"/XRefStm", _STREAM)):
            m = next(_found(content, name, pattern, start, end), None)
            at = int(m[1]) if m else -1
            if start <= at < end:
                found |= section(content, at, end)
    return sorted(found)


# -- boundaries ---------------------------------------------------------------------------------------------------

def marks(content: bytes) -> Iterator[tuple[str, int, int, int | None, bool | None]]:
    """Kind (eof, start or prev), offset, end, pointer and, of an end marker, whether a startxref ends right before it."""
    last, at = 0, []
    for name in _NAMES:  # none can begin within another mark, so each is looked for by itself
        i = content.find(name)
        while i >= 0:
            at.append(i)
            i = content.find(name, i + len(name))
    for i in sorted(at):
        if not (m := _MARK.match(content, i)):
            continue
        if m["eof"]:
            tail = content[max(last, m.start() - _WINDOW) : m.start()]
            yield "eof", m.start(), m.end(), None, bool(_TAIL.search(tail))
            last = m.end()
        else:
            yield ("start", m.start(), m.end(), int(m[3]), None) if m["start"] else ("prev", m.start(), m.end(), int(m[5]), None)


def _ends(content: bytes) -> Iterator[tuple[int, int, int, int, str | None, str | None, bool]]:
    """Number, offset, end, end of the one before, last startxref and last /Prev since then, and whether it is valid, of
    each end marker of a file."""
    idx, last, pointers = 0, 0, {}
    for kind, off, end, pointer, clean in marks(content):
        if kind == "eof":
            yield idx, off, end, last, pointers.get("start"), pointers.get("prev"), clean
            idx, last, pointers = idx + 1, end, {}
        else:
            pointers[kind] = str(pointer)


_ROWS = 4096  # rows that leave a Python worker at once


def _each(files: DataFrame, rows_of: Callable[[bytes | None], Iterator[tuple]], schema: str, more: str | None = None) -> DataFrame:
    """path and the rows of each file, as schema has them. Rows leave in batches of many files: a batch for a file would
    take longer than most files. rows_of takes the content and, where named, the column more."""
    names = [c.split()[0] for c in schema.split(", ")]
    taken = files.select("path", "content", *([more] if more else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = [pa.string(), *types]
        for batch in batches:
            rows: list[tuple] = []

            def packed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), to)], names=["path", *names])

            for i in range(batch.num_rows):
                path, *given = (column[i].as_py() for column in batch.columns)
                for row in rows_of(*given):
                    rows.append((path, *row))
                    if len(rows) == _ROWS:
                        yield packed()
                        rows = []
            if rows:
                yield packed()

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [arrow[c.split()[1]] for c in schema.split(", ")]
    return taken.mapInArrow(run, "path string, " + schema)


def scan(files: DataFrame) -> DataFrame:
    """path, kind, off, end_off, pointer, clean: a row for each mark. files: path, content. Pointers are texts of digits."""
    def rows(content: bytes | None) -> Iterator[tuple]:
        return ((k, a, b, None if p is None else str(p), c) for k, a, b, p, c in marks(content or b""))

    return _each(files, rows, "kind string, off long, end_off long, pointer string, clean boolean")


def file_boundaries(files: DataFrame) -> DataFrame:
    """The rows of ``boundaries`` from the files themselves: a file's marks are in one task, so nothing is dealt or
    sorted. files: path, content."""
    return _each(files, lambda content: _ends(content or b""), "idx int, off long, end_off long, from_off long, startxref string, prev string, valid boolean")


def boundaries(found: DataFrame) -> DataFrame:
    """path, idx, off, end_off, from_off, startxref, prev, valid: a row per end marker, with the last startxref and the
    last /Prev since the one before. found: rows of ``scan``."""
    before = W.partitionBy("path").orderBy("off").rowsBetween(W.unboundedPreceding, -1)
    own = found.withColumn("idx", F.coalesce(F.sum(F.when(F.col("kind") == "eof", 1).otherwise(0)).over(before), F.lit(0)).cast("int"))
    eof = F.col("kind") == "eof"
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("pointer")), F.when(F.col("kind") == kind, F.col("off")))
    rows = own.groupBy("path", "idx").agg(
        *[F.max(F.when(eof, F.col(c))).alias(c) for c in ("off", "end_off")], last("start").alias("startxref"), last("prev").alias("prev"), F.bool_or(F.when(eof, F.col("clean"))).alias("valid"))
    rows = rows.where(F.col("off").isNotNull())
    return rows.withColumn("from_off", F.coalesce(F.lag("end_off").over(W.partitionBy("path").orderBy("idx")), F.lit(0).cast("long")))


_HEAD = re.compile(rb"[ \t\n\x0b\f\r]*%PDF-")


def detected(files: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """path, size, valid, invalid, notes: one row per file, also for those that are empty or have no end marker. Without
    bounds they are those of the files, counted as the bytes are read."""
    def counts(content: bytes | None) -> Iterator[tuple]:
        content = content or b""
        ends = [clean for kind, _, _, _, clean in marks(content) if kind == "eof"]
        yield len(content), bool(_HEAD.match(content)), sum(ends), len(ends) - sum(ends)

    if bounds is None:
        heads = _each(files, counts, "size int, headed boolean, valid long, invalid long")
    else:
        n = bounds.groupBy("path").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
        head = F.ltrim(F.decode("content", "ISO-8859-1"), F.lit(" \t\n\x0b\f\r"))
        heads = files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.coalesce(F.substring(head, 1, 5) == "%PDF-", F.lit(False)).alias("headed")).join(n, "path", "left")
    v, i, full = F.coalesce("valid", F.lit(0)), F.coalesce("invalid", F.lit(0)), F.col("size") > 0

    def note(when: Column, *text: str | Column) -> Column:
        return F.when(when, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]))

    notes = F.array_compact(F.array(
        note(~full, "empty file"), note(full & ~F.col("headed"), "no %PDF- header at the start"), note(full & (v + i == 0), "no end marker, so no revisions"),
        note((v == 0) & (i > 0), "no end marker closes a revision"), note(v == 1, "one revision: this method alone is inconclusive"),
        note(v > 1, v, " revisions before load tests"), note(i > 0, i, " end markers inside streams")))
    return heads.select("path", "size", v.alias("valid"), i.alias("invalid"), notes.alias("notes"))


def revisions(files: DataFrame) -> DataFrame:
    """path, idx, off, end_off, valid, objects: one row per end marker; objects are those written since the last one.
    files: path, content. A file's bytes are read once, in its own task."""
    def rows(content: bytes | None) -> Iterator[tuple]:
        content = content or b""
        for idx, off, end, last, _, _, clean in _ends(content):
            yield idx, off, end, clean, [f"{o} {g}" for o, g in written(content, last, end)]

    return _each(files, rows, "idx int, off long, end_off long, valid boolean, objects array<string>")


def consecutive(found: DataFrame) -> DataFrame:
    """Valid revisions with the end of the one before."""
    return found.where("valid").withColumn("from_off", F.lag("end_off").over(W.partitionBy("path").orderBy("idx")))


# -- load tests ---------------------------------------------------------------------------------------------------

def unloadable(content: bytes, end: int | None = None, start: int | None = None) -> str | None:
    """Why a file cut at an end marker (at end, else as it is) cannot be loaded, by its structure: its last startxref
    must name a section with objects, and it must not be encrypted. It isn't parsed further, nor repaired as a viewer
    would try. start: what the last startxref names, if that is known."""
    end = len(content) if end is None else end
    if start is None:
        m = next(_found(content, b"startxref", _START, 0, end), None)
        start = int(m[1]) if m else None
    if start is None or start >= end:
        return "unloadable: no section at the last startxref"
    if not section(content, start, end):
        return "unloadable: the section at the last startxref has no objects"
    classic = _XREF.match(content, start, end)
    trailer = content.find(b"trailer", start, end) if classic else start
    stop = content.find(b"startxref", trailer, end) if classic else (m.start() if (m := _BODY.search(content, trailer, end)) else -1)
    return "encrypted: a password is needed" if trailer >= 0 and content.find(b"/Encrypt", trailer, stop if stop >= 0 else end) >= 0 else None


def reconstructed(files: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """path, boundary, truncate_len, reason, idx: each valid boundary, tested on the bytes up to it. Those that load
    (no reason) are numbered anew from 0; those that don't are kept with their reason and no number. bounds: path, idx,
    end_off, valid; a file's boundaries travel as one short list, so its bytes move once. Without bounds they are those
    of the files, and the bytes do not move."""
    schema = "boundary int, truncate_len long, reason string, idx int"

    def tested(content: bytes, cuts: Iterator[tuple[int, int]]) -> Iterator[tuple]:
        named = [(m.end(), int(m[1])) for m in _found(content, b"startxref", _START, 0, len(content))][::-1]
        ends, good = [e for e, _ in named], 0
        for boundary, end in cuts:
            k = bisect_right(ends, end)
            reason = unloadable(content, end, named[k - 1][1] if k else end)
            yield boundary, end, reason, None if reason else good
            good += not reason

    if bounds is None:
        return _each(files, lambda content: tested(content or b"", ((e[0], e[2]) for e in _ends(content or b"") if e[6])), schema)
    cuts = bounds.where("valid").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "end_off"))).alias("cuts"))
    return _each(files.select("path", "content").join(cuts, "path"), lambda content, cuts: tested(content, ((c["idx"], c["end_off"]) for c in cuts)), schema, "cuts")

"""Packing into fixed windows by deficit round-robin over source queues.

Every source is a queue of its documents, cut into chunks of at most ``seq_len`` tokens. In round r each source's
credit grows by its quantum q (its share of the mixture times ``window`` tokens) and it sends the chunks that its
credit covers; what is left of the credit, the deficit, is carried to the next round. While a queue has chunks the
deficit is never lost, so a chunk whose queue has c tokens up to its end leaves in round ceil(c / q): the schedule
needs two prefix sums, not a loop, and the deficits carry over partitions as over rounds. Rounds, and in them
sources, and in them queue order, make one stream, which is cut every ``seq_len`` tokens; only the last sequence
can be short. Sources keep to the target within one chunk in every round, until their queue is empty.

Ids are written once. The schedule reads only counts: partition totals for each source, and totals for each round
and source; no step gathers a source or the rounds in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_encode import byte_chars
from .common import materialise, table, tidy

#: Distinct chunks of text whose ids a worker keeps; beyond that it starts anew.
_CACHE = 400_000
#: Rounds whose totals are summed together before the prefix sum over such blocks.
_ROUNDS = 64
_WIDE_SPACE = re.compile(r"\s ")


class _Pieces(dict):
    """Number of each distinct piece of text, in order of its first use."""

    def __init__(self, start: str, encode):
        self.start, self.encode, self.new = start, encode, []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.encode(self.start + piece)
        return n


class ByteBpe:
    """A tokenizer file of the kind byte-level BPE, without normaliser; encodes as the tokenizers library does."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, back = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_chars())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of the merges")
        self.bpe = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.flat, self.starts = array("I"), array("q", [0])
        self.first, self.later = _Pieces("", self._new), _Pieces(" ", self._new)

    def _new(self, text: str) -> int:
        self.flat.extend(self.bpe.encode_ordinary(text))
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens. A token never spans the place before a single space, so texts in
        which no white space stands before a space are encoded piece by piece, each distinct piece once."""
        if not text or _WIDE_SPACE.search(text):
            return np.array(self.bpe.encode_ordinary(text), np.uint32)
        if len(self.starts) > _CACHE:
            self._reset()
        pieces = text.split(" ")
        codes = [self.first[pieces[0]], *map(self.later.__getitem__, pieces[1:])]
        codes = np.array(codes, np.int64)
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.empty(0, np.uint32)
        at = starts[codes]
        n = starts[codes + 1] - at
        before = np.cumsum(n) - n
        return flat[np.repeat(at - before, n) + np.arange(n.sum())]

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return self.plain(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.plain(p) for p in self.split_special(text)])


#: How byte-level BPE of this kind splits text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_tokenizers: dict[str, ByteBpe] = {}


def _tokenizer(vocabulary: str) -> ByteBpe:
    """One for each worker process."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = ByteBpe(vocabulary)
    return _tokenizers[vocabulary]


def _clear() -> None:
    for bpe in _tokenizers.values():
        bpe._reset()


def tokenise(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str, seq_len: int, end_id: int) -> DataFrame:
    """Chunks of ids: part, n (place in its part), id, source, start, length, doc_tokens, before (tokens of the source
    in earlier chunks of the part), ids (little-endian, two bytes where the vocabulary allows)."""
    fields = [("part", pa.int32()), ("n", pa.int64()), ("id", None), ("source", pa.string()), ("start", pa.int64()),
              ("length", pa.int32()), ("doc_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())]

    def run(batches):
        from pyspark import TaskContext

        bpe, part, n, sent = _tokenizer(vocabulary), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                cols, origin = [[] for _ in fields], []
                for k, (source, text) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())):
                    ids = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), seq_len):
                        x = ids[start : start + seq_len]
                        before = sent.get(source, 0)
                        sent[source] = before + len(x)
                        for c, v in zip(cols, (part, n, None, source, start, len(x), len(ids), before, x.astype("<u2").tobytes() if small else x.tobytes())):
                            c.append(v)
                        origin.append(k)
                        n += 1
                arrays = [rows.column(0).take(pa.array(origin, pa.int64())) if kind is None else pa.array(c, kind) for c, (_, kind) in zip(cols, fields)]
                yield pa.RecordBatch.from_arrays(arrays, [f for f, _ in fields])

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    small = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), end_id]) < 1 << 16
    kind = dict(docs.dtypes)[id_col]
    schema = f"part int, n long, id {kind}, source string, start long, length int, doc_tokens long, before long, ids binary"
    rows = docs.select(F.col(id_col), F.col(source_col).cast("string"), F.col(text_col)).mapInArrow(tidy(run, _clear), schema)
    return rows.withColumn("wide", F.lit(not small))


def schedule(chunks: DataFrame, window: int, shares: dict[str, float] | None) -> DataFrame:
    """part, n and at, the place of each chunk in the stream. chunks: part, n, source, length, before."""
    by_part = chunks.groupBy("source", "part").agg(F.sum("length").alias("t"))
    same = W.partitionBy("source")
    queue = by_part.select(
        "source", "part",
        (F.sum("t").over(same.orderBy("part")) - F.col("t")).alias("earlier"), F.sum("t").over(same).alias("total"),
    )
    if shares is None:
        grand = chunks.agg(F.sum("length")).first()[0] or 1
        quantum = F.col("total") * (window / grand)
    else:
        whole = sum(shares.values())
        least = min(shares.values()) / whole  # sources without a target get the least
        quantum = F.coalesce(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v / whole)])[F.col("source")], F.lit(least)) * window
    queue = queue.withColumn("quantum", F.greatest(F.lit(1.0), quantum)).drop("total")
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    c = chunks.select("part", "n", "source", "length", "before").alias("c")
    q = queue.alias("q")
    placed = c.join(q, null_safe(chunks, queue) & (F.col("c.part") == F.col("q.part"))).select(
        "c.part", "c.n", "c.source", "length", (F.col("earlier") + F.col("before")).alias("cum"), "quantum")
    placed = placed.withColumn("round", F.ceil((F.col("cum") + F.col("length")) / F.col("quantum")).cast("long"))

    turns = placed.groupBy("round", "source").agg(F.sum("length").alias("t"), F.min("cum").alias("first"))
    turns = turns.withColumn("block", F.floor(F.col("round") / _ROUNDS))
    turns = materialise(turns, "turns")
    blocks = turns.groupBy("block").agg(F.sum("t").alias("bt"))
    blocks = blocks.select("block", (F.sum("bt").over(W.orderBy("block")) - F.col("bt")).alias("base"))
    inside = F.sum("t").over(W.partitionBy("block").orderBy("round", "source")) - F.col("t")
    turns = turns.withColumn("inside", inside).join(blocks, "block").select(
        F.col("round").alias("r"), F.col("source").alias("s"), (F.col("base") + F.col("inside") - F.col("first")).alias("shift"))
    return placed.join(turns, (F.col("round") == F.col("r")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "part", "n", (F.col("cum") + F.col("shift")).alias("at"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seq_len: int = 1024, window_sequences: int = 64, end_id: int = 0, shares: dict[str, float] | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source; with_ids adds ids.

    shares are the target proportions (default: those of the tokens there are). A null text counts as empty and
    becomes the end id alone; a null source is a source of its own; rows that repeat an id are packed each for
    itself. An empty table gives an empty result.
    """
    chunks = materialise(tokenise(docs, vocabulary, id_col, text_col, source_col, seq_len, end_id), "chunks")
    placed = schedule(chunks, seq_len * window_sequences, shares)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        for batch in batches:
            out, origin = [[] for _ in range(7)], []
            cols = [batch.column(x).to_pylist() for x in ("start", "at", "doc_tokens", "ids", "wide")]
            for k, (start, at, total, ids, wide) in enumerate(zip(*cols)):
                ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                lo = 0
                while lo < len(ids):
                    sequence, offset = divmod(at + lo, seq_len)
                    hi = min(len(ids), lo + seq_len - offset)
                    x = ids[lo:hi]
                    for c, v in zip(out, (start + lo, hi - lo, zlib.crc32(x.tobytes()), total, sequence, offset, x.astype(np.int32) if with_ids else None)):
                        c.append(v)
                    origin.append(k)
                    lo = hi
            pick = pa.array(origin, pa.int64())
            arrays = [batch.column("id").take(pick), batch.column("source").take(pick), *(pa.array(c, pa.int64()) for c in out[:6])]
            if with_ids:
                arrays.append(pa.array(out[6], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = chunks.select("part", "n", "id", "source", "start", "doc_tokens", "ids", "wide").join(placed, ["part", "n"])
    return rows.drop("part", "n").mapInArrow(tidy(cut), schema).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

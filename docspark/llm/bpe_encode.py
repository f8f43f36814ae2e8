"""Exact BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (those with more than a 1/``lexicon_words`` share of all words, so at most ``lexicon_words`` of them)
are counted over every text, encoded once and compiled into a minimal acyclic automaton: equal suffixes share
states, and each transition carries how many words sort before it, so the sum along a path is the word's number
and the key to its ids. The compiled bytes are broadcast, written once per worker process to a file and mapped
into memory. Words that the automaton doesn't accept are merged exactly, by rank.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters that Python's split() takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Entries that a worker keeps of words met; beyond that it starts anew.
_CACHE = 600_000
#: Widths in bytes of the arrays in which pieces are merged; longer pieces are merged one by one.
_WIDTHS = (8, 12, 16, 24, 40)
_FAR = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind BPE with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.chars = byte_chars()

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank is merged until none has a rank."""
        parts = [self.chars[b] for b in piece.encode()]
        parts[-1] += self.end
        ranks, far = self.ranks, 1 << 60
        while len(parts) > 1:
            order = [ranks.get(p, far) for p in zip(parts, parts[1:])]
            least = min(order)
            if least == far:
                break
            out, i, n = [], 0, len(parts)
            while i < n:
                if i < n - 1 and order[i] == least:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocab[p] for p in parts]

    def word(self, lowered: str) -> list[int]:
        return [i for p in self.pieces(lowered) for i in self.merge(p)]


class Merger:
    """Merges many pieces at once, a row each: in a round every row merges its leftmost pair of lowest rank."""

    def __init__(self, bpe: WordBpe):
        self.bpe, n = bpe, len(bpe.vocab)
        keys = np.array([bpe.vocab[a] * n + bpe.vocab[b] for a, b in bpe.ranks], np.int64)
        self.n, order = n, np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.made = np.array([bpe.vocab[a + b] for a, b in bpe.ranks], np.int32)
        self.inner = np.array([bpe.vocab[c] for c in bpe.chars], np.int32)
        self.last = np.array([bpe.vocab[c + bpe.end] for c in bpe.chars], np.int32)

    def _ranks(self, a, b):
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _FAR)

    def merge(self, pieces: set[str]) -> dict[str, list[int]]:
        out, by_width = {}, {}
        for p in pieces:
            b = p.encode()
            by_width.setdefault(next((w for w in _WIDTHS if len(b) <= w), 0), []).append((p, b))
        for width, rows in by_width.items():
            if not width:
                out.update((p, self.bpe.merge(p)) for p, _ in rows)
                continue
            for lo in range(0, len(rows), 16_384):
                part = rows[lo : lo + 16_384]
                out.update(zip((p for p, _ in part), self._merge([b for _, b in part], width)))
        return out

    def _merge(self, rows: list[bytes], width: int) -> list[list[int]]:
        n = np.array([len(b) for b in rows])
        raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in rows), np.uint8).reshape(-1, width)
        sym = np.where(np.arange(width) < n[:, None], self.inner[raw], -1)
        sym[np.arange(len(rows)), n - 1] = self.last[raw[np.arange(len(rows)), n - 1]]
        rank = np.full_like(sym, _FAR)
        rank[:, :-1] = self._ranks(sym[:, :-1], sym[:, 1:])
        places, live = np.arange(width), np.arange(len(rows))
        while len(live):
            s, r = sym[live], rank[live]
            at = r.argmin(axis=1)
            least = r[np.arange(len(live)), at]
            if (least == _FAR).any():
                on = least < _FAR
                live, s, r, at, least = live[on], s[on], r[on], at[on], least[on]
                if not len(live):
                    break
            row = np.arange(len(live))
            take = np.minimum(places + (places > at[:, None]), width - 1)
            s, r = np.take_along_axis(s, take, 1), np.take_along_axis(r, take, 1)
            s[:, -1], r[:, -1] = -1, _FAR
            s[row, at] = self.made[least]
            r[row, at] = self._ranks(s[row, at], s[row, np.minimum(at + 1, width - 1)])
            r[row[at == width - 1], -1] = _FAR
            left = at > 0
            r[row[left], at[left] - 1] = self._ranks(s[row[left], at[left] - 1], s[row[left], at[left]])
            sym[live], rank[live] = s, r
        return [x[x >= 0].tolist() for x in sym]


def lower(word: str) -> str:
    """Character by character: no final sigma."""
    return word.replace("Σ", "σ").lower()


def words_of(text: str) -> list[str]:
    """White-space separated words in composed form, their case kept."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if any(c in text for c in _ODD):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The automaton as bytes: counts, then for each state the start of its transitions, for each transition its
    target and how many words sort before it, final flags, the words' places in the id list, the ids, the labels."""
    items = sorted((w.encode(), ids) for w, ids in words.items())
    register: dict[tuple, int] = {}
    made: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_: list[list] = [[False, []]]  # the path of the last word: final, [label, child] with the last child open
    last = b""

    def close(depth: int) -> None:
        while len(open_) > depth:
            final, edges = open_.pop()
            key = (final, tuple(map(tuple, edges)))
            if key not in register:
                register[key] = len(made)
                made.append(key)
            if open_:
                open_[-1][1][-1][1] = register[key]

    for word, _ in items:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same + 1)
        for b in word[same:]:
            open_[-1][1].append([b, -1])
            open_.append([False, []])
        open_[-1][0] = True
        last = word
    close(0)
    paths = []
    for final, edges in made:  # children come before parents
        paths.append(final + sum(paths[t] for _, t in edges))
    starts, targets, skips, labels = [0], [], [], bytearray()
    for final, edges in made:
        before = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += paths[target]
        starts.append(len(targets))
    at, ids = [0], []
    for _, x in items:
        ids += x
        at.append(len(ids))
    head = [len(made), len(targets), len(items), len(ids)]
    numbers = [*head, *starts, *targets, *skips, *(int(f) for f, _ in made), *at, *ids]
    return struct.pack(f"<{len(numbers)}I", *numbers) + bytes(labels)


class Lexicon:
    """A compiled automaton, mapped from a file."""

    def __init__(self, blob: bytes):
        self._file = tempfile.NamedTemporaryFile(prefix="docspark-lexicon-")
        self._file.write(blob)
        self._file.flush()
        self.mapped = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids = struct.unpack_from("<4I", self.mapped)
        view, parts, at = memoryview(self.mapped), [], 4
        for n in (states + 1, edges, edges, states, words + 1, ids):
            parts.append(view[4 * at : 4 * (at + n)].cast("I"))
            at += n
        self.starts, self.targets, self.skips, self.final, self.at, self.ids = parts
        self.base, self.root = 4 * at, states - 1

    def find(self, word: str) -> list[int] | None:
        state, number, base = self.root, 0, self.base
        for b in word.encode():
            k = self.mapped.find(bytes((b,)), base + self.starts[state], base + self.starts[state + 1]) - base
            if k < 0:
                return None
            number += self.skips[k]
            state = self.targets[k]
        return list(self.ids[self.at[number] : self.at[number + 1]]) if self.final[state] else None


class Encoder:
    """Of words as they stand in texts: their ids as text, and their tokens as text."""

    def __init__(self, path: str, blob: bytes):
        self.bpe, self.lexicon = WordBpe(path), Lexicon(blob)
        self.merger = Merger(self.bpe)
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Looks the words up in the lexicon; those it doesn't hold are merged together."""
        new = words - self.ids.keys()
        if len(new) + len(self.ids) > _CACHE:
            self.ids.clear()
            self.tokens.clear()
            new = words
        unseen, token = {}, self.bpe.token
        for word in new:
            ids = self.lexicon.find(lowered := lower(word))
            if ids is None:
                unseen[word] = self.bpe.pieces(lowered)
            else:
                self.ids[word], self.tokens[word] = " ".join(map(str, ids)), " ".join(map(token.__getitem__, ids))
        merged = self.merger.merge({p for pieces in unseen.values() for p in pieces})
        for word, pieces in unseen.items():
            ids = [i for p in pieces for i in merged[p]]
            self.ids[word], self.tokens[word] = " ".join(map(str, ids)), " ".join(map(token.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[str, list[str]]]:
        """A text as special tokens (or "") and the words that follow each."""
        if "<|" not in text:
            return [("", words_of(text))]
        out = [("", [])]
        for part in self.bpe.split_special(text):
            if part in self.bpe.special:
                out.append((part, []))
            else:
                out[-1][1].extend(words_of(part))
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids and decoded text of each whole text."""
        split = [self.parts(t) for t in texts]
        self.learn({w for parts in split for _, words in parts for w in words})
        out = []
        for parts in split:
            ids, tokens = [], []
            for special, words in parts:
                if special:
                    ids.append(str(self.bpe.special[special]))
                    tokens.append(special)
                if words:
                    ids.append(" ".join(map(self.ids.__getitem__, words)))
                    tokens.append(" ".join(map(self.tokens.__getitem__, words)))
            text = " ".join(ids)
            out.append((text.count(" ") + 1 if text else 0, text, " ".join(tokens)))
        return out


def count_words(batches):
    """Partial counts of lower-cased words, of a bounded number of words at a time."""
    counts: Counter[str] = Counter()

    def out():
        lowered: Counter[str] = Counter()
        for w, n in counts.items():
            lowered[lower(w)] += n
        return pa.RecordBatch.from_arrays([pa.array(lowered.keys(), pa.string()), pa.array(lowered.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                counts.update(words_of(text.as_py()))
            if len(counts) > _CACHE:
                yield out()
                counts.clear()
    yield out()


def frequent_words(docs: DataFrame, text_col: str, lexicon_words: int) -> list[str]:
    """Words with more than a 1/lexicon_words share of all words: fewer than lexicon_words of them, whatever the corpus."""
    from .common import materialise

    counts = docs.select(text_col).mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("n > 1"), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.word for r in counts.where(F.col("n") * lexicon_words > total).select("word").collect()]


_encoders: dict[tuple[str, str], Encoder] = {}


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 lexicon_words: int = 65_536, full: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; with full, also ids and decoded (text).

    Special tokens that stand in a text become their ids, as the tokenizers library does it; a null text counts as
    empty and has no tokens. Ids are passed through, null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    bpe = WordBpe(vocabulary)
    blob = compile_lexicon({w: bpe.word(w) for w in frequent_words(docs, text_col, lexicon_words) if w})
    key, sent = (vocabulary, hashlib.sha256(blob).hexdigest()), spark.sparkContext.broadcast(blob)

    def encode(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(vocabulary, sent.value)
        encoder, sha = _encoders[key], lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, cols = batch.slice(lo, 512), ([], [], [], [], [])
                for n, ids, decoded in encoder.encode([x or "" for x in part.column(1).to_pylist()]):
                    row = (n, sha(ids), sha(decoded), ids, decoded) if full else (n, sha(ids), sha(decoded))
                    for c, x in zip(cols, row):
                        c.append(x)
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if full else 3]
                kinds = [pa.int64(), *[pa.string()] * 4]
                arrays = [pa.array(c, k) for c, k, _ in zip(cols, kinds, names)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [id_col, *names])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * full
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

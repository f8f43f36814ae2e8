"""Scores by a hierarchical Pitman-Yor language model, trained here by Gibbs sampling.

There is a restaurant for each context: every word of the training texts, and the start of a text. Its dishes are all
words and the end of a text. All context restaurants share one parent, whose base is uniform over the training words,
the end and one unseen word; a context that training texts don't have backs off to the parent. Customers are seated
from the counts of the whole training corpus; every sweep seats the customers of all cells (context, word) anew given
the rest (Chinese restaurant process; from the 17th customer of a dish on in blocks of a sixteenth of those seated), and
the seatings after the first sweeps are averaged. A cell of one customer has one table in every sweep.

Cells are gathered from all texts by partial counts and a shuffle, and dealt by hash to parts, as are words to owners;
both are packed, sorted lists. A part is seated at once and asks the owners of its words for their sums. Draws hang on the
cell and the sweep alone, so parts don't change them. Cells that make up more than a 1/``lexicon`` share of all tokens,
fewer than ``lexicon`` of them, are broadcast with their scores; tokens of the others are looked up in their part, none of
which can be frequent. Words are told apart by 64 bits of a hash, and so are cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table, tidy, whole_text

#: Bytes of text that are split into words at once; one text may be longer.
_PART = 1 << 20

#: Tokens whose cells are summed up before they are dealt.
_TOKENS = 1_500_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def held_out(id_col: str) -> Column:
    """Texts that the model doesn't learn from; a null id counts as one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(True))


# -- counts -----------------------------------------------------------------------------------------------------

#: The end of a text and, as a context, its start: no word has white space.
END = word_hash(b" ")


#: Longer words are hashed one by one.
_LONG = 256

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def cells_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and place of the text, for all tokens and ends of the texts. A word's hash mixes in its length and
    then its bytes, eight at a time."""
    raw = b" ".join([*texts, b""]).lower()
    data = np.frombuffer(raw + bytes(8), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    space = _SPACE[data[: len(raw)]]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # the starts of words and, as a space ends every text, theirs ends
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), data, strides=(1,))
    with np.errstate(over="ignore"):
        h = _mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, at = np.flatnonzero(size <= _LONG), 0
        while len(live):
            left = np.minimum(size[live] - at, 8).astype(np.uint64)
            x = eight[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            h[live] = _mix((h[live] ^ x) + np.uint64(0x9E3779B97F4A7C15))
            at += 8
            live = live[size[live] > at]
    for i in np.flatnonzero(size > _LONG):
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]]))
    before = np.searchsorted(start, ends)  # words up to the end of each text
    w = np.full(len(start) + len(ends), END)
    inside = np.ones(len(w), bool)
    inside[before + np.arange(len(ends))] = False
    w[inside] = h.view(np.int64)
    return np.concatenate([[END], w[:-1]]), w, np.repeat(np.arange(len(texts)), np.diff(before, prepend=0) + 1)


def parts(batch: pa.RecordBatch, column: int):
    """The batch in parts of at most ``_PART`` bytes of text, or of one text."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, _PART + (ends[lo - 1] if lo else 0), "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def cell_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u.view(np.uint64)
    return ((x << np.uint64(1)) | (x >> np.uint64(63))).view(np.int64) ^ w


def _cell_key(u: Column, w: Column) -> Column:
    return F.shiftleft(u, 1).bitwiseXOR(F.shiftrightunsigned(u, 63)).bitwiseXOR(w)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of eight-byte numbers, byte by byte of the numbers, compressed: most of them are small or nearly sorted."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    raw = b"".join(a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype == np.float64 for a in arrays)], np.int64)
    return head.tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, real = np.frombuffer(blob, np.int64, 2 * count, 8).reshape(2, count)
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8 * (2 * count + 1) :], 8 * int(sizes.sum()), asbytes=True), np.uint8)
    ends = 8 * np.concatenate([[0], np.cumsum(sizes)])
    return [np.ascontiguousarray(raw[lo:hi].reshape(8, -1).T).reshape(-1).view(np.float64 if f else np.int64) for lo, hi, f in zip(ends, ends[1:], real)]


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))  # wraps around, as the sum of steps does


def owner(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def dealt(of: np.ndarray, parts: int):
    """Each part that has rows, and the places of its rows in their order."""
    order = np.argsort(of.astype(np.uint16) if parts <= 1 << 16 else of, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=parts))])
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), order[ends[p] : ends[p + 1]]


class Cells:
    """Distinct cells, by context and word: places of both in a sorted list of words, and counts of training and other texts."""

    def __init__(self, words: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, other: np.ndarray):
        self.words, self.u, self.w, self.n, self.other = words, u, w, n, other

    @staticmethod
    def summed(words: np.ndarray, code: np.ndarray, n: np.ndarray, other: np.ndarray) -> Cells:
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        n, other = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, other))
        return Cells(words, code[first] // len(words) if len(first) else code, code[first] % len(words) if len(first) else code, n, other)

    @staticmethod
    def of_tokens(w: np.ndarray, held: np.ndarray) -> Cells:
        words, at = np.unique(w, return_inverse=True)
        code = np.concatenate([[np.searchsorted(words, END)], at[:-1]]) * len(words) + at
        code, count = np.unique(code * 2 + held, return_counts=True)
        return Cells.summed(words, code >> 1, np.where(code & 1, 0, count), np.where(code & 1, count, 0))

    @staticmethod
    def merged(blobs: list[bytes]) -> Cells:
        found = [Cells.read(b) for b in blobs]
        words = np.unique(np.concatenate([x.words for x in found]))
        places = [np.searchsorted(words, x.words) for x in found]
        code = np.concatenate([at[x.u] * len(words) + at[x.w] for x, at in zip(found, places)])
        return Cells.summed(words, code, np.concatenate([x.n for x in found]), np.concatenate([x.other for x in found]))

    @staticmethod
    def read(blob: bytes) -> Cells:
        words, u, w, n, other = unpack(blob)[:5]
        return Cells(np.cumsum(words), np.cumsum(u), w, n, other)

    def key(self) -> np.ndarray:
        return cell_key(self.words[self.u], self.words[self.w])

    def blob(self) -> bytes:
        return pack(steps(self.words), steps(self.u), self.w, self.n, self.other)

    def take(self, at: np.ndarray) -> Cells:
        has = np.zeros(len(self.words), bool)
        has[self.u[at]] = has[self.w[at]] = True
        place = np.cumsum(has) - 1
        return Cells(self.words[has], place[self.u[at]], place[self.w[at]], self.n[at], self.other[at])


def flushes(batches, text: int):
    """Parts of the batches until they have ``_TOKENS`` tokens: the parts, their tokens and ends, and each one's row."""
    held = []
    for batch in batches:
        for part in parts(batch, text):
            held.append((part, *cells_of(part.column(text).to_pylist())[1:]))
            if sum(len(x[1]) for x in held) >= _TOKENS:
                yield _together(held)
                held = []
    if held:
        yield _together(held)


def _together(held: list) -> tuple[list, np.ndarray, np.ndarray]:
    rows = np.cumsum([0, *(x[0].num_rows for x in held)])
    return [x[0] for x in held], np.concatenate([x[1] for x in held]), np.concatenate([x[2] + r for x, r in zip(held, rows)])


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def _blobs(found: list, names=("p", "blob"), types=(pa.int64(), pa.binary())) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], list(names))


def by(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """run of the table of each key, whose freed memory goes back to the system."""
    return df.groupBy(key).applyInArrow(lambda table: next(iter(list(tidy(lambda t: iter([run(t)]))(table)))), schema)


def count_cells(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each of the parts that cells are dealt to: p and blob, its cells. rows: held, t."""

    def count(batches):
        for found, w, doc in flushes(batches, 1):
            held = np.concatenate([x.column(0).to_numpy(zero_copy_only=False).astype(bool) for x in found])[doc]
            cells = Cells.of_tokens(w, held)
            yield from _blobs([(p, cells.take(at).blob()) for p, at in dealt(owner(cells.key(), parts), parts)]).to_batches()

    def merge(table):
        return _blobs([(table["p"][0].as_py(), Cells.merged(table["blob"].to_pylist()).blob())])

    return materialise(by(rows.mapInArrow(tidy(count), "p long, blob binary"), "p", merge, "p long, blob binary"), "cells")


def cell_rows(cells: DataFrame, which) -> DataFrame:
    """u, w, n, other and t (the sixth array of a blob, else n) of those cells that which(cells) finds."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                x, t = Cells.read(blob), unpack(blob)[5:6]
                at = np.flatnonzero(which(x))
                yield _rows(["u", "w", "n", "other", "t"], x.words[x.u[at]], x.words[x.w[at]], x.n[at], x.other[at], (t[0] if t else x.n)[at].astype(float))

    return cells.mapInArrow(tidy(run), "u long, w long, n long, other long, t double")


def count_words(cells: DataFrame, parts: int) -> DataFrame:
    """A row for each owner of words: p, sums over its words of n, m and one for each that training texts have, and
    blob: h, n, m, u1, w1 of its words; see fit."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                x = Cells.read(blob)
                size, once = len(x.words), x.n == 1
                sums = [np.bincount(x.w, x.n, size), np.bincount(x.w, x.n + x.other, size), np.bincount(x.u[once], minlength=size), np.bincount(x.w[once], minlength=size)]
                yield from _blobs([(p, pack(steps(x.words[at]), *(s[at].astype(np.int64) for s in sums))) for p, at in dealt(owner(x.words, parts), parts)]).to_batches()

    def add(table):
        found = [unpack(b) for b in table["blob"].to_pylist()]
        words, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in found]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[i] for x in found]), len(words)).astype(np.int64) for i in range(1, 5)]
        n, m = sums[:2]
        return _row(table["p"][0].as_py(), (n.sum(), (n > 0).sum(), m.sum()), pack(steps(words), *sums))

    return materialise(by(cells.mapInArrow(tidy(run), "p long, blob binary"), "p", add, _OWNED), "vocabulary")


_OWNED = "p long, a double, b double, c double, blob binary"


def _row(p: int, sums: tuple, blob: bytes) -> pa.Table:
    return pa.table({"p": [p], **{k: [float(x)] for k, x in zip("abc", sums)}, "blob": pa.array([blob], pa.binary())})


_DEALT = "p long, kind long, part long, blob binary"
_CELLS, _TABLES, _TOLD, _ASKED, _BASE = range(5)


def _dealt(found: list) -> pa.Table:
    return _blobs(found, ("p", "kind", "part", "blob"), (pa.int64(),) * 3 + (pa.binary(),))


def as_kind(df: DataFrame, kind: int) -> DataFrame:
    return df.select("p", F.lit(kind).cast("long").alias("kind"), F.lit(-1).cast("long").alias("part"), "blob")


def tell_words(cells: DataFrame, words: DataFrame, parts: int, told) -> DataFrame:
    """For each part of the cells, from each owner of words, told(arrays of the owner) for the part's words that it owns."""

    def ask(batches):
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist()):
                x = Cells.read(blob).words
                yield from _dealt([(q, _ASKED, p, pack(steps(x[at]))) for q, at in dealt(owner(x, parts), parts)]).to_batches()

    def answer(table):
        q, kind, part, blob = (table[c].to_pylist() for c in table.column_names)
        own = unpack(blob[kind.index(_TOLD)])
        h, own, out = np.cumsum(own[0]), told(own), []
        for k, p, b in zip(kind, part, blob):
            if k == _ASKED:
                at = np.searchsorted(h, np.cumsum(unpack(b)[0]))
                out.append((p, _TOLD, q[0], pack(*(x[at] for x in own))))
        return _dealt(out)

    return by(as_kind(words, _TOLD).unionByName(cells.mapInArrow(tidy(ask), _DEALT)), "p", answer, _DEALT)


def hear(words: np.ndarray, kinds: list, part: list, blob: list, parts: int) -> np.ndarray:
    """What tell_words told, for each of the words."""
    own, found = owner(words, parts), None
    for k, q, b in zip(kinds, part, blob):
        if k == _TOLD:
            x = unpack(b)
            found = np.zeros((len(x), len(words))) if found is None else found
            found[:, own == q] = x
    return found


# -- model ------------------------------------------------------------------------------------------------------

class Keyed:
    """Binomial draws that hang on a row's key, the sweep and the customer alone."""

    def __init__(self, keys: np.ndarray, sweep: int):
        self.keys, self.sweep = keys.view(np.uint64), sweep

    def draw(self, live: np.ndarray, n: int, here: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = self.keys[live] + np.uint64((0x9E3779B97F4A7C15 * (n * 64 + self.sweep + 1)) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        draw = (x >> np.uint64(11)) / float(1 << 53)
        got = (draw < p).astype(np.int64)
        many = np.flatnonzero(here > 1)
        if len(many):
            h, q = here[many].astype(np.float64), p[many]
            big = h * np.minimum(q, 1 - q) > 50
            left, k = np.flatnonzero(~big), 0
            flip = q > 0.5  # by the inverse of the distribution, of the rarer outcome
            r = np.where(flip, 1 - q, q)
            pmf = np.exp(h * np.log1p(-r))
            cdf, out = pmf.copy(), np.zeros(len(many))
            while len(left):
                left = left[(draw[many][left] >= cdf[left]) & (k < h[left])]
                k += 1
                pmf[left] *= (h[left] - k + 1) / k * r[left] / (1 - r[left])
                cdf[left] += pmf[left]
                out[left] = k
            out = np.where(flip, h - out, out)
            for i in np.flatnonzero(big):
                out[i] = np.random.default_rng(int(x[many[i]])).binomial(int(h[i]), q[i])
            got[many] = out.astype(np.int64)
        return got


def seat(c: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish after its c customers are seated one after the other. base: the parent's probability of the
    dish; strength: concentration and discount times the tables of the whole restaurant."""
    t = (c > 0).astype(np.float64)
    new = strength * base
    live, n = np.flatnonzero(c > 1), 1
    while len(live):
        step = max(1, n // 16)
        here = np.minimum(step, c[live] - n)
        p = new[live] / (new[live] + np.maximum(n - discount * t[live], 1e-9))
        p, here = np.clip(p, 0, 1), here.astype(np.int64)
        t[live] += rng.draw(live, n, here, p) if isinstance(rng, Keyed) else rng.binomial(here, p)
        n += step
        live = live[c[live] > n]
    return np.minimum(t, c)


class ContextModel:
    """log10 P(class | class before) as a matrix; rows are contexts."""

    def __init__(self, counts: np.ndarray, discount=0.7, concentration=5.0, warm=2, sweeps=4, seed=1):
        rng, width = np.random.default_rng(seed), counts.shape[0]
        at = np.nonzero(counts)
        c = counts[at].astype(np.float64)
        size = counts.sum(1).astype(np.float64)
        t = np.minimum(c, 1.0)
        total, root_t = np.zeros(counts.shape), None
        for sweep in range(warm + sweeps):
            customers = np.bincount(at[1], t, width)  # of the parent: one for each table of a context
            if root_t is None:
                root_t = np.minimum(customers, 1.0)
            root_t = seat(customers, np.full(width, 1 / width), np.full(width, concentration + discount * root_t.sum()), discount, rng)
            root = (np.maximum(customers - discount * root_t, 0) + (concentration + discount * root_t.sum()) / width) / (concentration + customers.sum())
            tables = np.bincount(at[0], t, width)
            t = seat(c, root[at[1]], (concentration + discount * tables)[at[0]], discount, rng)
            tables = np.bincount(at[0], t, width)
            p = (concentration + discount * tables)[:, None] * root[None, :]
            p[at] += np.maximum(c - discount * t, 0)
            p /= (concentration + size)[:, None]
            if sweep >= warm:
                total += p / p.sum(1, keepdims=True)
        self.log = np.log10(total / sweeps).astype(np.float32)


class WordModel:
    """log10 P(word | it is a rarer word), a function of its count. histogram: counts of counts."""

    def __init__(self, histogram: dict[float, int], concentration=10.0, sweeps=32, seed=2):
        rng = np.random.default_rng(seed)
        self.c = np.array(sorted(histogram), np.float64)
        m = np.array([histogram[x] for x in sorted(histogram)], np.float64)
        n1, n2 = (histogram.get(k, 0) for k in (1, 2))
        self.discount = d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
        types, tokens = m.sum(), (m * self.c).sum()
        self.base, tables = 1 / (types + 1), types
        samples = []
        for _ in range(sweeps):
            t = seat(self.c, np.full(len(m), self.base), np.full(len(m), concentration + d * tables), d, rng) if len(m) else m
            tables = (m * t).sum()
            samples.append(t)
        self.t = np.mean(samples[sweeps // 4 :], axis=0)
        self.new = concentration + d * (m * self.t).sum()
        self.size = concentration + tokens

    def log(self, c: np.ndarray) -> np.ndarray:
        t = np.interp(c, self.c, self.t) if len(self.c) else np.zeros(len(c))
        return np.log10((np.maximum(c - self.discount * np.where(c > 0, t, 0), 0) + self.new * self.base) / self.size)


def fit(cells: DataFrame, vocabulary: DataFrame, types: int, parts: int, discount=0.7, concentration=5.0, warm=2, sweeps=4) -> tuple[DataFrame, DataFrame]:
    """The model of ``ContextModel`` over all cells, of which only those of several customers are seated anew. vocabulary:
    h, n, m, u1, w1 (customers, all tokens, cells of one customer that have h as context, as word). Returns the cells of
    several customers with t, and h, n, m, tables and root: means over the sweeps. A word's tables and root are those of
    its context and of its dish."""

    def several(batches):
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist()):
                x = Cells.read(blob)
                at = np.flatnonzero(x.n > 1)
                if len(at):
                    x, one = x.take(at), np.ones(len(at))
                    yield from _blobs([(p, pack(steps(x.words), steps(x.u), x.w, x.n, x.other, one, 0 * one))]).to_batches()

    def tables(batches):  # by dish and by context
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                x, t = Cells.read(blob), unpack(blob)[5:]
                t = t[2] if len(t) > 2 else t[0]  # of the last sweep
                k, s = (np.bincount(i, t, len(x.words)) for i in (x.w, x.u))
                yield from _dealt([(q, _TABLES, -1, pack(steps(x.words[at]), k[at], s[at])) for q, at in dealt(owner(x.words, parts), parts)]).to_batches()

    def share_of(k, t, root):
        return (np.maximum(k - discount * t, 0) + root[0]) / root[1]

    def seat_parent(sweep, strength, root):
        """The sums of the last sweep and, but after the last one, new tables of the parent. root: what the last sweep's
        shares are reckoned from."""

        def run(table):
            kinds, blob = table["kind"].to_pylist(), table["blob"].to_pylist()
            h, n, m, u1, w1, *state = unpack(blob[kinds.index(_TOLD)])
            words = np.cumsum(h)
            k, s = w1.astype(float), u1.astype(float)
            tables_sum, root_sum, k0, t0 = state[:4] if state else np.zeros((4, len(words)))
            for kind, b in zip(kinds, blob):
                if kind == _TABLES:
                    own, k1, s1 = unpack(b)
                    at = np.searchsorted(words, np.cumsum(own))
                    k[at] += k1
                    s[at] += s1
            if sweep > warm:
                tables_sum, root_sum = tables_sum + s, root_sum + share_of(k0, t0, root)
            if sweep == warm + sweeps:
                return _row(table["p"][0].as_py(), (0, 0, 0), pack(h, n, m, tables_sum / sweeps, root_sum / sweeps))
            t = seat(k, np.full(len(k), 1 / (types + 1)), np.full(len(k), strength), discount, Keyed(words, sweep))
            return _row(table["p"][0].as_py(), (t.sum(), k.sum(), 0), pack(h, n, m, u1, w1, tables_sum, root_sum, k, t, s))

        return run

    def seat_cells(sweep, root):
        def run(table):
            p, kinds, part, blob = (table[c].to_pylist() for c in table.column_names)
            *same, _, t_sum = unpack(blob[kinds.index(_CELLS)])
            x = Cells.read(blob[kinds.index(_CELLS)])
            k, t, s = hear(x.words, kinds, part, blob, parts)
            t = seat(x.n.astype(float), share_of(k, t, root)[x.w], (concentration + discount * s)[x.u], discount, Keyed(x.key(), sweep))
            t_sum = t_sum + t * (sweep >= warm)
            return _blobs([(p[0], pack(*same, t_sum / sweeps if sweep == warm + sweeps - 1 else t, t_sum, *([t] if sweep == warm + sweeps - 1 else [])))])

        return run

    again = materialise(cells.mapInArrow(tidy(several), "p long, blob binary"), "seated")
    words, root_tables, root = vocabulary, float(types), None
    for sweep in range(warm + sweeps + 1):
        last = sweep == warm + sweeps
        summed = as_kind(words, _TOLD).unionByName(again.mapInArrow(tidy(tables), _DEALT))
        now = materialise(by(summed, "p", seat_parent(sweep, concentration + discount * root_tables, root), _OWNED), "words")
        forget(words)
        words = now
        if not last:
            root_tables, customers = (x or 0.0 for x in words.agg(F.sum("a"), F.sum("b")).first())
            root = ((concentration + discount * root_tables) / (types + 1), concentration + customers)
            told = as_kind(again, _CELLS).unionByName(tell_words(again, words, parts, lambda x: x[7:10]))
            now = materialise(by(told, "p", seat_cells(sweep, root), "p long, blob binary"), "seated")
            forget(again)
            again = now
    return again, words


# -- scoring ----------------------------------------------------------------------------------------------------

def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = 510, lexicon: int = 1 << 20, slices: int = 4, part_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A null or empty text has one token, its end. Repeated rows are learned from and scored each; other columns are not
    read. Without training texts the base gives every token the same probability, and so does the model. ``classes`` and
    ``slices`` have no effect: all words are contexts and dishes. Cells are dealt to a part for each ``part_bytes`` of text.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    discount, concentration = 0.7, 5.0
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), whole_text(text_col).cast("binary").alias("t"))
    many = max(16, (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // part_bytes)
    cells = count_cells(rows.select("held", "t"), many)
    vocabulary = count_words(cells, many)
    n_all, v, every = (int(x or 0) for x in vocabulary.agg(F.sum("a"), F.sum("b"), F.sum("c")).first())
    again, words = fit(cells, vocabulary, v, many, discount, concentration)

    def often(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                h, n, m, tables, root = unpack(blob)
                at = m * lexicon > every
                yield _rows(["h", "n", "tables", "root"], *(x[at] for x in (np.cumsum(h), n, tables, root)))

    # a cell that makes up more than a 1/lexicon share of all tokens has two such words; there are fewer than lexicon
    found = cell_rows(cells, lambda x: (x.n < 2) & ((x.n + x.other) * lexicon > every)).unionByName(cell_rows(again, lambda x: (x.n + x.other) * lexicon > every))
    hot = words.mapInArrow(tidy(often), "h long, n long, tables double, root double")
    found = found.join(F.broadcast(hot.select(F.col("h").alias("u"), F.col("n").alias("size"), "tables")), "u").join(F.broadcast(hot.select(F.col("h").alias("w"), F.col("n").alias("c"), "root")), "w")

    def score(n, t, size, tables, root):
        size, new = concentration + size, concentration + discount * tables
        return np.log10((n - discount * t) / size + new / size * root)

    def base(c):
        return np.log10((c + 1) / float(n_all + v + 1))

    f = found.select("u", "w", "n", "t", "size", "tables", "c", "root").toPandas()
    h = cell_key(f["u"].to_numpy(np.int64), f["w"].to_numpy(np.int64))
    order = np.argsort(h)
    c = f["c"].to_numpy(np.int64)
    s = score(*(f[x].to_numpy(float) for x in ("n", "t", "size", "tables", "root")))
    known = spark.sparkContext.broadcast(tuple(x[order] for x in (h, (c > 0).astype(np.int64), base(c), s)))

    def ask(batches):
        from pyspark import TaskContext

        (h, *scores), part = known.value, TaskContext.get().partitionId() << 32
        for got, w, doc in flushes(batches, 2):
            texts = sum(x.num_rows for x in got)
            size = np.bincount(doc, minlength=texts)
            cell = cell_key(np.concatenate([[END], w[:-1]]), w)
            order = np.argsort(cell)
            cell, doc = cell[order], doc[order]
            at = np.minimum(np.searchsorted(h, cell), max(0, len(h) - 1))
            inside = h[at] == cell if len(h) else np.zeros(len(cell), bool)
            k, b, s = (np.bincount(doc[inside], x[at[inside]], texts).astype(float) for x in scores)  # of nothing, bincount gives integers
            own = pa.Table.from_batches(got).select([0, 1]).combine_chunks()
            for name, x in (("n_tokens", size), ("k", k.astype(np.int64)), ("b", b), ("s", s)):
                own = own.append_column(name, pa.array(x))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_table(own)
            cell, doc = cell[~inside], doc[~inside]
            out = [(p, _ASKED, part, pack(steps(cell[x]), doc[x])) for p, x in dealt(owner(cell, many), many)]
            yield from _dealt([(part % many, _BASE, part, sink.getvalue().to_pybytes()), *out]).to_batches()
            part += 1

    def look_up(table):
        p, kinds, part, blob = (table[c].to_pylist() for c in table.column_names)
        out = [(x, _BASE, b) for k, x, b in zip(kinds, part, blob) if k == _BASE]
        if _CELLS in kinds:
            x = Cells.read(blob[kinds.index(_CELLS)])
            key, t = x.key(), x.n.astype(float)
            order = np.argsort(key)
            key = key[order]
            for k, b in zip(kinds, blob):
                if k == _TABLES:
                    t[order[np.searchsorted(key, Cells.read(b).key())]] = unpack(b)[5]
            n, tables, root = hear(x.words, kinds, part, blob, many)
            s = score(x.n, t, n[x.u], tables[x.u], root[x.w])[order]
            c = n[x.w][order]
            b, k = base(c), (c > 0).astype(float)
            for kind, q, asked in zip(kinds, part, blob):
                if kind == _ASKED:
                    cell, doc = unpack(asked)
                    at, size = np.searchsorted(key, np.cumsum(cell)), np.bincount(doc)
                    some = np.flatnonzero(size)
                    sums = [np.bincount(doc, y[at])[some] for y in (k, b, s)]
                    out.append((q, _ASKED, pack(steps(some), sums[0].astype(np.int64), *sums[1:])))
        return _blobs(out, ("part", "kind", "blob"), (pa.int64(), pa.int64(), pa.binary()))

    def add(table):
        kinds, blob = table["kind"].to_pylist(), table["blob"].to_pylist()
        own = pa.ipc.open_stream(blob[kinds.index(_BASE)]).read_all()
        k, b, s = (own[c].to_numpy().copy() for c in ("k", "b", "s"))
        for kind, x in zip(kinds, blob):
            if kind == _ASKED:
                at, *plus = unpack(x)
                at = np.cumsum(at)
                for total, y in zip((k, b, s), plus):
                    total[at] += y
        return pa.table([own[0], own[1], own["n_tokens"], pa.array(k), pa.array(b), pa.array(s)], ["id", "held", "n_tokens", "k", "b", "s"])

    asked = rows.mapInArrow(tidy(ask), _DEALT)
    told = tell_words(cells, words, many, lambda x: (x[1], x[3], x[4]))
    dealt_all = as_kind(cells, _CELLS).unionByName(as_kind(again, _TABLES)).unionByName(told).unionByName(asked)
    sums = by(dealt_all, "p", look_up, "part long, kind long, blob binary")
    done = materialise(by(sums, "part", add, f"id {kind}, held boolean, n_tokens long, k long, b double, s double"), "scores")
    forget(cells, again, words)
    return done.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", F.col("k").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        F.col("b").alias("base_score"), F.col("s").alias("score"), F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))

"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams, as 64-bit hashes. The global order of n-grams is by rising frequency (ties by
hash), frequency being the number of different sets that hold one. The steps:

1. Equal sets are one class, told apart by 128 bits of a digest.
2. An n-gram that no other set holds can be in no overlap, so a set with more of them than (1 - t) of its size links with
   nothing and goes. That is tried on a part of the hash space first, so that most texts' n-grams never move; those that
   are left are then counted whole. Owners are combined within partitions before the shuffle, so a frequent n-gram is
   one row per partition.
3. Linked sets share one of the first |a| - ceil(t |a|) + 1 n-grams of the global order of each; sets that share such an
   n-gram are candidates if their sizes allow t.
4. The global order is cut into fragments of about equal weight. For each fragment and candidate pair the overlap of the
   two segments is counted by itself, and the partial overlaps are summed per pair; a pair is linked if the sum reaches t.
5. Only pairs not known to be connected need to be compared. So candidates are taken in two rounds. First every set of
   an n-gram's list meets the list's hub alone (the set made of the most frequent n-grams), which connects the copies of
   one text by as many pairs as there are copies. Then all pairs that lie in one list and in two components are compared;
   in lists with more than a few such pairs for each set, sets are described by what they differ in from the hub, and
   only pairs are taken that share enough of it (``pairs_by_difference``). Nothing is capped and no link is lost: what is
   left out is connected already, or cannot be linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, salts_for, table, tidy, whole_text, without
from .graph import connected_components

_FLUSH = 400_000
#: Pieces that the global order is cut into.
FRAGMENTS = 8
#: Lists with at most this many pairs apart for each of their sets are compared pair by pair.
FEW = 4


# -- sets ---------------------------------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _FLUSH:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def _clear() -> None:
    _hashes.clear()


def ngram_set(text: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; with fewer words, of the whole sequence; empty without words."""
    words = text.lower().split()  # of bytes: A-Z and the six white-space characters only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    x = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(x)])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_class(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


# -- candidates ---------------------------------------------------------------------------------------------------

def first_part(percent: int) -> int:
    """Bits below which a hash is counted in the first part of step 2: twice the share that linked sets may differ in,
    so that a set goes there if half of its n-grams are its own."""
    return min(2 * (100 - percent), 100) * ((1 << 64) // 100)


def _sets(n: int, percent: int):
    below = np.uint64(min(first_part(percent), (1 << 64) - 1))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [ngram_set(t, n) for t in part.column("t").to_pylist()]
                some = [x[: np.searchsorted(x, below)].view(np.int64) for x in sets]
                names = [set_class(x) for x in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary()),
                     pa.array([int.from_bytes(c[:8], "little", signed=True) for c in names], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*some, np.empty(0, np.int64)])))],
                    ["id", "h", "n", "cls", "node", "some"])

    return run


def _fetch(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int, most: int = 500_000) -> DataFrame:
    """node, n, x: the sets of the wanted classes (rep, cls, node, n), made again from the text of one document each. The
    list is broadcast only if it has at most ``most`` rows, as counted; else it is joined by a shuffle."""
    wanted = F.broadcast(wanted) if wanted.count() <= most else wanted
    rows = docs.select(F.col(id_col).alias("rep"), whole_text(text_col).cast("binary").alias("t")).join(wanted, "rep")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [ngram_set(t, n) for t in part.column("t").to_pylist()]
                ok = pa.array([set_class(x) == c for x, c in zip(sets, part.column("cls").to_pylist())], pa.bool_())  # a repeated id has several texts
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "n", "x"]).filter(ok)

    return rows.select("node", "n", "cls", "t").mapInArrow(tidy(run, _clear), "node long, n long, x array<bigint>").dropDuplicates(["node"])


def _enough(overlap, sizes, percent: int):
    """100 * overlap >= percent * union, sizes being the sum of both."""
    return 100 * overlap >= percent * (sizes - overlap)


def ordered_sets(full: DataFrame, percent: int) -> DataFrame:
    """node, n, weight, p, g: for each set that can link at all, its n-grams that other sets hold as (f, h) in global order,
    and how many of them are its prefix; weight is their mean frequency over all n-grams of the set."""
    entries = full.select("node", "n", F.explode("x").alias("h"))
    often = entries.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    g = entries.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("g"))
    need = F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int")
    weight = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["f"]) / F.col("n")
    return g.where(F.size("g") >= need).select("node", "n", weight.alias("weight"), (F.size("g") - need + 1).alias("p"), "g")


def segments(lists: DataFrame, pieces: int) -> DataFrame:
    """node, n, v, x: the n-grams of a set that lie in fragment v of the global order."""
    place = lambda x: x["f"].cast("double") + (x["h"] / F.lit(2.0**64) + 0.5)  # noqa: E731  (by frequency, then by hash)
    found = lists.select(F.explode("g").alias("x")).select(place(F.col("x")).alias("at"))
    cuts = found.agg(F.percentile_approx("at", [(i + 1) / pieces for i in range(pieces - 1)], 1000)).first()[0] or []
    ends = [float("-inf"), *sorted(set(cuts)), float("inf")]

    def piece(lo, hi):
        return F.transform(F.filter("g", lambda x: (place(x) > F.lit(lo)) & (place(x) <= F.lit(hi))), lambda x: x["h"])

    parts = F.array(*[F.struct(F.lit(v).alias("v"), piece(lo, hi).alias("x")) for v, (lo, hi) in enumerate(zip(ends, ends[1:]))])
    return lists.select("node", "n", F.inline(parts)).where(F.size("x") > 0)


def partial_overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """a, b, v, o: the overlap of each pair (a, b) in each fragment in which both have a segment, and both sizes."""
    a = segs.select(F.col("node").alias("a"), "v", F.col("n").alias("na"), F.col("x").alias("xa"))
    b = segs.select(F.col("node").alias("b"), "v", F.col("n").alias("nb"), F.col("x").alias("xb"))
    return pairs.join(a, "a").join(b, ["b", "v"]).select("a", "b", "v", "na", "nb", F.size(F.array_intersect("xa", "xb")).cast("long").alias("o"))


def linked(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose partial overlaps sum up to enough."""
    total = partial_overlaps(pairs, segs).groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(_enough(F.col("o"), F.col("na") + F.col("nb"), percent)).select("a", "b")


def listed(lists: DataFrame, percent: int) -> DataFrame:
    """h, j, node, n, weight: a row for each prefix n-gram h of a set and each of the two size classes j that a set belongs
    to, such that sets whose sizes allow a link have a class in common."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * 1.000001)))
    prefix = F.transform(F.slice("g", F.lit(1), F.col("p")), lambda x: x["h"])
    return lists.select("node", "n", "weight", F.explode(prefix).alias("h"), size.alias("j")).select(
        "h", F.explode(F.array(F.col("j"), F.col("j") + 1)).alias("j"), "node", "n", "weight")


def _hubs(keys: DataFrame) -> DataFrame:
    """h, j, hub, hub_n: the set of each list that has the greatest weight."""
    return keys.groupBy("h", "j").agg(F.max(F.struct("weight", "node", "n")).alias("s")).select("h", "j", F.col("s.node").alias("hub"), F.col("s.n").alias("hub_n"))


def _fit(a: str, b: str, percent: int):
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _ordered(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def pairs_by_difference(members: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs to compare among the sets of each hub; members: hub, node, c (its component).

    A set is described by D, what it and the hub's shared n-grams differ in. Two sets differ in |D_a| + |D_b| - 2 |D_a and
    D_b| n-grams, so with E = (100 + percent) |D| - (100 - percent) n they are linked if and only if E_a + E_b is at most
    2 (100 + percent) times what D_a and D_b share. If E_a + E_b is not positive they are linked whatever they share, and
    then both are linked to the set of least E, or one is that set; such pairs are returned as a star. All other pairs
    must share elements of D, and a prefix of D by rising frequency tells which may: copies of a text that were changed
    in different places share no rare one, however many they are."""
    sets = lists.select("node", "n", F.transform("g", lambda x: x["h"]).alias("x"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("x").alias("y"))
    d = members.join(sets, "node").join(of_hub, "hub").select(
        "hub", "node", "c", "n", F.size("x").alias("shared"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    step = F.lit(2 * (100 + percent))
    d = materialise(d.select("hub", "node", "c", "n", "d", (F.lit(100 + percent) * (F.col("n") - F.col("shared") + F.size("d")) - F.lit(100 - percent) * F.col("n")).alias("e")), "differences")
    least = d.groupBy("hub").agg(F.min(F.struct("e", "node", "c", "n")).alias("m"))
    star = d.join(least, "hub").where((F.col("e") + F.col("m.e") <= 0) & (F.col("c") != F.col("m.c"))).select(*_ordered("node", "m.node"))
    x = d.select("hub", "node", "c", "n", "e", F.explode("d").alias("x"))
    often = x.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    x = x.join(often, ["hub", "x"]).groupBy("hub", "node", "c", "n", "e").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("d"))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("m.e")) / step)).cast("int")
    x = x.join(least, "hub").withColumns({"q": F.size("d"), "p": F.size("d") - need + 1}).where("p > 0")
    x = materialise(x.select("hub", "node", "c", "n", "e", "q", F.explode(F.slice("d", F.lit(1), F.col("p"))["x"]).alias("x")), "difference-prefixes")
    y = x.select("hub", "x", *[F.col(k).alias(f"{k}_") for k in ("node", "c", "n", "e", "q")])
    together = F.col("e") + F.col("e_")
    some = (F.col("c") < F.col("c_")) & _fit("n", "n_", percent) & (together > 0) & (F.ceil(together / step) <= F.least("q", "q_"))
    return star.unionByName(x.join(y, ["hub", "x"]).where(some).select(*_ordered("node", "node_"))).distinct()


def components(lists: DataFrame, percent: int, few: int = FEW, pieces: int = FRAGMENTS) -> DataFrame:
    """node, component: the components of the links between sets, for those that link."""
    segs = materialise(segments(lists, pieces), "segments")
    keys = materialise(listed(lists, percent), "prefixes")

    pairs = keys.join(_hubs(keys), ["h", "j"]).where((F.col("node") != F.col("hub")) & _fit("n", "hub_n", percent))
    pairs = materialise(pairs.select(*_ordered("node", "hub")).distinct(), "pairs-with-hubs")
    label = materialise(connected_components(linked(pairs, segs, percent)), "components")

    now = keys.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    each = now.groupBy("h", "j", "c").agg(F.count(F.lit(1)).alias("m"))
    apart = each.groupBy("h", "j").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1 AND m > 2")
    apart = apart.select("h", "j", (F.col("m") * F.col("m") - F.col("s") <= 2 * few * F.col("m")).alias("direct"))
    now = materialise(now.join(apart, ["h", "j"]), "lists-apart")
    if not now.head(1):
        return label
    direct = now.where("direct")
    other = direct.select("h", "j", *[F.col(k).alias(f"{k}_") for k in ("node", "c", "n")])
    pairs = direct.join(other, ["h", "j"]).where((F.col("c") < F.col("c_")) & _fit("n", "n_", percent)).select(*_ordered("node", "node_")).distinct()
    large = now.where("NOT direct")
    members = materialise(large.join(_hubs(large), ["h", "j"]).select("hub", "node", "c").distinct(), "members")
    pairs = materialise(pairs.unionByName(pairs_by_difference(members, lists, percent)).distinct(), "pairs")
    more = linked(pairs, segs, percent)
    first, second = (label.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    more = more.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    later = materialise(connected_components(materialise(more, "links")), "components")
    both = label.join(later.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = later.join(label, "node", "left_anti")  # those that are linked first here
    return both.unionByName(alone.select("node", "component"))


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, h (hash of the text), n, group (a number of the component), component_id."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("h"), whole_text(text_col).cast("binary").alias("t"))
    sets = materialise(rows.mapInArrow(tidy(_sets(n, percent), _clear), f"id {kind}, h long, n long, cls binary, node long, some array<bigint>"), "sets")

    # classes of equal sets; reduced within salts, so that no class's rows meet in one task
    light = sets.select("id", "h", "n", "cls", "node", F.pmod(F.xxhash64("id", "h"), F.lit(salts_for(sets.count()))).alias("salt"))
    salted = materialise(light.where("n > 0").groupBy("cls", "salt").agg(F.min("id").alias("id"), F.first("node").alias("node"), F.first("n").alias("n")), "salted")
    classes = materialise(salted.groupBy("cls").agg(F.min("id").alias("rep"), F.first("node").alias("node"), F.first("n").alias("n")), "classes")

    owners = sets.select("node", F.explode("some").alias("g")).groupBy("g").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    own = owners.where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    wanted = classes.join(own, "node", "left").where((100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")) & F.col("rep").isNotNull())
    wanted = materialise(wanted.select("rep", "cls", "node", "n"), "wanted")
    full = materialise(_fetch(docs, wanted, id_col, text_col, n), "whole-sets")
    lists = materialise(ordered_sets(full, percent), "ordered-sets")
    forget(full)
    found = materialise(components(lists, percent), "all-components")

    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialise(named.select("cls", "component").join(least, "component"), "named")
    named = salted.select("cls", "salt").join(named, "cls")
    some = F.col("n") > 0
    return light.join(named, ["cls", "salt"], "left").select(
        "id", "h", "n", F.col("component").alias("group"), F.when(some, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Two documents link if 100 * intersection >= percent * union of their sets of n-grams; component_id is the smallest
    id reachable by links, itself included. Null, empty and word-less texts have no n-grams and link with nothing.
    Rows that repeat an id are documents of their own: each has the component of its own text. Rows without an id have a
    null component unless their set is also that of one with an id, and tie no others. Other columns are not read, and an
    empty table gives an empty result. Sets are told apart by 128 bits of a digest (by 64 where n-grams are owned and
    sets are compared), n-grams by 64.
    """
    found = classes_of(docs, id_col, text_col, n, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, of one document of each component: that with the smallest id and, if several
    texts share it, the smallest hash of its text; rows that repeat both are one document. Rows without an id stay, and
    so do those without words. Rows go by id and text, so other rows that repeat an id are not touched."""
    found = materialise(classes_of(docs, id_col, text_col, n, percent).where(F.col("id").isNotNull() & (F.col("n") > 0)).select("id", "h", "group"), "grouped")
    first = found.groupBy("group").agg(F.min(F.struct("id", "h")).alias("first"))
    gone = found.join(first, "group").where((F.col("id") != F.col("first.id")) | (F.col("h") != F.col("first.h")))
    return without(docs, gone.select("id", "h"), id_col, text_col)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

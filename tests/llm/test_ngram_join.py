import random

import pytest

from docspark.llm import ngram_join as nj
from docspark.llm.graph import connected_components
from tests.llm.data import awkward, empty


def brute(rows, n, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def _compare(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, n=n, percent=percent).collect()}
    want = brute(rows, n, percent)
    assert got == want
    return want


@pytest.mark.parametrize("n, percent, few", [(3, 90, 4), (5, 80, 0)])  # lists compared pair by pair, and by differences from hubs
def test_equals_brute_force(spark, n, percent, few, monkeypatch):
    monkeypatch.setattr(nj.components, "__defaults__", (few, nj.FRAGMENTS))
    random.seed(n)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [random.choice(vocabulary) for _ in range(40)]
    for g in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice([4, 12, 25, 80, 300]))]
        for _ in range(random.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 40))):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(passage + [random.choice(vocabulary) for _ in range(k)])) for i, k in enumerate([1, 2, 3, 4, 30, 31])]
    want = _compare(spark, rows, n, percent)
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_many_copies_that_do_not_link(spark, monkeypatch):
    """Copies of one text changed in several places, whose hub links with few of them, and some that link with each other
    alone; pairs stay far below the square of the group."""
    monkeypatch.setattr(nj.components, "__defaults__", (0, nj.FRAGMENTS))
    seen = []
    plain = nj.linked
    monkeypatch.setattr(nj, "linked", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    random.seed(7)
    base, rows = [f"w{i}" for i in range(70)], []
    for i in range(150):
        w = list(base)
        for at in random.sample(range(70), random.choice([0, 1, 2, 3, 4, 6])):
            w[at] = f"x{random.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
        if i % 10 == 0:  # a copy of the copy
            w[random.randrange(70)] = "again"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(base[i:] + [f"y{i}_{k}" for k in range(i // 2)])) for i in range(0, 12)]
    random.shuffle(rows)
    want = _compare(spark, rows, 3, 90)
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 20
    assert sum(seen) < len(rows) ** 2 / 8


def test_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (8, a + " z"), (8, a + " z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nj.jaccard_components(df).collect()) == [(3, 3), (5, 3), (5, 5), (8, 5), (8, 5)]
    assert sorted(nj.keep_one(df).collect()) == [(3, b), (5, a)]
    near = spark.createDataFrame([(7, a), (7, a + " z")], "doc_id long, text string")
    assert nj.keep_one(near).count() == 1


def test_awkward(spark):
    df = awkward(spark)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()]
    assert len(got) == df.count()
    assert {x for x in got if x[0] in (1, 2, 7)} == {(1, 14, 1), (2, 14, 1), (7, 14, 1)}
    assert {x[1:] for x in got if x[0] in (3, 4, 5)} == {(0, 3), (0, 4), (0, 5)}
    assert [x[2] for x in got if x[0] is None] == [None]
    assert sorted(r.doc_id or 0 for r in nj.keep_one(df, n=3, percent=90).collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 10]
    assert nj.jaccard_components(empty(spark)).count() == 0


def test_partial_overlaps_sum_up(spark):
    sets = {1: [1, 2, 3, 4, 5, 6], 2: [2, 3, 4, 5, 9], 3: [1, 9, -7]}
    full = spark.createDataFrame([(k, len(x), [g << 59 for g in x]) for k, x in sets.items()], "node long, n long, x array<long>")
    lists = nj.ordered_sets(full, 10).cache()
    assert {r.node: len(r.g) for r in lists.collect()} == {1: 5, 2: 5, 3: 2}
    segs = nj.segments(lists, 3)
    assert segs.select("v").distinct().count() > 1
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    parts = nj.partial_overlaps(pairs, segs).collect()
    total = {}
    for r in parts:
        total[r.a, r.b] = total.get((r.a, r.b), 0) + r.o
    assert total == {(1, 2): 4, (1, 3): 1, (2, 3): 1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from docspark.llm import graph

    rounds = []
    plain = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or plain(df, name))
    edges = spark.range(4000).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(edges)
    assert got.count() == 4001 and got.where("component <> 0").count() == 0
    assert rounds.count("merges") <= 20
    star = spark.range(1, 3000).selectExpr("0 AS a", "id AS b")
    assert connected_components(star).where("component = 0").count() == 3000

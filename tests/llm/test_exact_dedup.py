import hashlib
import re

from docspark.llm.exact_dedup import exact_dedup, merge
from tests.llm.data import ROWS, awkward, empty


def test_awkward_equals_brute_force(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = sorted((str(i), str(min((j for j, u, *_ in ROWS if norm(u) == norm(t) and j is not None), default=None)),
                   sum(norm(u) == norm(t) for _, u, *_ in ROWS), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in ROWS)
    for parts in (1, 40):
        got = exact_dedup(awkward(spark).repartition(parts), steps=1).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0


def test_merges_are_sorted(spark):
    """The sort of a merge is what its aggregation reads; nothing is hashed, and nothing is exchanged but the runs."""
    level = spark.createDataFrame([(r, bytearray([r % 3]), 1, 1, (False, i), 1) for r in range(8) for i in range(5)], "run int, digest binary, n_bytes long, witness long, keep struct<none:boolean,id:int>, n long")
    for _ in range(3):
        level = merge(level, 1)
        plan = level._jdf.queryExecution().sparkPlan().toString()
        assert "SortAggregate" in plan and "HashAggregate" not in plan
    done = merge(level, 1)
    assert sorted((bytes(r.digest), r.keep.id, r.n, r.run) for r in done.collect()) == [(b"\0", 0, 15, 0), (b"\1", 0, 15, 0), (b"\2", 0, 10, 0)]
    executed = done._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [") == executed.count("Exchange")  # one for each exchange: sorted_run adds none

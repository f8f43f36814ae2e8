import pytest

from docspark.llm import url_filters as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def judge(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS n")
    return {r.page_id: r for r in uf.url_filter(df, RULES, **more).collect()}


def test_rules(spark):
    cases = [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://x.net/a#b", "x.net", "/a", "net/", "block"),
        ("http://x.net", "x.net", "", None, "block"), ("http://planet/", "planet", "/", None, "allow"), ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
        ("ftp://u?://b/c", "u", "", None, "allow"), ("no host", "", "", None, "allow"), (None, "", "", None, "allow"), ("a\n://É.org/x", "É.org", "/x", None, "allow"),
        ("http://www.example.com/de/x", "www.example.com", "/de/x", "example.com/de/", "block"),
    ]  # the bare http://x.net fits no rule, but x.net's other pages are blocked
    cases += [("https://x.net/b", "x.net", "/b", "net/", "block")] * 2
    got = judge(spark, [(i, c[0], None) for i, c in enumerate(cases)])
    assert [(r.host, r.path, r.rule, r.verdict) for r in (got[i] for i in range(len(cases)))] == [c[1:] for c in cases]


def brute(edges, seeds, damping=0.85, rounds=12):
    nodes = list(seeds)
    t, d = ({n: seeds[n][k] for n in nodes} for k in (0, 1))
    for _ in range(rounds):
        t2, d2 = ({n: 0.0 for n in nodes} for _ in (0, 1))
        for rank, new, k, flip in ((t, t2, 0, False), (d, d2, 1, True)):
            out = {}
            for a, b, w in edges:
                a, b = (b, a) if flip else (a, b)
                out[a] = out.get(a, 0) + w
            lost = sum(rank[n] for n in nodes if n not in out)
            for a, b, w in edges:
                a, b = (b, a) if flip else (a, b)
                new[b] += rank[a] * w / out[a]
            for n in nodes:
                new[n] = damping * (new[n] + lost * seeds[n][k]) + (1 - damping) * seeds[n][k]
        t, d = t2, d2
    return t, d


def test_propagation_equals_brute_force(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "x", 3.0), ("e", "d", 1.0), ("e", "a", 1.0)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.0), "d": (0.0, 0.0), "e": (0.0, 0.0), "x": (0.0, 1.0)}
    got = uf.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, trust double, distrust double"), rounds=12)
    t, d = brute(edges, seeds)
    for r in got.collect():
        assert r.trust == pytest.approx(t[r.host], abs=1e-4) and r.distrust == pytest.approx(d[r.host], abs=1e-4)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/">' for x in h)
    rows = [(1, "http://bad.net/a", ""), (2, "http://farm.com/a", link("bad.net")), (3, "http://good.org/fr/a", link("friend.com")), (4, "http://friend.com/a", "<a href='/own'>"), (5, "http://alone.com/", None)]
    got = judge(spark, rows)
    assert [got[i].verdict for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "http://x.net/", None)] * 3 + [(None, None, None)], "page_id long, url string, html string")
    assert uf.url_filter(df).count() == 4
    assert uf.url_filter(df.limit(0)).count() == 0


def test_long_chain_is_followed_to_its_end(spark):
    """h23 -> ... -> h1 -> a blocked host: h23 is further from it than 20 rounds reach."""
    rows = [(0, "http://h0.net/a", "")] + [(i, f"http://h{i}.com/a", f'<a href="http://h{i - 1}.{"net" if i == 1 else "com"}/">') for i in range(1, 24)]
    rows += [(100 + i, f"http://alone{i}.com/a", None) for i in range(30)]
    got = judge(spark, rows)
    assert {got[i].verdict for i in range(24)} == {"block"} and {got[100 + i].verdict for i in range(30)} == {"allow"}


def test_query_over_a_table_with_links(spark, tmp_path):
    """The registered query on pages whose links cross hosts, among them a hub, against the rules and ranks in plain Python."""
    import random

    from docspark.llm import registry

    random.seed(3)
    hosts = [f"bad{i}.net" for i in range(6)] + [f"good{i}.org" for i in range(6)] + [f"h{i}.com" for i in range(40)]
    rows, links = [], {}
    for k, host in enumerate(hosts):
        for j in range(3):
            to = random.sample(hosts[:12] if k % 3 else hosts[12:], 2) + (["h0.com"] if k % 2 else [])
            rows.append((len(rows), f"http://{host}/{'fr' if host.endswith('org') else 'x'}/{j}", "".join(f"<a href='//{x.upper()}/{j}'>" for x in to)))
            for x in set(to) - {host}:
                links[host, x] = links.get((host, x), 0) + 1.0
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seeds = {h: ((1 / 6) * h.endswith(".org"), (1 / 6) * h.endswith(".net")) for h in hosts}
    t, d = brute([(*k, w) for k, w in links.items()], seeds, rounds=150)
    want = {h: "block" if d[h] >= 0.1 / len(hosts) and d[h] > 0.5 * (t[h] + d[h]) else "allow" for h in hosts}
    want |= {h: "block" for h in hosts[:6]} | {h: "allow" for h in hosts[6:12]}
    got = registry.queries()["op10_url_filter"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.verdict == want[r.host] for r in got)
    assert 3 < sum(want[h] == "block" for h in hosts[12:]) < 37

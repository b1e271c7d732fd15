"""URL rules and trust over links, against a plain implementation."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from wakeline.llm import queries, urlgraph

from tests.compare import check

SCHEMA = "page_id long, url string, html string, host string"


def pages(spark, data):
    return spark.createDataFrame([(*x, "clash") for x in data], SCHEMA)


def judged(spark, data):
    return {r.page_id: r for r in urlgraph.judge(pages(spark, data)).collect()}


def test_rules_hosts_and_paths(spark):
    got = judged(spark, [
        (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://example.net/de", None), (3, "http://notexample.com/de/", ""), (4, "http://example.com/de/1", ""), (5, "http://www.x.org/fr/", ""),
        (6, "http://net", ""), (7, None, None), (8, "no scheme", ""), (9, "http://h.net?x=/en/", ""), (10, "x://B.org#/fr/", ""),
    ])
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de", "net/", "block"), 3: ("notexample.com", "/de/", None, "allow"), 4: ("example.com", "/de/1", "example.com/de/", "block"),
        5: ("www.x.org", "/fr/", "org/fr/", "allow"), 6: ("net", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("h.net", "", None, "allow"), 10: ("b.org", "", None, "allow"),
    }


def brute(seeds, edges, damping=0.85, rounds=20):
    out = {}
    for kind, flip in (("trust", False), ("distrust", True)):
        links = [(b, a, n) if flip else (a, b, n) for a, b, n in edges]
        total = {}
        for a, _, n in links:
            total[a] = total.get(a, 0) + n
        seed = {h: (1 - damping) * s[flip] for h, s in seeds.items() if s[flip]}
        score = dict(seed)
        for _ in range(rounds):
            new = dict(seed)
            for a, b, n in links:
                if a in score:
                    new[b] = new.get(b, 0) + damping * score[a] * n / total[a]
            score = new
        for h, s in score.items():
            out.setdefault(h, [0.0, 0.0])[flip] = s
    return out


def test_propagation_matches_brute_force(spark):
    seeds = {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.25, 0.5), "d": (0.0, 0.0)}
    edges = [("a", "d", 3), ("a", "e", 1), ("d", "b", 2), ("e", "a", 1), ("f", "b", 5), ("g", "f", 1), ("f", "g", 1)]
    got = urlgraph.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long"), tolerance=0)
    want = brute(seeds, edges)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(x, y, abs_tol=1e-12) for h in want for x, y in zip(found[h], want[h], strict=True))


def test_links_carry_verdicts(spark):
    bad = '<a href="http://spam.net/1">x</a> <a HREF=//spam.net/2>y</a>'
    data = [(1, "http://spam.net/", ""), (2, "http://friend.io/", bad), (3, "http://far.io/", '<a class=q href="https://friend.io/">z</a>'), (4, "http://good.org/fr/", '<a href="http://fine.io/">f</a> <a href="/local">l</a>'), (5, "http://fine.io/", ""), (6, "http://lone.io/", "")]
    got = judged(spark, data)
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    assert got[5].trust > 0 and got[6].trust is None


def test_empty_and_repeated(spark):
    assert urlgraph.judge(pages(spark, [])).count() == 0
    assert urlgraph.judge(pages(spark, [(1, "http://a.net/", "")] * 3)).count() == 3


def settled(spark, seeds, edges):
    seeds = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = urlgraph.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n long"), rounds=None)
    return {r.host: (r.trust, r.distrust) for r in got.collect()}


def test_cycle_is_the_linear_systems_solution(spark):
    # x = 0.15 s + 0.85 A x, where a and b give all to each other and c gives a quarter to a
    names, d = ["a", "b", "c", "d"], 0.85
    edges = [("a", "b", 2), ("b", "a", 1), ("c", "a", 1), ("c", "d", 3)]
    flow = np.zeros((4, 4))
    flow[1, 0] = flow[0, 1] = 1
    flow[0, 2], flow[3, 2] = 0.25, 0.75
    back = np.zeros((4, 4))
    back[0, 1] = back[2, 3] = 1
    back[1, 0] = 0.5
    back[2, 0] = 0.5
    trust = np.linalg.solve(np.eye(4) - d * flow, 0.15 * np.array([1, 0, 0.5, 0]))
    distrust = np.linalg.solve(np.eye(4) - d * back, 0.15 * np.array([0, 1, 0, 0.25]))
    got = settled(spark, {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.5, 0.0), "d": (0.0, 0.25)}, edges)
    for k, h in enumerate(names):
        assert math.isclose(got[h][0], trust[k], abs_tol=2e-5) and math.isclose(got[h][1], distrust[k], abs_tol=2e-5), h


def test_scores_reach_hosts_beyond_twenty_links(spark):
    edges = [(f"h{k:02}", f"h{k + 1:02}", 1) for k in range(40)]
    got = settled(spark, {"h00": (1.0, 0.0)}, edges)
    assert math.isclose(got["h30"][0], 0.15 * 0.85**30, rel_tol=1e-3)


def test_a_walk_that_never_settles_raises(spark, monkeypatch):
    monkeypatch.setattr(urlgraph, "MOST_ROUNDS", 10)
    with pytest.raises(RuntimeError, match="still move"):
        settled(spark, {"a": (1.0, 0.0)}, [("a", "b", 1), ("b", "a", 1)])


def test_sql_on_a_made_graph(spark, tmp_path):
    r = random.Random(4)
    hosts = [f"h{k}.{r.choice(['net', 'org', 'com', 'io'])}" for k in range(12)]
    link = lambda: f'<a href="http://{r.choice(hosts)}/x">l</a>'
    rows = [(k, f"http://{r.choice(hosts)}/{r.choice(['fr/', 'en/', ''])}", "".join(link() for _ in range(r.randrange(4)))) for k in range(60)]
    pq.write_table(spark.createDataFrame(rows, "page_id long, url string, html string").toArrow(), tmp_path / "pages.parquet")
    assert check(spark, str(tmp_path), queries.op6_url_filter, queries.OP6_SQL) == 60

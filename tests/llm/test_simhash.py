"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import xxhash
from wakeline.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string, h string, source string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, size=4):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, near):
    """node -> least node reachable."""
    left, out = set(nodes), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        group = []
        while todo:
            at = todo.pop()
            group.append(at)
            found = {x for x in left if near(at, x)}
            left -= found
            todo += found
        for x in group:
            out[x] = min(group)
    return out


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.choice([1, 3, 4, 30, 300]))]
        rows.append((i * 2, " ".join(text)))
        for k in range(r.choice([0, 0, 1, 3])):
            near = list(text)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = r.choice(words)
            rows.append((1000 + 10 * i + k, r.choice([" ", "\t", "\x0b \n"]).join(near).title()))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "ÄB ab \x1c cd e f"), (5, "same text here again ok"), (7, "same text here again ok")]


def test_components_match_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: x for i, (x, _) in got.items()} == fp
    assert {i: c for i, (_, c) in got.items()} == grouped(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)


def test_links_of_random_fingerprints_at_every_distance(spark):
    r = random.Random(2)
    nodes = set()
    for _ in range(60):
        x = r.getrandbits(64)
        nodes.add(x)
        for _ in range(4):
            y = x
            for b in r.sample(range(64), r.randint(1, 6)):
                y ^= 1 << b
            nodes.add(y)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    edges = {(e.a & (2**64 - 1), e.b & (2**64 - 1)) for e in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    want = grouped(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    near = {x: set() for x in nodes}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    assert grouped(nodes, lambda a, b: b in near[a]) == want


def test_every_pattern_of_up_to_four_bits_shares_a_key():
    """Each differing set of up to four bits leaves some kept mask untouched."""
    masks = [int(m) for m in simhash.MASKS]
    r = random.Random(3)
    for _ in range(20_000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not m & d for m in masks)


def test_null_id_names_no_component(spark):
    df = spark.createDataFrame([(None, "a b c d e", "", "", ""), (9, "a b c d e", "", "", ""), (9, "a b c d e", "", "", "")], SCHEMA)
    assert [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).orderBy("doc_id").collect()] == [(None, 9), (9, 9), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(300)]
    df = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    root = {r.node: r.root for r in graph.components(df).collect()}
    assert len({root[k] for k in range(301)}) == 1 and len({root[k] for k in range(1000, 1301)}) == 1 and root[0] != root[1000]


def jaccard(a, b, size=5):
    g = lambda t: {tuple(w[i : i + size]) for w in [t.split()] for i in range(max(1, len(w) - size + 1))}
    x, y = g(a), g(b)
    return len(x & y) / len(x | y)


def test_one_of_each(spark):
    """Near copies well above 0.8 go, texts well below stay, copies leave the smallest id."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    rows, groups, alone = [], [], []
    for i in range(60):
        text = [r.choice(words) for _ in range(300)]
        own = [(i * 10, " ".join(text))]
        for k in range(1, 4):
            near = list(text)
            for _ in range(2):
                near[r.randrange(300)] = "zz"
            own.append((i * 10 + k, " ".join(near)))
        far = list(text)
        for p in range(0, 300, 9):
            far[p] = f"q{i}{p}"
        alone.append((i * 10 + 5, " ".join(far)))
        groups.append(own)
        rows += own + alone[-1:]
    assert all(jaccard(g[0][1], x[1]) > 0.9 for g in groups for x in g[1:]) and all(jaccard(g[0][1], a[1]) < 0.5 for g, a in zip(groups, alone, strict=True))
    rows += [(5000, "copy of a short text"), (5001, "copy of a short text"), (5001, "copy of a short text"), (5002, None), (5003, None), (None, "only null id")]
    df = spark.createDataFrame([(i, t, "f", "h", "s") for i, t in rows], SCHEMA)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([g[0][0] for g in groups] + [a[0] for a in alone] + [5000, 5002, None], key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_ones_counts_bits_of_many_hashes():
    h = np.random.default_rng(1).integers(0, 2**64, 255 * 300 + 17, dtype=np.uint64)
    want = [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.ones(h).tolist() == want and simhash.ones(h[:3]).sum() == sum(int(x).bit_count() for x in h[:3])


def test_met_pairs_match_all_pairs():
    """Every pair whose segments on some lane differ in at most one bit and whose checks are close is connected, and no other."""
    r = np.random.default_rng(7)
    base = r.integers(0, 2**64, (12, 9), dtype=np.uint64)
    rows = []
    for x in base:
        for _ in range(25):
            y = x.copy()
            for lane in range(9):
                for b in r.choice(64, r.integers(0, 14), replace=False):
                    y[lane] ^= np.uint64(1) << np.uint64(b)
            rows.append(y)
    rows += [base[0]] * 15
    every = np.array(rows)
    node = r.permutation(len(every)) * 3 - 100
    most = 30

    def segment_bits(i, j):
        return min(bin((int(every[i, lane]) ^ int(every[j, lane])) >> a & ((1 << (z - a)) - 1)).count("1") for lane in range(6) for a, z in simhash.SEGMENTS)

    near = {int(x): set() for x in node}
    for i in range(len(every)):
        for j in range(i):
            if int(np.bitwise_count(every[i, 6:] ^ every[j, 6:]).sum()) <= most and segment_bits(i, j) <= 1:
                near[int(node[i])].add(int(node[j])), near[int(node[j])].add(int(node[i]))
    want = grouped([int(x) for x in node], lambda a, b: b in near[a])
    segs, routes, places = [], [], []
    for k, (lane, s, _) in enumerate(simhash.ROUTES):
        a, z = simhash.SEGMENTS[s]
        segs.append((every[:, lane] >> np.uint64(a) & np.uint64((1 << (z - a)) - 1)).astype(np.uint32))
        routes.append(np.full(len(every), k, np.uint8)), places.append(np.arange(len(every)))
    at = np.concatenate(places)
    edges = simhash.met_pairs(np.concatenate(segs), np.concatenate(routes), node[at], every[at, 6:], most)
    linked = {x: set() for x in near}
    for a, b in edges.tolist():
        linked[a].add(b), linked[b].add(a)
    assert grouped([int(x) for x in node], lambda a, b: b in linked[a]) == want and len(edges) == len(near) - len(set(want.values())) and len(set(want.values())) > 1


def test_routes_reach_every_variant():
    """Each single bit of each segment is left out by exactly one route, whose kept bits do not hold it."""
    for lane in range(simhash.LANES):
        for s, (a, z) in enumerate(simhash.SEGMENTS):
            found = [int(b) for k, (x, y, kept) in enumerate(simhash.ROUTES) if (x, y) == (lane, s) for b in simhash.LEFT_OUT[k] if b and not int(b) & kept]
            assert sorted(found) == [1 << i for i in range(z - a)]


def test_one_of_each_is_an_exact_join_at_the_threshold(spark):
    """Pairs close to 0.8 on both sides, of long and short texts: groups are those of all pairs by exact Jaccard."""
    r = random.Random(12)
    rows = []
    for i in range(150):
        n = r.choice([5, 6, 9, 14, 40, 120, 204])
        text = [f"v{r.randrange(10**6)}" for _ in range(n)]
        rows.append((10 * i, " ".join(text)))
        cut_ = round(0.8 * (n - 4)) + 4  # all but a tail of the shingles: about 0.8, on either side
        for k, keep in enumerate((cut_ - 1, cut_, cut_ + 1, round(0.75 * (n - 4)) + 4)):
            if 5 <= keep < n:
                rows.append((10 * i + 1 + k, " ".join(text[n - keep :] if k % 2 else text[:keep])))
    text = dict(rows)
    sims = {(a, b): jaccard(text[a], text[b]) for a in text for b in text if a // 10 == b // 10}
    assert sum(0.8 <= s < 0.85 for s in sims.values()) > 50 < sum(0.7 < s < 0.8 for s in sims.values())
    want = set(grouped(text, lambda a, b: sims.get((a, b), 0) >= 0.8).values())
    df = spark.createDataFrame([(i, t, "f", "h", "s") for i, t in rows], SCHEMA)
    assert {x.doc_id for x in simhash.one_of_each(df).collect()} == want


def test_components_of_contracted_graphs(spark, monkeypatch):
    """Contraction down to what one task may take leaves the same groups as that task alone."""
    r = random.Random(8)
    edges = [(r.randrange(2000), r.randrange(2000)) for _ in range(1200)] + [(3000 + k, 3001 + k) for k in range(100)]
    df = spark.createDataFrame(edges, "a long, b long")
    groups = []
    for bound in (1 << 20, 40, 0):
        monkeypatch.setattr(graph, "AT_ONCE", bound)
        by = {}
        for x in graph.components(df).collect():
            by.setdefault(x.root, set()).add(x.node)
        groups.append(sorted(map(sorted, by.values())))
    linked = {x: set() for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b:
            linked[a].add(b), linked[b].add(a)
    root = grouped(sorted(linked), lambda a, b: b in linked[a])
    want = {}
    for x, y in root.items():
        want.setdefault(y, []).append(x)
    assert groups[0] == groups[1] == groups[2] == sorted(map(sorted, want.values()))


def test_large_groups_are_cut_in_blocks(spark, monkeypatch):
    """Families of texts just above and just below 0.8, compared in many blocks, leave the groups of all pairs."""
    monkeypatch.setattr(simhash, "MEET", 8)
    r = random.Random(21)
    rows = []
    for f in range(3):
        base = [f"b{f}x{k}" for k in range(120)]
        for i in range(30):
            text = list(base)
            for p in r.sample(range(0, 115, 5), r.choice([1, 2, 3, 4])):
                text[p] = f"e{r.randrange(40)}"
            rows.append((100 * f + i, " ".join(text)))
    text = dict(rows)
    want = set(grouped(text, lambda a, b: a // 100 == b // 100 and jaccard(text[a], text[b]) >= 0.8).values())
    df = spark.createDataFrame([(i, t, "f", "h", "s") for i, t in rows], SCHEMA)
    assert {x.doc_id for x in simhash.one_of_each(df).collect()} == want and 3 < len(want) < 90

"""Pairs compared block against block: small blocks give what SQL and plain Python give."""

import random

import pytest

from loomgraph import queries as Q
from loomgraph.operators import adaptive, pairs
from tests.oracle import compare

SCHEMA = "campaign string, name string, ord long, fp array<int>"


@pytest.mark.parametrize("name", ["d04_f01_prefilter", "f04_gap_rank", "d03_similarities_by_index", "d05_reconnect_pairs", "f02_adaptive_seed", "d03_similarities"])
def test_queries_over_many_blocks(spark, data, monkeypatch, name):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    compare(spark, data, Q.QUERIES[name], Q.SQL[name])


@pytest.fixture()
def vertices():
    """Two campaigns with copies, empty and missing fingerprints, repeated members, places that two share."""
    draw = random.Random(5)
    out = []
    for c in ("x", "y"):
        for k in range(40):
            fp = None if k == 7 else [] if k in (3, 9) else [1, 1, 900] if k % 10 == 0 else [draw.randrange(12) for _ in range(draw.randrange(1, 9))]
            out.append((c, f"n{(k * 7) % 40:02d}", 5 if k == 6 else k, fp))
    return out + [("z", "alone", 0, [1]), (None, "a", 0, [1]), (None, "b", 1, [1])]


def plain(vertices):
    """{campaign: {(source, target): sim}} of all unordered pairs."""
    out = {}
    for c, n, o, f in vertices:
        for d, m, p, g in vertices:
            if c is not None and c == d and o < p:
                a, b = set(f or ()), set(g or ())
                out.setdefault(c, {})[n, m] = len(a & b) / len(a | b) if a and b else 0.0
    return out


def first(sims, k, tie):
    """The first k pairs of every end; ``tie`` orders equal ones by (own, source, target)."""
    kept = set()
    for own in {x for p in sims for x in p}:
        kept |= set(sorted((p for p in sims if own in p), key=lambda p: (-sims[p], tie(own, *p)))[:k])
    return kept


def by_other(own, s, t):
    return t if own == s else s


def rows(df):
    return {(r.campaign, r.source, r.target) for r in df.collect()}


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_pairs(spark, monkeypatch, vertices, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "MEMBERS", 5)
    v = spark.createDataFrame(vertices, SCHEMA)
    near = pairs.nearest(v, 2, 0.6)
    want = {(c, *p) for c, s in plain(vertices).items() for p in first(s, 2, by_other) | {p for p in s if s[p] >= 0.6}}
    assert rows(pairs.prefilter(near, near, 2, 0.6)) == want
    n = near.collect()
    assert len({(r.campaign, r.source, r.target) for r in n}) == len(n)


@pytest.mark.parametrize("block", [7, 1024])
def test_best_open_pairs(spark, monkeypatch, vertices, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    v = spark.createDataFrame(vertices, SCHEMA)
    near = pairs.nearest(v, 2, 0.6)
    got = adaptive.gaps(adaptive.best_open(v, near, 2, 0.6, 9), pairs.prefilter(near, near, 2, 0.6), 9)
    want = set()
    for c, s in plain(vertices).items():
        left = set(s) - first(s, 2, by_other) - {p for p in s if s[p] >= 0.6}
        want |= {(c, *p, k + 1) for k, p in enumerate(sorted(left, key=lambda p: (-s[p], p))[:9])}
    assert {(r.campaign, r.source, r.target, r["rank"]) for r in got.collect()} == want


def test_index_of_rare_and_of_common_members(spark, monkeypatch, vertices):
    """Campaigns whose members are common meet by block, the others by member."""
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rare = [("rare", f"r{k:02d}", k, [k, k + 1]) for k in range(30)]
    got = pairs.set_similarities(spark.createDataFrame(vertices + rare, SCHEMA)).collect()
    want = {(c, min(p), max(p)): x for c, s in plain(vertices + rare).items() for p, x in s.items() if x > 0}
    assert {(r.campaign, r.u, r.v): pytest.approx(r.sim) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [7, 1024])
def test_reconnected_over_blocks(spark, monkeypatch, vertices, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    v = spark.createDataFrame(vertices, SCHEMA)
    near = pairs.nearest(v, 1, 1.0)
    got = pairs.reconnect(pairs.prefilter(near, near, 1, 1.0), pairs.forests(v), v)
    want = set()
    for c, s in plain(vertices).items():
        kept = first(s, 1, by_other) | {p for p in s if s[p] >= 1.0}
        of = {x: {x} for p in s for x in p}
        for p in sorted(s, key=lambda p: (p not in kept, -s[p], min(p), max(p))):
            a, b = of[p[0]], of[p[1]]
            if a is not b:
                a |= b
                of |= dict.fromkeys(b, a)
                if p not in kept:
                    want.add((c, min(p), max(p)))
    assert {(r.campaign, r.u, r.v) for r in got.collect()} == want


@pytest.mark.parametrize("block", [7, 1024])
def test_seed_over_blocks(spark, monkeypatch, vertices, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    v = spark.createDataFrame(vertices, SCHEMA)
    want = {(c, *p) for c, s in plain(vertices).items() for p in first(s, 3, lambda own, s, t: (s, t))}
    assert rows(adaptive.seed(pairs.nearest(v, 3, by_pair=True), 3)) == want


@pytest.mark.parametrize("block", [7, 1024])
def test_all_similarities(spark, monkeypatch, vertices, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    got = pairs.all_similarities(spark.createDataFrame(vertices, SCHEMA)).collect()
    assert {(r.campaign, r.source, r.target): r.sim for r in got} == {(c, *p): x for c, s in plain(vertices).items() for p, x in s.items()}
    assert len(got) == sum(map(len, plain(vertices).values()))

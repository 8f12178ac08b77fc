import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import design as D
from loomgraph.operators import graph as G
from loomgraph.operators import selection as S
from loomgraph.operators.clustering import average_linkage
from loomgraph.plans.options import CostModel, IntermediateOptions, NetworkOptions, PlanError, SoftcorePolicy, pair_of
from loomgraph.plans.planners import plan

#: Four vertices with a known tree of cost 7.
SQUARE = {("H", "F"): 1, ("F", "Cl"): 2, ("H", "Cl"): 3, ("H", "Me"): 4, ("Cl", "Me"): 8, ("F", "Me"): 9}


def tables(spark, costs=SQUARE, names=None, feasible=lambda p: True, charge=lambda n: 0, heavy=10, synthetic=()):
    names = names or list(dict.fromkeys(itertools.chain(*costs)))
    v = spark.createDataFrame([("c", n, i, charge(n), heavy, n in synthetic) for i, n in enumerate(names)], "campaign string, name string, ord long, charge long, n_heavy long, synthetic boolean")
    c = spark.createDataFrame([("c", i, a, b, float(w), bool(feasible((a, b)))) for i, ((a, b), w) in enumerate(costs.items())], "campaign string, cand_ord long, source string, target string, total double, feasible boolean")
    return v, c


def edges(p):
    return {(r.u, r.v) for r in p.selected.collect()}


def messages(p):
    return [r.message for r in p.unmet.orderBy("seq").collect()]


def test_spanning_tree(spark):
    p = plan(*tables(spark), NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0))
    assert edges(p) == {("F", "H"), ("Cl", "F"), ("H", "Me")}
    assert sum(r.total for r in p.selected.collect()) == 7


def test_redundancy_reaches_targets(spark):
    v, c = tables(spark)
    p = plan(v, c, NetworkOptions())
    assert min(r.degree for r in G.degrees(v, p.selected).collect()) >= 2
    assert all(r.on_cycle for r in G.on_cycle(v, p.selected).collect())
    assert messages(p) == []


def test_budget_is_hard_and_caps_redundancy(spark):
    with pytest.raises(Exception, match="cannot span"):
        plan(*tables(spark), NetworkOptions(n_edges=2)).selected.collect()
    p = plan(*tables(spark), NetworkOptions(n_edges=3))
    assert len(edges(p)) == 3
    assert any(m.startswith("edges_per_ligand=2 unmet for 2 ligand(s): ['Cl', 'Me']") for m in messages(p))


def test_forced_and_banned(spark):
    p = plan(*tables(spark), NetworkOptions(forced_edges=("F~Me",), banned_edges=("H~F",), edges_per_ligand=1, min_cycle_coverage=0))
    assert ("F", "Me") in edges(p) and ("F", "H") not in edges(p)
    with pytest.raises(ValueError, match="both forced and banned"):
        NetworkOptions(forced_edges=("a~b",), banned_edges=("b~a",))
    with pytest.raises(Exception, match="not feasible"):
        plan(*tables(spark, feasible=lambda x: x != ("F", "Me")), NetworkOptions(forced_edges=("F~Me",))).selected.collect()


def test_disconnected_pool(spark):
    costs = {("a", "b"): 1, ("c", "d"): 1, ("b", "c"): 5}
    v, c = tables(spark, costs, feasible=lambda x: x != ("b", "c"))
    with pytest.raises(Exception, match="2 components"):
        plan(v, c).selected.collect()
    p = plan(v, c, NetworkOptions(require_connected=False))
    assert edges(p) == {("a", "b"), ("c", "d")} and "network is disconnected (2 components)" in messages(p)
    bridged = plan(v, c, NetworkOptions(cbfe_mode="bridge")).selected.collect()
    assert [r.kind for r in bridged].count("cbfe") == 1
    assert {r.total for r in bridged if r.kind == "cbfe"} == {9.0}  # 8 + 0.05 * 20


def test_cbfe_knobs(spark):
    v, c = tables(spark)
    assert {r.kind for r in plan(v, c, NetworkOptions(cbfe_mode="all")).selected.collect()} == {"cbfe"}
    with pytest.raises(PlanError, match="no counterpoised"):
        plan(v, c, NetworkOptions(cbfe_mode="bridge"), "star")
    with pytest.raises(PlanError, match="no design"):
        plan(v, c, NetworkOptions(design="a_optimal"))


def test_star_explicit_complete(spark):
    v, c = tables(spark)
    assert edges(plan(v, c, NetworkOptions(), "star")) == {("F", "H"), ("Cl", "H"), ("H", "Me")}
    assert edges(plan(v, c, NetworkOptions(explicit_pairs=("Me~Cl",), require_connected=False), "explicit")) == {("Cl", "Me")}
    assert plan(v, c, NetworkOptions(explicit_pairs=("Me~Cl",)), "explicit").selected.first().source == "Me"
    p = plan(v, c, NetworkOptions(n_edges=4), "complete")
    assert len(edges(p)) == 4 and messages(p) == ["n_edges=4 truncated 6 feasible edges"]
    with pytest.raises(PlanError, match="Me"):
        plan(*tables(spark, feasible=lambda x: x != ("H", "Me")), NetworkOptions(hub="H"), "star")


def test_first_seen_wins_equal_costs(spark):
    v, c = tables(spark, {("a", "b"): 1, ("b", "a"): 1})
    assert plan(v, c, NetworkOptions(), "complete").selected.first().source == "a"


def test_clusters_keep_few_crossings(spark):
    names = [f"n{i}" for i in range(8)]
    costs = {p: 1 + 0.1 * i for i, p in enumerate(itertools.combinations(names, 2))}
    v, c = tables(spark, costs, charge=lambda n: int(n[1]) // 4)
    got = edges(plan(v, c, NetworkOptions(cluster_by="charge")))
    assert sum(int(a[1]) // 4 != int(b[1]) // 4 for a, b in got) == 2


def test_diameter_bound(spark):
    names = [f"n{i}" for i in range(9)]
    costs = {(a, b): abs(int(a[1]) - int(b[1])) for a, b in itertools.combinations(names, 2)}
    v, c = tables(spark, costs)
    loose = plan(v, c, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0))
    tight = plan(v, c, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0, max_diameter=4))
    assert G.diameter(v, loose.selected).first().diameter == 8
    assert G.diameter(v, tight.selected).first().diameter <= 4


def random_pool(n, share, seed):
    r = np.random.default_rng(seed)
    names = [f"v{i:02d}" for i in range(n)]
    return S.Pool.of(names, [(a, b, float(r.random()), False) for a, b in itertools.combinations(names, 2) if r.random() < share])


def slow_bridges(n, a, b):
    base = S.components(n, a, b).max()
    return np.array([S.components(n, np.delete(a, e), np.delete(b, e)).max() > base for e in range(len(a))], bool)


@pytest.mark.parametrize("seed", range(12))
def test_bridges_and_gains_by_brute_force(seed):
    pool = random_pool(11, 0.22, seed)
    n = len(pool.names)
    assert (S.bridges(n, pool.a, pool.b) == slow_bridges(n, pool.a, pool.b)).all()
    half = np.arange(len(pool)) % 2 == 0
    forest = S.BridgeForest(n, pool.a[half], pool.b[half])
    for e in np.flatnonzero(~half):
        path = forest.path(int(pool.a[e]), int(pool.b[e]))
        if path is None:
            continue
        more = half.copy()
        more[e] = True
        a, b = pool.a[more], pool.b[more]
        assert len(path) + 1 == (~slow_bridges(n, a, b)).sum() - (~forest.is_bridge).sum()


@pytest.mark.parametrize("seed", range(6))
def test_distances_after_an_edge(seed):
    pool = random_pool(10, 0.3, seed)
    d = S.distances(10, pool.a[1:], pool.b[1:])
    assert (S.with_edge(d, int(pool.a[0]), int(pool.b[0])) == S.distances(10, pool.a, pool.b)).all()


def test_redundant_trees_share_no_edge(spark):
    names = [f"n{i}" for i in range(6)]
    v, c = tables(spark, {p: i + 1 for i, p in enumerate(itertools.combinations(names, 2))})
    got = plan(v, c, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0, n_redundancy=2), "redundant-mst")
    # the first tree is a star, so the second spans all but its centre
    assert len(edges(got)) == 9


def test_rounds_equal_union_find(spark):
    names = [f"n{i}" for i in range(14)]
    r = np.random.default_rng(5)
    costs = {p: float(r.integers(1, 6)) for p in itertools.combinations(names, 2) if r.random() < 0.3}
    v, c = tables(spark, costs, names=names)
    e = c.selectExpr("campaign", "least(source, target) AS u", "greatest(source, target) AS v", "total AS weight")
    pool = S.Pool.of(sorted(names), [(min(p), max(p), w, False) for p, w in costs.items()])
    want = {tuple(pool.spec(i).split("~")) for i in S.kruskal(pool, [], np.arange(len(pool)))}
    assert {(x.u, x.v) for x in G.spanning_forest(v, e).collect()} == want
    part = S.components(len(names), pool.a, pool.b)
    got = {x.name: x.component for x in G.components(v, e).collect()}
    assert len(set(got.values())) == part.max() + 1


@pytest.mark.parametrize("name", ["a_optimal", "d_optimal"])
@pytest.mark.parametrize("seed", range(4))
def test_greedy_design_near_the_optimum(name, seed):
    r = np.random.default_rng(seed * 31 + 6)
    names = [f"v{i}" for i in range(6)]
    pool = S.Pool.of(names, [(a, b, float(r.uniform(0.3, 4.0)), False) for a, b in itertools.combinations(names, 2)])
    w = 1 / pool.weight**2

    def value(chosen):
        return D.criterion(D.laplacian(6, pool.a[chosen], pool.b[chosen], w[chosen]), name)

    best = min(value(np.isin(np.arange(15), c)) for c in itertools.combinations(range(15), 8))
    chosen = np.zeros(15, bool)
    chosen[S.kruskal(pool, [], np.arange(15))] = True
    D.descend(pool, chosen, np.ones(15, bool), 8, name)
    greedy = value(chosen)
    D.exchange(pool, chosen, np.ones(15, bool), name, set())
    refined = value(chosen)
    assert best - 1e-9 <= refined <= greedy
    gap = greedy / best if name == "a_optimal" else np.exp((greedy - best) / 5)
    assert gap <= 1.10


def test_design_identities():
    n, a, b = 7, np.array([0, 0, 1, 1, 2, 2]), np.array([1, 2, 3, 4, 5, 6])
    sigma = np.array([0.5, 1.0, 1.5, 0.7, 2.0, 1.1])
    fisher = D.laplacian(n, a, b, 1 / sigma**2)
    # a tree: trace by paths, determinant by edges; Foster's sum over any network
    paths = 0.0
    for x, y in itertools.combinations(range(n), 2):
        walk = S.BridgeForest(n, a, b).path(x, y)
        paths += sum(sigma[e] ** 2 for e in walk)
    assert D.criterion(fisher, "a_optimal") == pytest.approx(paths / n)
    assert D.criterion(fisher, "d_optimal") == pytest.approx(-np.log(n) + np.log(sigma**2).sum())
    assert (D.quadratic(D.covariance(fisher), a, b) / sigma**2).sum() == pytest.approx(n - 1)
    assert D.criterion(D.laplacian(3, a[:1], b[:1], np.ones(1)), "a_optimal") == np.inf


def test_effort_returns_the_same_everywhere():
    a, b, sigma = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([1.0, 2.0, 0.5, 1.5])
    t = D.effort(4, a, b, sigma, 10.0)
    assert t.sum() == pytest.approx(10)
    cov = D.covariance(D.laplacian(4, a, b, t / sigma**2))
    gain = D.quadratic(cov @ cov, a, b) / sigma**2
    held = t > 1e-6
    assert gain[held] == pytest.approx(gain[held].mean(), rel=1e-3)
    with pytest.raises(ValueError, match="pieces"):
        D.effort(5, a, b, sigma, 1.0)


def test_optimal_planner(spark):
    names = [f"v{i}" for i in range(6)]
    r = np.random.default_rng(3)
    v, c = tables(spark, {p: float(r.uniform(0.3, 4)) for p in itertools.combinations(names, 2)})
    p = plan(v, c, NetworkOptions(design="a_optimal"), "optimal")
    assert len(edges(p)) == max(5, round(6 * np.log(6)))
    with pytest.raises(Exception, match="design="):
        plan(v, c, NetworkOptions(), "optimal").selected.collect()


def test_average_linkage():
    s = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.8], [0.0, 0.1, 0.8, 1]])
    assert average_linkage(s).tolist() == [0, 0, 2, 2]
    assert len(set(average_linkage(s, clusters=1).tolist())) == 1


def test_options_are_checked():
    for bad in ({"n_edges": 0}, {"edges_per_ligand": 0}, {"min_cycle_coverage": 1.1}, {"max_cycle_size": 2}, {"prefilter": "x"}, {"pair_strategy": "star"}, {"pair_strategy": "explicit"}, {"design_lambda_min": 30}):
        with pytest.raises(ValueError):
            NetworkOptions(**bad)
    for cls, bad in ((SoftcorePolicy, {"max_softcore_fraction": 0}), (IntermediateOptions, {"max_dist": 1}), (CostModel, {"cbfe_multiplier": 0.5})):
        with pytest.raises(ValueError):
            cls(**bad)
    assert pair_of("b~a") == ("a", "b")
    with pytest.raises(ValueError):
        pair_of("a~a")
    with pytest.raises(ValueError, match="pins"):
        NetworkOptions.preset("v0.4", edges_per_ligand=2)
    old = NetworkOptions.preset("v0.4", hub="x")
    assert (old.edges_per_ligand, old.min_cycle_coverage, old.cbfe_base_cost, old.cbfe_atom_weight, old.design_candidate_factor, old.softcore.max_softcore_atoms, old.hub) == (2, 1.0, 8.0, 0.05, 3.0, 12, "x")


def test_count_cycles_against_short_cycles(spark):
    names = [f"n{i}" for i in range(8)]
    r = np.random.default_rng(2)
    costs = {p: 1.0 for p in itertools.combinations(names, 2) if r.random() < 0.5}
    v, c = tables(spark, costs, names=names)
    e = c.selectExpr("campaign", "source AS u", "target AS v")
    assert G.count_cycles(v, e, 4).first().cycles == G.short_cycles(v, e).first().cycles
    full = tables(spark, {p: 1.0 for p in itertools.combinations([f"m{i:02d}" for i in range(16)], 2)})
    assert G.short_cycles(full[0], full[1].selectExpr("campaign", "source AS u", "target AS v")).first().cycles == 6020


def test_closure_errors(spark):
    v = spark.createDataFrame([("c", x) for x in "abc"], "campaign string, name string")
    e = spark.createDataFrame([("c", "a", "b", 1.0), ("c", "b", "c", 2.0), ("c", "a", "c", 2.5)], "campaign string, u string, v string, value double")
    got = G.closure_errors(v, e).collect()
    assert len(got) == 1 and abs(got[0].error) == pytest.approx(0.5) and got[0].size == 3


def test_surgery_and_replan(spark):
    from loomgraph.operators import replan, surgery

    v, c = tables(spark)
    p = plan(v, c, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0)).selected.cache()
    with pytest.raises(PlanError, match="bridge"):
        surgery.delete_edge(v, p, "H~Me")
    with pytest.raises(PlanError, match="not in the network"):
        surgery.delete_edge(v, p, "Cl~Me")
    assert surgery.delete_edge(v, p, "H~Me", must_stay_connected=False).count() == 2
    more, stranded = surgery.cyclize(v, p, c, ["H", "F", "Cl", "Me"])
    assert stranded.count() == 0 and all(r.on_cycle for r in G.on_cycle(v, more).collect())
    lmi = replan.read_lmi(spark, '{"H~F": 1.0, "F~Cl": 9.0, "Me~H": 2.0}')
    high = replan.high_edges(p, lmi, NetworkOptions(), quantile=0.5)
    assert [(r.u, r.v) for r in high.collect()] == [("Cl", "F")]
    new = replan.replan(v, c, p, high, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0))
    assert edges(new) == {("F", "H"), ("H", "Me"), ("Cl", "H")}
    with pytest.raises(ValueError, match="two values"):
        replan.read_lmi(spark, '[{"edge": "a~b", "lmi": 1}, {"edge": "b~a", "lmi": 2}]')


def test_adaptive_agrees_with_eager(spark):
    from loomgraph.operators.adaptive import evaluate_adaptively

    names = [f"n{i}" for i in range(7)]
    costs = {p: float(i % 5 + 1) for i, p in enumerate(itertools.combinations(names, 2))}
    v, c = tables(spark, costs)
    sims = c.selectExpr("campaign", "source", "target", "1 / total AS sim")
    known = c.withColumn("cand_ord", F.lit(0).cast("long"))
    found = evaluate_adaptively(v, sims, lambda p: known.join(p, ["campaign", "source", "target"], "left_semi").select("campaign", "source", "target", "total", "feasible", "cand_ord"), NetworkOptions(adaptive_initial_neighbors=2))
    assert messages(plan(v, found, NetworkOptions())) == []
    assert found.count() <= c.count()


def test_robustness_repeats_and_bounds(spark):
    from loomgraph.operators.diagnostics import failure_robustness

    v, c = tables(spark)
    p = plan(v, c).selected
    one = failure_robustness(v, p, 0.2, 50, 1).first()
    assert one == failure_robustness(v, p, 0.2, 50, 1).first()
    assert failure_robustness(v, p, 0.0, 5, 1).first().connected_fraction == 1.0
    assert failure_robustness(v, p, 1.0, 5, 1).first().mean_retained == 1.0
    assert 0 <= failure_robustness(v, p, 0.2, 20, 1, rng="sequence").first().connected_fraction <= 1


@pytest.mark.parametrize("planner", ["mst", "optimal", "redundant-mst"])
def test_replans_keep_the_budget_and_what_survives(spark, planner):
    from loomgraph.operators import replan

    names = [f"n{i}" for i in range(7)]
    r = np.random.default_rng(9)
    v, c = tables(spark, {p: float(r.uniform(0.5, 4)) for p in itertools.combinations(names, 2)})
    design = {"design": "a_optimal"} if planner == "optimal" else {"edges_per_ligand": 2, "min_cycle_coverage": 0.5, "n_redundancy": 1}
    options = NetworkOptions(n_edges=8, **design)
    first = G.settle(plan(v, c, options, planner).selected)
    had = {(x.u, x.v) for x in first.collect()}
    worst = sorted(had)[0]
    gone = first.where(F.col("u") == worst[0]).where(F.col("v") == worst[1]).select("campaign", "u", "v")
    again = edges(replan.replan(v, c, first, gone, options, planner))
    assert had - {worst} <= again and worst not in again and len(again) <= 8
    star = replan.replan(v, c, first, gone, NetworkOptions(require_connected=False), "complete")
    assert worst not in edges(star) and had - {worst} <= edges(star)


def test_bans_differ_by_campaign(spark):
    v, c = tables(spark)
    both = [x.unionByName(x.withColumn("campaign", F.lit("d"))) for x in (v, c)]
    marks = spark.createDataFrame([("c", "F", "H", "banned"), ("d", "F", "Me", "forced")], "campaign string, u string, v string, mark string")
    got = plan(*both, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0), marks=marks).selected.collect()
    assert {(r.u, r.v) for r in got if r.campaign == "c"} == {("Cl", "F"), ("Cl", "H"), ("H", "Me")}
    assert {(r.u, r.v) for r in got if r.campaign == "d"} == {("F", "Me"), ("F", "H"), ("Cl", "F")}


def test_pins_hold_their_values():
    import dataclasses

    old = NetworkOptions.preset("v0.4")
    pinned = {f.name: getattr(old, f.name) for f in dataclasses.fields(old)}
    assert (pinned["prefilter_k"], pinned["prefilter_min_tanimoto"], pinned["adaptive_batch_size"], pinned["cluster_bridges"], pinned["n_redundancy"]) == (8, 0.4, 32, 2, 2)
    assert (old.softcore.max_softcore_fraction, old.softcore.min_core_atoms, old.softcore.min_mcs_fraction, old.softcore.core_rmsd_threshold) == (0.6, 4, 0.35, 2.0)
    assert (old.intermediates.seed, old.intermediates.min_link_score, old.intermediates.max_dist, old.intermediates.beta) == (0xF00D, 0.2, 3, 0.1)
    from loomgraph.plans import options as O

    assert set(O.COMPAT_PINS["v0.4"]) | O.COMPAT_FREE | {"compat"} == set(pinned)


def test_long_ways(spark):
    """Chains longer than any number of rounds that was once a limit."""
    names = [f"n{i:03d}" for i in range(81)]
    v, c = tables(spark, {(a, b): 1.0 for a, b in zip(names[:-1], names[1:], strict=True)})
    e = c.selectExpr("campaign", "source AS u", "target AS v", "total AS weight")
    assert G.spanning_forest(v, e).count() == 80
    hops = G.hop_counts(v, e)
    assert hops.count() == 81 * 80 // 2 and hops.agg(F.max("hops")).first()[0] == 80


@pytest.mark.parametrize("seed", range(6))
def test_joined_groups_by_their_rule(seed):
    r = np.random.default_rng(seed)
    n = 14
    group = r.integers(0, 5, n)
    ends = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
    a, b = (np.array(x) for x in zip(*ends, strict=True))
    cost, merit = r.integers(1, 5, len(a)).astype(float), r.integers(0, 4, len(a)).astype(float)
    got = S.join_groups(group, a, b, cost, merit, 2)
    order = sorted((e for e in range(len(a)) if group[a[e]] != group[b[e]]), key=lambda e: (-merit[e], cost[e], a[e], b[e]))
    by_pair = {}
    for e in order:
        by_pair.setdefault(frozenset((group[a[e]], group[b[e]])), []).append(e)
    forest, want = S.Forest(set(group.tolist())), set()
    for pair in sorted(by_pair, key=lambda p: order.index(by_pair[p][0])):
        if forest.join(*sorted(int(x) for x in pair)):
            want |= set(by_pair[pair][:2])
    assert set(got) == want


def test_shares_come_with_their_certificate():
    r = np.random.default_rng(4)
    ends = list(itertools.combinations(range(8), 2))
    a, b = (np.array(x) for x in zip(*ends, strict=True))
    sigma = r.uniform(0.3, 3.0, len(a))
    t = D.effort(8, a, b, sigma, 5.0)
    best = D.criterion(D.laplacian(8, a, b, t / sigma**2), "a_optimal")
    assert -1e-9 <= D.gap(8, a, b, sigma, t) < 1e-3
    for _ in range(200):  # no other shares do better by more than the certificate says
        other = np.clip(t + r.normal(0, 0.02, len(t)), 1e-12, None)
        other *= 5.0 / other.sum()
        assert D.criterion(D.laplacian(8, a, b, other / sigma**2), "a_optimal") >= best * (1 - D.gap(8, a, b, sigma, t)) - 1e-12

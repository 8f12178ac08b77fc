"""Planners: from candidate tables to selected edges, for many campaigns at once.

``plan`` takes vertices (campaign, name, ord, charge, n_heavy, synthetic, fp ...) and
candidates (campaign, cand_ord, source, target, total, feasible ...) and returns two tables:
``selected`` (campaign, source, target, u, v, kind, total) and ``unmet`` (campaign, seq,
message). star, explicit and complete are joins, windows and filters. mst, redundant-mst
and optimal choose edge by edge, which is sequential within a campaign and parallel across
campaigns: a cogrouped map per campaign.

Soft targets that can't be met become rows of ``unmet``; what is impossible is an error.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import design as D
from loomgraph.operators import graph as G
from loomgraph.operators import selection as S
from loomgraph.operators.clustering import average_linkage, group_numbers
from loomgraph.operators.dense import network
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import NetworkOptions, PlanError, pair_of

BRIDGE_CENTRALITY = 0.5


@dataclass(frozen=True)
class Plan:
    selected: DataFrame
    unmet: DataFrame

    def settled(self) -> Plan:
        """The plan as written tables: both come from one map, which would run for each use."""
        return Plan(G.settle(self.selected), G.settle(self.unmet))


def best_by_pair(candidates: DataFrame, options: NetworkOptions | None = None) -> DataFrame:
    """The cheapest feasible orientation of every unordered pair, the first seen on ties,
    without banned pairs. Adds u and v."""
    c = candidates.where("feasible").withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    if options and options.banned_pairs:
        c = c.join(c.sparkSession.createDataFrame(sorted(options.banned_pairs), "u string, v string"), ["u", "v"], "left_anti")
    row = Window.partitionBy(KEY, "u", "v").orderBy("total", "cand_ord")
    return c.withColumn("_r", F.row_number().over(row)).where("_r = 1").drop("_r")


def orient(edges: DataFrame, vertices: DataFrame, rule: str) -> DataFrame:
    """Swaps source and target by rule; ties keep what they have."""
    if rule == "lexicographic":
        swap = F.col("source") > F.col("target")
    else:
        if rule == "heavier_second":
            heavy = vertices.select(KEY, "name", "n_heavy")
            for side in ("source", "target"):
                edges = edges.join(heavy.select(KEY, F.col("name").alias(side), F.col("n_heavy").alias(f"_{side}")), [KEY, side])
            swap = F.col("_source") > F.col("_target")
        elif {"n_sc_1", "n_sc_2"} <= set(edges.columns):
            swap = F.col("n_sc_1") > F.col("n_sc_2")
        else:
            return edges
    kept = edges.withColumn("_swap", F.coalesce(swap, F.lit(False)))
    new = {"source": F.when(F.col("_swap"), F.col("target")).otherwise(F.col("source")), "target": F.when(F.col("_swap"), F.col("source")).otherwise(F.col("target"))}
    if {"n_sc_1", "n_sc_2"} <= set(edges.columns):
        new |= {"n_sc_1": F.when(F.col("_swap"), F.col("n_sc_2")).otherwise(F.col("n_sc_1")), "n_sc_2": F.when(F.col("_swap"), F.col("n_sc_1")).otherwise(F.col("n_sc_2"))}
    return kept.withColumns(new).drop("_swap", "_source", "_target")


def _no_messages(vertices: DataFrame) -> DataFrame:
    return vertices.sparkSession.createDataFrame([], f"{KEY} {vertices.schema[KEY].dataType.simpleString()}, seq int, message string")


def pick_hub(vertices: DataFrame, best: DataFrame, rule: str = "most_partners") -> DataFrame:
    """(campaign, hub). most_partners: partners, then summed cost, then name. min_total_cost:
    summed cost, a missing partner at the pool's worst, then partners, then name."""
    ends = best.select(KEY, F.explode(F.array("u", "v")).alias("name"), "total")
    stats = ends.groupBy(KEY, "name").agg(F.count("*").alias("n"), F.sum("total").alias("cost"))
    worst = best.groupBy(KEY).agg(F.max("total").alias("worst"))
    size = Window.partitionBy(KEY)
    v = vertices.select(KEY, "name").withColumn("others", F.count("*").over(size) - 1).join(stats, [KEY, "name"], "left").join(worst, KEY, "left").fillna(0, ["n", "cost", "worst"])
    if rule == "most_partners":
        rank = F.struct(-F.col("n"), F.col("cost"), F.col("name"))
    else:
        rank = F.struct(F.col("cost") + F.col("worst") * (F.col("others") - F.col("n")), -F.col("n"), F.col("name"))
    return v.groupBy(KEY).agg(F.min_by("name", rank).alias("hub"))


def plan_star(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions) -> Plan:
    best = best_by_pair(candidates, options)
    hubs = vertices.select(KEY).distinct().withColumn("hub", F.lit(options.hub)) if options.hub else pick_hub(vertices, best, options.hub_selection)
    selected = best.join(hubs, KEY).where((F.col("u") == F.col("hub")) | (F.col("v") == F.col("hub")))
    reached = selected.select(KEY, F.when(F.col("u") == F.col("hub"), F.col("v")).otherwise(F.col("u")).alias("name"))
    missing = vertices.select(KEY, "name").join(hubs, KEY).where("name <> hub").join(reached, [KEY, "name"], "left_anti")
    lost = missing.groupBy(KEY, "hub").agg(F.array_sort(F.collect_list("name")).alias("names"))
    # fixed form: how a list of names is written in messages
    unmet = lost.select(KEY, F.lit(0).alias("seq"), F.concat(F.lit("no feasible edge from hub '"), "hub", F.lit("' to ['"), F.array_join("names", "', '"), F.lit("']")).alias("message"))
    if options.require_connected and (bad := unmet.limit(1).collect()):
        raise PlanError(bad[0].message)
    return Plan(_selected(selected.drop("hub")), unmet)


def plan_explicit(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions) -> Plan:
    if not options.explicit_pairs:
        raise PlanError("the explicit planner needs explicit_pairs")
    best = best_by_pair(candidates)
    asked = [(i, *spec.split("~"), *pair_of(spec)) for i, spec in enumerate(options.explicit_pairs)]
    listed = vertices.sparkSession.createDataFrame(asked, "i int, source string, target string, u string, v string")
    found = best.drop("source", "target").join(listed, ["u", "v"])
    lost = vertices.select(KEY).distinct().crossJoin(listed.select("i", "u", "v")).join(found, [KEY, "u", "v"], "left_anti").limit(5).collect()
    if lost:
        raise PlanError(f"edges asked for but not feasible: {[f'{r.u}~{r.v}' for r in lost]}")
    return Plan(_selected(found), _no_messages(vertices))


def plan_complete(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions) -> Plan:
    best = best_by_pair(candidates, options)
    if options.n_edges is None:
        return Plan(_selected(best), _no_messages(vertices))
    row = Window.partitionBy(KEY).orderBy("total", "u", "v")
    ranked = best.withColumns({"_r": F.row_number().over(row), "_n": F.count("*").over(Window.partitionBy(KEY))})
    cut = ranked.groupBy(KEY).agg(F.max("_n").alias("n")).where(F.col("n") > options.n_edges)
    unmet = cut.select(KEY, F.lit(0).alias("seq"), F.concat(F.lit(f"n_edges={options.n_edges} truncated "), F.col("n").cast("string"), F.lit(" feasible edges")).alias("message"))
    return Plan(_selected(ranked.where(F.col("_r") <= options.n_edges)), unmet)


def _selected(edges: DataFrame) -> DataFrame:
    kind = F.col("kind") if "kind" in edges.columns else F.lit("rbfe")
    return edges.select(KEY, "source", "target", "u", "v", kind.alias("kind"), F.col("total").cast("double").alias("total"))


# ---------------------------------------------------------------- planners in grouped maps


def _cost_cbfe(v: pd.DataFrame, i: int, j: int, options: NetworkOptions) -> float:
    heavy = v.n_heavy.to_numpy()
    return options.cbfe_base_cost + options.cbfe_atom_weight * float(heavy[i] + heavy[j])


class _Campaign:
    """One campaign's tables in numbers, and the messages that its planning leaves."""

    def __init__(self, vertices: pd.DataFrame, edges: pd.DataFrame, options: NetworkOptions) -> None:
        self.v = vertices.sort_values("name").reset_index(drop=True)
        self.names = self.v.name.tolist()
        self.number = {x: i for i, x in enumerate(self.names)}
        self.options = options
        self.n = len(self.names)
        self.unmet: list[str] = []
        marked = edges[edges["mark"] != ""]
        edges = edges[edges["mark"] != "banned"]
        self.forced = options.forced_pairs | {(r.u, r.v) for r in marked.itertuples() if r.mark == "forced"}
        self.banned = options.banned_pairs | {(r.u, r.v) for r in marked.itertuples() if r.mark == "banned"}
        self.rows = {(r.u, r.v): r for r in edges.itertuples()}
        self.pool_edges: list[tuple[str, str, float, bool]] = [(u, v, r.total, False) for (u, v), r in self.rows.items()]
        self.synthetic = self.v.synthetic.fillna(False).to_numpy(bool) if "synthetic" in self.v else np.zeros(self.n, bool)
        options.check_budget(self.n)

    def similarity(self, i: int, j: int) -> float:
        if "fp" not in self.v:
            return 0.0
        x, y = set(self.v.fp[i] if self.v.fp[i] is not None else ()), set(self.v.fp[j] if self.v.fp[j] is not None else ())
        return len(x & y) / len(x | y) if x | y else 0.0

    def merit(self, pool: S.Pool, at: np.ndarray, group: np.ndarray, graph: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        central = S.centrality(self.n, *graph, group)
        sims = np.array([self.similarity(int(pool.a[e]), int(pool.b[e])) for e in at])
        return sims + BRIDGE_CENTRALITY * 0.5 * (central[pool.a[at]] + central[pool.b[at]])

    def clusters(self) -> np.ndarray:
        """A group number for each vertex, by the option's rule; groups are numbered by their
        first names."""
        how = self.options.cluster_by
        if how == "fingerprint":
            return group_numbers(average_linkage(np.array([[self.similarity(i, j) for j in range(self.n)] for i in range(self.n)])).tolist(), self.names)
        return group_numbers(self.v["charge" if how == "charge" else "scaffold"].tolist(), self.names)

    def connected(self, a: np.ndarray, b: np.ndarray) -> bool:
        return self.n < 2 or int(S.components(self.n, a, b).max()) == 0

    def disconnection(self, a: np.ndarray, b: np.ndarray) -> str:
        part = S.components(self.n, a, b)
        groups = [[self.names[i] for i in np.flatnonzero(part == k)][:6] for k in range(int(part.max()) + 1)]
        return f"the feasible candidates leave {len(groups)} components: {groups[:6]}; loosen the gates, set cbfe_mode='bridge', or pass require_connected=False"

    def output(self, pool: S.Pool, chosen: np.ndarray) -> list[tuple]:
        """(seq, source, target, u, v, kind, total, message) of edges and messages."""
        out: list[tuple] = []
        for e in np.flatnonzero(chosen).tolist():
            u, v = self.names[pool.a[e]], self.names[pool.b[e]]
            r = self.rows.get((u, v))
            source, target = (u, v) if pool.cbfe[e] or r is None else (r.source, r.target)
            out.append((None, source, target, u, v, "cbfe" if pool.cbfe[e] else "rbfe", float(pool.weight[e]), None))
        return out + [(i, None, None, None, None, None, None, m) for i, m in enumerate(self.unmet)]


def _forced(c: _Campaign, available: set[tuple[str, str]]) -> None:
    lost = sorted(p for p in c.forced if p not in c.rows and p not in available)
    if lost:
        raise PlanError(f"forced edges that are not feasible: {['~'.join(p) for p in lost]}")


def _names(xs: list[str]) -> str:
    return f"{xs[:6]}{'...' if len(xs) > 6 else ''}"


def _mst(vertices: pd.DataFrame, edges: pd.DataFrame, options: NetworkOptions, overlaid: bool) -> list[tuple]:
    c = _Campaign(vertices, edges, options)
    spare: dict[tuple[str, str], float] = {}
    if options.bridges_by_cbfe:
        for i in range(c.n):
            for j in range(i + 1, c.n):
                pair = (c.names[i], c.names[j])
                if pair not in c.rows and pair not in c.banned:
                    spare[pair] = _cost_cbfe(c.v, i, j, options)
    _forced(c, set(spare))

    # 1 clusters: few crossings stay, and come into the selection as they are
    held: set[tuple[str, str]] = set()
    if options.cluster_by != "none":
        held = _prune_crossings(c)
    # 2 forced pairs without a mapping, and 3 bridges between components, are counterpoised
    placed: list[tuple[str, str]] = sorted(c.forced & set(spare))
    # fixed form of the message
    c.unmet += [f"forced edge {u}~{v} has no feasible RBFE mapping; supplied as a CBFE edge" for u, v in placed]
    if spare:
        pool = S.Pool.of(c.names, c.pool_edges + [(*p, spare[p], True) for p in placed])
        group = S.components(c.n, pool.a, pool.b)
        if int(group.max(initial=0)):
            offered = S.Pool.of(c.names, [(*p, w, True) for p, w in spare.items() if p not in placed])
            merit = c.merit(offered, np.arange(len(offered)), group, (pool.a, pool.b))
            placed += [tuple(offered.spec(e).split("~")) for e in S.join_groups(group, offered.a, offered.b, offered.weight, merit)]
    c.pool_edges += [(*p, spare.pop(p), True) for p in placed]

    base = S.Pool.of(c.names, c.pool_edges)
    if not c.connected(base.a, base.b):
        if options.require_connected:
            raise PlanError(c.disconnection(base.a, base.b))
        c.unmet.append(f"network is disconnected ({int(S.components(c.n, base.a, base.b).max()) + 1} components)")
    pool = base
    if options.cbfe_mode == "cycles":
        pool = S.Pool.of(c.names, c.pool_edges + [(*p, w, True) for p, w in spare.items()])
    usable = np.array([not pool.cbfe[e] or (int(pool.a[e]), int(pool.b[e])) in base.index for e in range(len(pool))], bool) if len(pool) else np.zeros(0, bool)

    # 4 spanning edges: forced ones, a hub's, then by cost; equal costs follow input order
    place = {x: i for i, x in enumerate(c.v.sort_values("ord").name)}
    ends = [sorted((c.names[x], c.names[y]), key=place.get) for x, y in zip(pool.a, pool.b, strict=True)]
    order = np.array(sorted(range(len(pool)), key=lambda e: (pool.weight[e], *ends[e])), int)
    number = {tuple(pool.spec(e).split("~")): e for e in range(len(pool))}
    seeds = [number[p] for p in sorted(c.forced) if p in number]
    if options.hub:
        seeds += sorted((e for p, e in number.items() if options.hub in p and usable[e]), key=lambda e: pool.spec(e))
    tree = S.overlaid_trees(pool, seeds, order, options.n_redundancy, usable) if overlaid else S.kruskal(pool, seeds, order, usable)
    chosen = np.zeros(len(pool), bool)
    chosen[tree] = True
    chosen[[number[p] for p in held if p in number]] = True

    # 5 redundancy
    cap = options.n_edges
    if cap is not None and chosen.sum() > cap:
        # fixed form of the message
        c.unmet.append(f"n_edges={cap} is below the {int(chosen.sum())} edges needed to span the ligands")
    mapped = ~pool.cbfe

    def degrees() -> None:
        if short := S.raise_degrees(pool, chosen, mapped, options.edges_per_ligand, c.synthetic, cap):
            # fixed form of the message
            c.unmet.append(f"edges_per_ligand={options.edges_per_ligand} unmet for {len(short)} ligand(s): {_names(short)}")

    def cycles() -> None:
        if options.min_cycle_coverage <= 0:
            return
        by_edge = options.cycle_coverage_mode == "edge"
        got = S.close_cycles(pool, chosen, np.ones(len(pool), bool), options.min_cycle_coverage, by_edge, options.max_cycle_size, c.synthetic, cap)
        if not got.met:
            # fixed form of the message
            unit = " (edge coverage)" if by_edge else ""
            c.unmet.append(f"min_cycle_coverage={options.min_cycle_coverage:.2f}{unit} unmet; achieved {got.reached:.2f}. The candidate pool has no further edges that would improve cycle coverage.")

    if options.selection_objective == "connectivity_then_cycles":
        cycles()
        if options.edges_per_ligand > 1:
            degrees()
    else:
        degrees()
        cycles()
    if (most := options.max_diameter) is not None:
        reached = S.reduce_diameter(pool, chosen, mapped, most, cap)
        # fixed forms of the messages
        if reached is None:
            c.unmet.append(f"max_diameter={most} not evaluated: the selected network is disconnected, so its diameter is undefined. Connect it first.")
        elif reached > most:
            c.unmet.append(f"max_diameter={most} unmet; achieved {reached}. The candidate pool has no further edge that would bring another ligand pair within the bound.")
    return c.output(pool, chosen)


def _prune_crossings(c: _Campaign) -> set[tuple[str, str]]:
    """Takes edges between clusters out of the pool, but for the best ones of joined pairs of
    clusters and forced ones; puts the cheapest back where the rest would fall apart."""
    options, group = c.options, c.clusters()
    pool = S.Pool.of(c.names, c.pool_edges)
    cross = np.flatnonzero(group[pool.a] != group[pool.b])
    if not len(cross):
        return set()
    merit = c.merit(pool, cross, group, (pool.a, pool.b))
    best = S.join_groups(group, pool.a[cross], pool.b[cross], pool.weight[cross], merit, options.cluster_bridges)
    keep = {int(cross[e]) for e in best} | {e for e in cross.tolist() if tuple(pool.spec(e).split("~")) in c.forced}
    inside = np.array([e not in keep and group[pool.a[e]] != group[pool.b[e]] for e in range(len(pool))])
    back: list[int] = []
    if c.connected(pool.a, pool.b):
        forest = S.Forest(range(c.n))
        for e in np.flatnonzero(~inside).tolist():
            forest.join(int(pool.a[e]), int(pool.b[e]))
        back = [e for e in np.flatnonzero(inside).tolist() if forest.join(int(pool.a[e]), int(pool.b[e]))]
    if back:
        # fixed form of the message
        c.unmet.append(f"cluster_by={options.cluster_by!r} left the network disconnected; {len(back)} cross-cluster edge(s) restored to span the ligands: {_names([pool.spec(e) for e in back])}")
    dropped = {tuple(pool.spec(e).split("~")) for e in np.flatnonzero(inside).tolist() if e not in back}
    c.pool_edges = [x for x in c.pool_edges if (x[0], x[1]) not in dropped]
    return {tuple(pool.spec(e).split("~")) for e in (*keep, *back)}


def _optimal(vertices: pd.DataFrame, edges: pd.DataFrame, options: NetworkOptions) -> list[tuple]:
    if options.design == "none":
        raise PlanError("the optimal planner needs design='a_optimal' or 'd_optimal'")
    c = _Campaign(vertices, edges, options)
    _forced(c, set())
    pool = S.Pool.of(c.names, [(u, v, max(w, S.LEAST_COST), x) for u, v, w, x in c.pool_edges])
    if not c.connected(pool.a, pool.b):
        if options.require_connected:
            raise PlanError(c.disconnection(pool.a, pool.b))
        c.unmet.append(f"network is disconnected ({int(S.components(c.n, pool.a, pool.b).max()) + 1} components)")
    target = options.n_edges if options.n_edges is not None else max(c.n - 1, int(round(c.n * np.log(c.n))) if c.n > 1 else 0)
    if target > len(pool):
        # fixed form of the message
        c.unmet.append(f"the design asked for {target} edge(s) but only {len(pool)} feasible candidate(s) exist; selecting all of them")
        target = len(pool)
    number = {tuple(pool.spec(e).split("~")): e for e in range(len(pool))}
    forced = [number[p] for p in sorted(c.forced) if p in number]
    chosen = np.zeros(len(pool), bool)
    chosen[S.kruskal(pool, forced, np.arange(len(pool)))] = True
    if chosen.sum() > target:
        c.unmet.append(f"n_edges={options.n_edges} is below the {int(chosen.sum())} edges needed to span the ligands")
    wide = _wide(chosen, c.n, options)
    D.descend(pool, chosen, wide, target, options.design)
    if options.design_refine:
        D.exchange(pool, chosen, wide, options.design, set(forced))
    cut = S.bridges(c.n, pool.a[chosen], pool.b[chosen])
    # fixed forms of the messages
    if cut.any():
        listed = sorted(pool.spec(e) for e in np.flatnonzero(chosen)[cut])
        c.unmet.append(f"the design contains {len(listed)} bridge(s) -- edge(s) no cycle checks: {_names(listed)}; raise n_edges to let the criterion buy its way out of them")
    degree = np.bincount(np.concatenate([pool.a[chosen], pool.b[chosen]]), minlength=c.n)
    if short := [c.names[i] for i in np.flatnonzero(degree < options.edges_per_ligand)]:
        c.unmet.append(f"edges_per_ligand={options.edges_per_ligand} unmet for {len(short)} ligand(s): {_names(short)}; the design criterion, not the degree target, decides selection here")
    return c.output(pool, chosen)


def _wide(chosen: np.ndarray, n: int, options: NetworkOptions) -> np.ndarray:
    """The chosen edges and the cheapest others, to the design's factor of the vertices."""
    wide = chosen.copy()
    wide[np.flatnonzero(~chosen)[: max(int(round(options.design_candidate_factor * n)) - int(chosen.sum()), 0)]] = True
    return wide


def _design_pool(vertices: pd.DataFrame, edges: pd.DataFrame, options: NetworkOptions) -> list[tuple]:
    c = _Campaign(vertices, edges, options)
    _forced(c, set())
    pool = S.Pool.of(c.names, [(u, v, max(w, S.LEAST_COST), x) for u, v, w, x in c.pool_edges])
    number = {tuple(pool.spec(e).split("~")): e for e in range(len(pool))}
    chosen = np.zeros(len(pool), bool)
    chosen[S.kruskal(pool, [number[p] for p in sorted(c.forced) if p in number], np.arange(len(pool)))] = True
    return c.output(pool, _wide(chosen, c.n, options))


def design_pool(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions) -> DataFrame:
    """(campaign, u, v): the pairs that the optimal planner's design chooses from."""
    return _grouped(vertices, candidates, options, _design_pool).selected.select(KEY, "u", "v")


def _grouped(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions, run, marks: DataFrame | None = None) -> Plan:
    """Only names, costs and what the options need go to Python; each campaign is one group.
    ``marks`` (campaign, u, v, mark) are pairs forced or banned in single campaigns."""
    wanted = [x for x in ("name", "ord", "charge", "n_heavy", "scaffold", "synthetic", "fp") if x in vertices.columns]
    best = best_by_pair(candidates, options).select(KEY, "source", "target", "u", "v", F.col("total").cast("double").alias("total"))
    if marks is None:
        best = best.withColumn("mark", F.lit(""))
    else:
        named = marks.groupBy(KEY, "u", "v").agg(F.min("mark").alias("mark"))  # banned goes before forced
        bans = named.where("mark = 'banned'").select(KEY, F.col("u").alias("source"), F.col("v").alias("target"), "u", "v", F.lit(None).cast("double").alias("total"), "mark")
        best = best.join(fresh(bans.select(KEY, "u", "v")), [KEY, "u", "v"], "left_anti").join(fresh(named.where("mark = 'forced'")), [KEY, "u", "v"], "left").fillna("", ["mark"])
        # a pair that is forced without a candidate comes along, to be named or bridged
        lone = named.where("mark = 'forced'").join(fresh(best.select(KEY, "u", "v")), [KEY, "u", "v"], "left_anti")
        best = best.select(*bans.columns).unionByName(bans)
        if not lone.isEmpty():
            r = lone.first()
            raise PlanError(f"forced edges that are not feasible: {[f'{r.u}~{r.v}']}")
    kind = vertices.schema[KEY].dataType.simpleString()
    columns = ["seq", "source", "target", "u", "v", "kind", "total", "message"]

    def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame([], columns=[KEY, *columns])
        rows = [(key[0], *r) for r in run(v, e, options)]
        return pd.DataFrame(rows, columns=[KEY, *columns]).astype({"seq": "Int32"})

    out = vertices.select(KEY, *wanted).groupBy(KEY).cogroup(fresh(best).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, seq int, source string, target string, u string, v string, kind string, total double, message string")
    return Plan(out.where("message IS NULL").drop("seq", "message"), out.where("message IS NOT NULL").select(KEY, "seq", "message"))


def plan_similar(vertices: DataFrame, options: NetworkOptions | None = None) -> Plan:
    """What ``plan`` selects by "mst" from all pairs of vertices (campaign, name, ord, fp) at 1 less
    their similarity. Only vertices go to a campaign's task, which makes similarities as it needs
    them (``dense``): no table holds the pairs. Names and places are given and differ within a
    campaign; of the options, ``edges_per_ligand`` may be any from 2 on, the others stay as they are."""
    options = options or NetworkOptions()
    target = options.edges_per_ligand
    if target < 2 or dataclasses.replace(options, edges_per_ligand=2) != NetworkOptions():
        raise PlanError("a plan over all pairs takes edges_per_ligand from 2 on and no other option; use plan")
    spark = vertices.sparkSession
    kind = vertices.schema[KEY].dataType.simpleString()

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        names, place = table["name"].to_pylist(), table["ord"].to_pylist()
        n = len(names)
        for x in (names, place):
            if None in x or len(set(x)) < n:
                raise PlanError(f"campaign {key[0]}: names and places must be given and differ")
        if n > 1 and not key[0].is_valid:
            raise PlanError("vertices without a campaign have no pairs")
        net, short = network(table["fp"].combine_chunks(), np.array(place), target)
        ends = [(a, b) if place[a] < place[b] else (b, a) for a, b in net.cost]
        rows = [(None, names[i], names[j], names[a], names[b], "rbfe", w, None) for (i, j), ((a, b), w) in zip(ends, net.cost.items(), strict=True)]
        # fixed form of the message
        rows += [(0, None, None, None, None, None, None, f"edges_per_ligand={target} unmet for {len(short)} ligand(s): {_names([names[i] for i in short])}")] if short else []
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.int32(), *[pa.string()] * 5, pa.float64(), pa.string())
        return pa.table([pa.repeat(key[0], len(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [KEY, "seq", "source", "target", "u", "v", "kind", "total", "message"])

    # as many tasks as asked for: rows are few, what is done with them is not
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    v = vertices.select(KEY, "name", F.col("ord").cast("long").alias("ord"), "fp").repartition(tasks, KEY)
    out = v.groupBy(KEY).applyInArrow(one, f"{KEY} {kind}, seq int, source string, target string, u string, v string, kind string, total double, message string")
    return Plan(out.where("message IS NULL").drop("seq", "message"), out.where("message IS NOT NULL").select(KEY, "seq", "message"))


def _all_cbfe(vertices: DataFrame, options: NetworkOptions) -> DataFrame:
    """Counterpoised candidates for all unordered pairs: no mapper has a say."""
    from loomgraph.operators.cbfe import pool

    row = Window.partitionBy(KEY).orderBy("u", "v")
    return pool(vertices, options).select(KEY, (F.row_number().over(row) - 1).alias("cand_ord"), F.col("u").alias("source"), F.col("v").alias("target"), F.col("total"), F.lit(True).alias("feasible"), F.lit("cbfe").alias("kind"))


def listing(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates in the order in which they are shown, with ``rank``: feasible ones first, then
    by cost, then by key."""
    row = Window.partitionBy(KEY).orderBy(~F.col("feasible"), "total", F.concat_ws("~", "source", "target"))
    ranked = candidates.withColumn("rank", F.row_number().over(row))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def plan(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions | None = None, planner: str = "mst", marks: DataFrame | None = None) -> Plan:
    """``marks`` (campaign, u, v, mark): pairs that are "forced" or "banned" in single campaigns,
    beside those of the options; for planners that choose edge by edge."""
    options = options or NetworkOptions()
    if planner not in PLANNERS:
        raise PlanError(f"no planner {planner!r}; there are {sorted(PLANNERS)}")
    if options.cbfe_mode in ("bridge", "cycles") and planner not in ("mst", "redundant-mst"):
        raise PlanError(f"planner {planner!r} places no counterpoised edges; use 'mst'")
    if options.design != "none" and planner != "optimal":
        raise PlanError(f"planner {planner!r} knows no design; use 'optimal'")
    if options.cbfe_mode == "all":
        found = plan(vertices, _all_cbfe(vertices, options), _without_cbfe(options), planner)
        return Plan(found.selected.withColumn("kind", F.lit("cbfe")), found.unmet)
    if marks is not None:
        if planner not in GROUPED:
            raise PlanError(f"planner {planner!r} takes no marks")
        return _grouped(vertices, candidates, options, GROUPED[planner], marks)
    return PLANNERS[planner](vertices, candidates, options)


def _without_cbfe(options: NetworkOptions) -> NetworkOptions:
    return dataclasses.replace(options, cbfe_mode="off", compat=None)


GROUPED = {"mst": lambda x, e, p: _mst(x, e, p, False), "redundant-mst": lambda x, e, p: _mst(x, e, p, True), "optimal": _optimal}
PLANNERS = {
    "mst": lambda v, c, o: _grouped(v, c, o, GROUPED["mst"]),
    "redundant-mst": lambda v, c, o: _grouped(v, c, o, GROUPED["redundant-mst"]),
    "optimal": lambda v, c, o: _grouped(v, c, o, GROUPED["optimal"]),
    "star": plan_star,
    "explicit": plan_explicit,
    "complete": plan_complete,
}

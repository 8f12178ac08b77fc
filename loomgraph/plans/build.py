"""From structures to a network: pairs, mapping, descriptors, gates, scores, plan.

The one Python stage is the mapping; descriptors, the geometry gate and scores are column
expressions over its result, so another scorer or threshold reuses the mapped table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import gates, mappings, scoring
from loomgraph.operators import alignment as A
from loomgraph.operators import design
from loomgraph.operators import graph as G
from loomgraph.operators import pairs as P
from loomgraph.operators.adaptive import evaluate_adaptively, gaps
from loomgraph.operators.intermediates import augment, reaches
from loomgraph.operators.mapping import consistent, evaluate
from loomgraph.operators.pairs import KEY
from loomgraph.operators.selection import LEAST_COST
from loomgraph.operators.unionfind import Forest
from loomgraph.plans import planners
from loomgraph.plans.options import AlignmentOptions, MappingOptions, NetworkOptions, PlanError
from loomgraph.sources.structures import invented

#: (source, target) to new vertices as (name, identity, {"atoms": rows, "bonds": rows}), or why not.
Generate = Callable[[str, str], "list[tuple[str, object, dict]] | str"]


@dataclass(frozen=True)
class Network:
    """``allocation`` (campaign, u, v, effort, share, windows ...) is there with design_total_ns,
    ``attempts`` (campaign, source, target, accepted, names, reason) with intermediates."""

    vertices: DataFrame
    candidates: DataFrame
    selected: DataFrame
    unmet: DataFrame
    allocation: DataFrame | None = None
    attempts: DataFrame | None = None


def score_candidates(mapped: DataFrame, vertices: DataFrame, options: NetworkOptions, scorer: str = "linear", weights: dict[str, float] | None = None) -> DataFrame:
    """Candidate rows: mapped pairs with descriptors, rejections and score."""
    v = vertices.select(KEY, "name", F.struct("charge", "n_heavy", "atoms", "rings").alias("v"))
    one, two = (v.select(KEY, F.col("name").alias(n), F.col("v").alias(f"v{k}")) for n, k in (("source", 1), ("target", 2)))
    m = mapped.join(one, [KEY, "source"]).join(two, [KEY, "target"])
    core = F.struct("cc1", "cc2", "sc1", "sc2")
    d = mappings.descriptors(core, F.col("v1"), F.col("v2"))
    d |= {"n_fragments_before_1": F.get("fragments_before", F.lit(0)).cast("double"), "n_fragments_before_2": F.get("fragments_before", F.lit(1)).cast("double"), "n_demoted_atoms": (F.size("demoted_1") + F.size("demoted_2")).cast("double")}
    for name in ("rotatable_delta", "logp_delta"):  # from a chemistry backend, where there is one
        if name in mapped.columns:
            d[name] = F.col(name)
    out = m.withColumns({f"d_{k}": c for k, c in d.items()})
    got = {k: F.col(f"d_{k}") for k in d}
    out = out.withColumn("rejections", gates.rejections(F.col("reason"), gates.geometry(got["core_rmsd"], F.col("reason"), options.softcore)))
    out = out.withColumn("score", scoring.score(got, F.col("rejections"), scorer, weights))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("source", "target")) - 1
    return out.select(KEY, order.alias("cand_ord"), "source", "target", F.col("score.total").alias("total"), F.col("score.feasible").alias("feasible"), "rejections", F.size("sc1").alias("n_sc_1"), F.size("sc2").alias("n_sc_2"), "cc1", "cc2", "sc1", "sc2", "method", "iterations", "trace", "complete", F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*got.values())).alias("descriptors"))


def build(
    vertices: DataFrame, options: NetworkOptions | None = None, mapper: str = "mcss-e2", scorer: str = "linear", planner: str = "mst", mapping_options: MappingOptions | None = None,
    weights: dict[str, float] | None = None, alignment: AlignmentOptions | None = None, generate: Generate | None = None,
) -> Network:
    """Everything from structures to edges. What can fail by its options does before any job.

    In order: alignment, pairs, mapping and scores (all pairs, or as many as the targets need),
    vertices invented for gaps (``generate(source, target)`` makes them: names, identities and
    structures, or why not), the plan, one core per vertex, and the effort of each edge.
    """
    options, alignment = options or NetworkOptions(), alignment or AlignmentOptions()
    if planner not in planners.PLANNERS:
        raise PlanError(f"no planner {planner!r}")
    if options.intermediates.mode != "off" and generate is None:
        raise PlanError(f"intermediates.mode={options.intermediates.mode!r} needs something that makes structures: pass generate")
    P.check_names(vertices)
    if options.cbfe_mode == "all":  # no mapper has a say
        empty = vertices.select(KEY, F.lit(0).alias("cand_ord"), F.col("name").alias("source"), F.col("name").alias("target"), F.lit(0.0).alias("total"), F.lit(False).alias("feasible")).limit(0)
        p = planners.plan(vertices, empty, options, planner)
        return Network(vertices, empty, p.selected, p.unmet)
    if alignment.method != "off":
        every = P.expand(vertices)
        sims = P.similarities(every, vertices).select(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "sim")
        vertices = G.settle(A.moved(vertices, A.align(vertices, sims, alignment.reference, alignment.method == "star", mapping_options)))

    def judged(among: DataFrame, pairs: DataFrame) -> DataFrame:
        mapped = G.settle(evaluate(pairs, among, mapper, mapping_options, options.softcore))
        return score_candidates(mapped, among, options, scorer, weights)

    pairs = P.candidates(vertices, options)
    if options.pair_evaluation == "adaptive":
        sims = P.similarities(pairs.select(KEY, "source", "target"), vertices)
        candidates = G.settle(evaluate_adaptively(vertices, G.settle(sims), lambda x: judged(vertices, x), options))
    else:
        candidates = G.settle(judged(vertices, pairs))
    attempts = None
    if options.intermediates.mode != "off":
        vertices, candidates, attempts = _augmented(vertices, candidates, options, judged, generate)
    p = planners.plan(vertices, candidates, options, planner).settled()
    selected = p.selected
    if options.consistency != "pairwise":
        candidates, selected = _consistent(vertices, candidates, selected, options, scorer, weights)
    sides = candidates.select(KEY, "source", "target", "n_sc_1", "n_sc_2")
    oriented = planners.orient(selected.join(sides, [KEY, "source", "target"], "left"), vertices, options.edge_direction)
    allocation = None
    if options.design_total_ns is not None:
        edges = selected.select(KEY, "u", "v", F.greatest("total", F.lit(LEAST_COST)).alias("sigma"))
        allocation = design.allocation(design.per_edge(vertices, edges, options.design_total_ns), options.design_lambda_min, options.design_lambda_max)
    return Network(vertices, candidates, oriented, p.unmet, allocation, attempts)


def _consistent(vertices: DataFrame, candidates: DataFrame, selected: DataFrame, options: NetworkOptions, scorer: str, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """(candidates, selected) with one core per vertex over the selected edges that have one, and
    scores by those cores. Cores meet only over shared vertices, so whole campaigns ("graph")
    and their connected parts ("component") come to the same."""
    edges = selected.where("kind = 'rbfe'").join(candidates.select(KEY, "source", "target", "cc1", "cc2", "method"), [KEY, "source", "target"])
    again = G.settle(score_candidates(G.settle(consistent(edges, vertices, options.softcore)), vertices, options, scorer, weights).drop("cand_ord"))
    bad = again.where("NOT feasible").limit(5).collect()
    if bad:
        raise PlanError(f"edges without a feasible consistent core: {[f'{r.source}~{r.target}: {list(r.rejections)}' for r in bad]}")
    key = [KEY, "source", "target"]
    changed = candidates.select(*key, "cand_ord").join(again, key)
    rest = candidates.join(P.fresh(again.select(*key)), key, "left_anti")
    scores = again.select(*key, F.col("total").alias("_new"))
    return G.settle(rest.unionByName(changed.select(rest.columns))), G.settle(selected.join(scores, key, "left").withColumn("total", F.coalesce("_new", "total")).drop("_new"))


def _augmented(vertices: DataFrame, candidates: DataFrame, options: NetworkOptions, judged: Callable[[DataFrame, DataFrame], DataFrame], generate: Generate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, candidates, attempts) with vertices invented for the gaps of each campaign. One
    gap after the other, as each changes what the next needs; only gaps and names are collected."""
    spark, kind = vertices.sparkSession, vertices.schema[KEY].dataType.simpleString()
    vertices = vertices.withColumn("synthetic", F.lit(False)) if "synthetic" not in vertices.columns else vertices
    feasible = candidates.where("feasible")
    sims = P.similarities(P.expand(vertices), vertices)
    open_pairs = gaps(sims, feasible.select(KEY, "source", "target").unionByName(feasible.select(KEY, F.col("target").alias("source"), F.col("source").alias("target"))), options.intermediates.max_gaps)
    found = open_pairs.orderBy(KEY, "rank").select(KEY, "source", "target").collect()
    part = {(r[0], r.name): r.component for r in G.components(vertices, feasible.select(KEY, F.col("source").alias("u"), F.col("target").alias("v"))).collect()}
    size = {r[0]: r.n for r in vertices.groupBy(KEY).agg(F.count("*").alias("n")).collect()}
    now, more, log = vertices, candidates, []
    for campaign in sorted({r[0] for r in found}):
        own, made, gap = {x: y for (c, x), y in part.items() if c == campaign}, {}, []
        joined = Forest(set(own))
        for x, y in own.items():
            joined.join(x, y)

        def ask(a: str, b: str, gap=gap) -> list | str:
            gap[:] = [a, b]
            return generate(a, b)

        def rows(new: list, campaign=campaign, made=made) -> DataFrame:
            made |= {x[0]: x for x in new}
            listed = [(campaign, x[0], x[2]["atoms"], x[2]["bonds"]) for x in made.values()]
            return now.unionByName(invented(spark, listed, now)) if listed else now

        def offered(new: list, pairs: list, campaign=campaign, rows=rows, joined=joined, gap=gap) -> dict:
            wanted = spark.createDataFrame([(campaign, *x) for x in pairs], f"{KEY} {kind}, source string, target string")
            got = {(r.source, r.target): r.total for r in judged(rows(new), wanted).where("feasible").collect()}
            if reaches(got, *gap):
                joined.join(*gap)
            return got

        new, edges, attempts = augment([(r.source, r.target) for r in found if r[0] == campaign], ask, offered, lambda a, b, joined=joined: joined.root(a) == joined.root(b), options.intermediates, options.headroom(size[campaign]))
        log += [(campaign, x.source, x.target, x.generator, x.accepted, list(x.names), x.reason) for x in attempts]
        if new:
            made.clear()
            now = G.settle(rows(new))
            wanted = spark.createDataFrame([(campaign, *x) for x in edges], f"{KEY} {kind}, source string, target string")
            last = more.groupBy(KEY).agg(F.max("cand_ord").alias("_last"))
            scored = judged(now, wanted).join(last, KEY, "left").withColumn("cand_ord", F.col("cand_ord") + F.coalesce("_last", F.lit(-1)) + 1).drop("_last")
            more = G.settle(more.unionByName(scored.select(more.columns)))
    return now, more, spark.createDataFrame(log, f"{KEY} {kind}, source string, target string, generator string, accepted boolean, names array<string>, reason string")

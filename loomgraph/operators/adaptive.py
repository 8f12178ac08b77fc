"""Which pairs to evaluate next: seeds, gaps, and the loop that stops when targets are met."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators.pairs import KEY, Cell, compared
from loomgraph.plans.options import NetworkOptions


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", F.explode(F.array("source", "target")).alias("own"))


def seed(sims: DataFrame, neighbours: int, forced: DataFrame | None = None) -> DataFrame:
    """Forced pairs and the first ``neighbours`` pairs of every vertex, the most similar first.
    ``sims`` are those of all pairs, or what ``pairs.nearest`` leaves of them by pair."""
    row = Window.partitionBy(KEY, "own").orderBy(F.desc("sim"), "source", "target")
    first = _ends(sims).withColumn("_r", F.row_number().over(row)).where(F.col("_r") <= neighbours).select(KEY, "source", "target").distinct()
    return first if forced is None else first.union(forced.select(KEY, "source", "target")).distinct()


def gaps(sims: DataFrame, feasible: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs without a feasible candidate, the most similar first, with ``rank``."""
    open_pairs = sims.join(feasible.select(KEY, "source", "target"), [KEY, "source", "target"], "left_anti")
    ranked = open_pairs.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("sim"), "source", "target")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def best_open(vertices: DataFrame, near: DataFrame, top_k: int, floor: float, most: int) -> DataFrame:
    """Pairs among which are the ``most`` most similar of every campaign that ``prefilter`` drops,
    for ``gaps``. ``near`` is what ``nearest`` gives for the same ``top_k`` and ``floor``.

    Each vertex brings the last of its ``top_k`` pairs, so a block tells by itself which of its
    pairs are dropped.
    """
    ends = near.select(KEY, "sim", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("other")), F.struct(F.col("target").alias("name"), F.col("source").alias("other")))).alias("x")).select(KEY, "sim", "x.*")
    ranked = ends.withColumn("_r", F.row_number().over(Window.partitionBy(KEY, "name").orderBy(F.desc("sim"), "other")))
    last = ranked.where(F.col("_r") == top_k).select(KEY, "name", F.col("sim").alias("_last"), F.col("other").alias("_other"))

    def first(cell: Cell, at: np.ndarray, sim: np.ndarray, rank: np.ndarray) -> np.ndarray:
        names = sorted(cell.place)
        least = cell.table["_last"].to_numpy()[at].astype(float)[:, None]  # nan: fewer pairs than top_k
        other = cell.table["_other"].to_pylist()
        until = np.array([-1 if other[k] is None else bisect_right(names, other[k]) - 1 for k in at], np.int64)[:, None]
        return np.isnan(least) | (sim > least) | ((sim == least) & (rank[None, :] <= until))

    def pick(cell: Cell) -> np.ndarray:
        kept = first(cell, cell.at_a, cell.sim, cell.rank_b) | first(cell, cell.at_b, cell.sim.T, cell.rank_a).T
        left = cell.valid & ~kept & (cell.sim < floor)
        if cell.alone:
            left &= cell.ord_a[:, None] < cell.ord_b[None, :]
        value = cell.sim[left]
        if len(value) > most:
            left &= cell.sim >= -np.partition(-value, most - 1)[most - 1]
        i, j = np.nonzero(left)
        cut = cell.cut(i, j, cell.sim[i, j], np.zeros(len(i), np.int64), most, True)
        out = np.zeros(cell.sim.shape, bool)
        out[i[cut], j[cut]] = True
        return out

    return compared(vertices.join(last, [KEY, "name"], "left"), pick, "_last", "_other")


def expansion(sims: DataFrame, done: DataFrame, selected: DataFrame, vertices: DataFrame, options: NetworkOptions) -> DataFrame:
    """Pairs not evaluated yet with ``rank``: those at most vertices below the degree target,
    then those that would close the shortest cycle, then the most similar. Pairs without a way
    between them, or one that is too long, come after the others."""
    left = sims.join(done.select(KEY, "source", "target"), [KEY, "source", "target"], "left_anti")
    short = G.degrees(vertices, selected).select(KEY, "name", (F.col("degree") < options.edges_per_ligand).cast("int").alias("short"))
    hops = G.hop_counts(vertices, selected).select(KEY, F.col("a").alias("u"), F.col("b").alias("v"), "hops")
    x = left.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")}).join(hops, [KEY, "u", "v"], "left")
    for side in ("source", "target"):
        x = x.join(short.select(KEY, F.col("name").alias(side), F.col("short").alias(f"_{side}")), [KEY, side])
    far = 1 << 20
    size = F.coalesce(F.col("hops") + 1, F.lit(far))
    if options.max_cycle_size is not None:
        size = F.when(size > options.max_cycle_size, F.lit(far)).otherwise(size)
    x = x.withColumns({"deficient": F.col("_source") + F.col("_target"), "cycle_size": size})
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("deficient"), "cycle_size", F.desc("sim"), "u", "v"))).drop("_source", "_target", "hops", "u", "v")


def evaluate_adaptively(vertices: DataFrame, sims: DataFrame, evaluate: Callable[[DataFrame], DataFrame], options: NetworkOptions, rounds: int = 100) -> DataFrame:
    """Candidates of as few pairs as the targets need: a seed, then batches of the best ranked
    pairs, each one Spark job, until a plan over what is there leaves nothing unmet.

    ``evaluate`` maps and scores pairs (campaign, source, target). Probes are planned without
    counterpoised edges and may be in pieces.
    """
    import dataclasses

    from loomgraph.plans.planners import plan

    probe = dataclasses.replace(options, cbfe_mode="off", require_connected=False, compat=None)
    found = G.settle(evaluate(seed(sims, options.adaptive_initial_neighbors)))
    for _ in range(rounds):
        p = plan(vertices, found, probe)
        unmet = G.settle(p.unmet)
        if unmet.isEmpty():
            break
        todo = expansion(sims, found, G.settle(p.selected), vertices, options).join(unmet.select(KEY).distinct(), KEY, "left_semi").where(F.col("rank") <= options.adaptive_batch_size)
        todo = G.settle(todo.select(KEY, "source", "target"))
        if todo.isEmpty():
            break
        found = G.settle(found.unionByName(evaluate(todo)))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("source", "target")) - 1
    return found.withColumn("cand_ord", order)


def with_cache(pairs: DataFrame, cache: DataFrame | None, key: list[str], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluates only pairs whose key isn't in the cache table (failures are cached too), and
    returns the rows of all."""
    if cache is None:
        return evaluate(pairs)
    new = evaluate(pairs.join(cache.select(*key), key, "left_anti"))
    return cache.join(pairs.select(*key), key, "left_semi").unionByName(new)

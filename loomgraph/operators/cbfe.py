"""Counterpoised edges: pool, cost, merit. They need no mapping and are never infeasible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY, banned
from loomgraph.plans.options import NetworkOptions


def cost(heavy_1: Column, heavy_2: Column, options: NetworkOptions) -> Column:
    return options.cbfe_base_cost + options.cbfe_atom_weight * (heavy_1 + heavy_2)


def pool(vertices: DataFrame, options: NetworkOptions, taken: DataFrame | None = None) -> DataFrame:
    """(campaign, u, v, total): all unordered pairs by name, without banned pairs and those
    of ``taken`` (campaign, u, v). Strategy and prefilter have no say here."""
    a, b = (vertices.select(KEY, F.col("name").alias(x), F.col("n_heavy").alias(f"h_{x}")) for x in ("u", "v"))
    pairs = a.join(b, KEY).where("u < v").join(banned(vertices, options), ["u", "v"], "left_anti")
    if taken is not None:
        pairs = pairs.join(taken.select(KEY, "u", "v"), [KEY, "u", "v"], "left_anti")
    return pairs.select(KEY, "u", "v", cost(F.col("h_u"), F.col("h_v"), options).alias("total"))


def centrality(degrees: DataFrame) -> DataFrame:
    """(campaign, name, component, degree) with centrality: degree over the component's
    largest; 1 where that is 0, as a lone vertex has one way in."""
    peak = F.max("degree").over(Window.partitionBy(KEY, "component"))
    return degrees.withColumn("centrality", F.when(peak > 0, F.col("degree") / peak).otherwise(1.0))


def merit(sim: Column, central_1: Column, central_2: Column) -> Column:
    return sim + 0.5 * (central_1 + central_2) / 2


def bridge_rank(pairs: DataFrame) -> DataFrame:
    """pairs (campaign, u, v, sim, c_u, c_v, total) with merit and rank: by merit, then cost,
    then names."""
    m = pairs.withColumn("merit", F.round(merit(F.col("sim"), F.col("c_u"), F.col("c_v")), 9))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("merit"), "total", "u", "v")))


def as_candidates(pairs: DataFrame) -> DataFrame:
    """Candidate rows for (campaign, u, v, total): no core, all atoms change."""
    return pairs.select(KEY, F.col("u").alias("source"), F.col("v").alias("target"), "u", "v", F.lit("cbfe").alias("kind"), "total", F.lit(True).alias("feasible"))

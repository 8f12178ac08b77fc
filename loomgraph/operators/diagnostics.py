"""What a planned network is worth: one row per campaign, by joins and aggregates."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import selection as S
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import CostModel


def costs(vertices: DataFrame, selected: DataFrame) -> DataFrame:
    """(campaign, n_edges, cost, efficiency): summed and mean cost; 0 without edges."""
    s = selected.groupBy(KEY).agg(F.count("*").alias("n_edges"), F.sum("total").alias("cost"), F.avg("total").alias("efficiency"))
    return vertices.select(KEY).distinct().join(s, KEY, "left").fillna(0, ["n_edges"]).fillna(0.0, ["cost", "efficiency"])


def gpu_hours(vertices: DataFrame, selected: DataFrame, model: CostModel | None = None) -> DataFrame:
    """(campaign, n_rbfe, n_cbfe, gpu_hours, price) by kind of edge."""
    m = model or CostModel()
    s = selected.groupBy(KEY).agg(F.count_if(F.col("kind") != "cbfe").alias("n_rbfe"), F.count_if(F.col("kind") == "cbfe").alias("n_cbfe"))
    s = vertices.select(KEY).distinct().join(s, KEY, "left").fillna(0, ["n_rbfe", "n_cbfe"])
    hours = F.col("n_rbfe") * m.rbfe_gpu_hours + F.col("n_cbfe") * (m.rbfe_gpu_hours * m.cbfe_multiplier)
    return s.withColumn("gpu_hours", hours).withColumn("price", F.col("gpu_hours") * m.price_per_gpu_hour)


def degree_summary(vertices: DataFrame, selected: DataFrame) -> DataFrame:
    """(campaign, least, mean, most, isolated)."""
    return G.degrees(vertices, selected).groupBy(KEY).agg(F.min("degree").alias("least"), F.avg("degree").alias("mean"), F.max("degree").alias("most"), F.count_if(F.col("degree") == 0).alias("isolated"))


def edge_budget_advice(vertices: DataFrame, selected: DataFrame) -> DataFrame:
    """(campaign, n_vertices, n_edges, recommended, shortfall): edges against ceil(n ln n)."""
    n = vertices.groupBy(KEY).agg(F.count("*").alias("n_vertices"))
    e = selected.groupBy(KEY).agg(F.count("*").alias("n_edges"))
    both = n.join(e, KEY, "left").fillna(0, ["n_edges"])
    advice = F.when(F.col("n_vertices") < 2, F.lit(0)).otherwise(F.ceil(F.col("n_vertices") * F.ln("n_vertices"))).cast("long")
    short = F.when(F.col("n_vertices") < 2, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("recommended") - F.col("n_edges"))).cast("long")
    return both.withColumn("recommended", advice).withColumn("shortfall", short)


def failure_robustness(vertices: DataFrame, selected: DataFrame, rate: float, trials: int, seed: int, rng: str = "hash") -> DataFrame:
    """(campaign, connected_fraction, mean_retained): how often the network holds together, and
    how large its largest part is, when each edge fails with this probability.

    Trials are rows: trial times edge, with a uniform number from a hash of (seed, trial,
    edge), so any number of trials runs in parallel and repeats exactly. ``rng="sequence"``
    draws from Python's generator, edge by edge in name order, within one task a campaign.
    """
    if not 0 <= rate <= 1 or trials < 1:
        raise ValueError("rate must lie in [0, 1] and trials be positive")
    kind = vertices.schema[KEY].dataType.simpleString()
    names = vertices.select(KEY, "name")
    if rng == "hash":
        t, again = (vertices.sparkSession.range(trials).withColumnRenamed("id", "trial") for _ in range(2))
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "trial", "u", "v"), 11) / float(1 << 53)
        left = selected.select(KEY, "u", "v").crossJoin(t).withColumn("_x", chance).where(F.col("_x") >= rate).select(KEY, "trial", "u", "v")
        every = names.select(KEY).distinct().crossJoin(again).join(names.groupBy(KEY).agg(F.collect_list("name").alias("names")), KEY)

        def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(key[0], _largest(list(v.names[0]), e.u, e.v), len(v.names[0]))], columns=[KEY, "kept", "n"])

        each = every.groupBy(KEY, "trial").cogroup(fresh(left).groupBy(KEY, "trial")).applyInPandas(one, f"{KEY} {kind}, kept long, n long")
        return each.groupBy(KEY).agg(F.avg((F.col("kept") == F.col("n")).cast("double")).alias("connected_fraction"), F.avg("kept").alias("mean_retained"))

    def serial(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        draw = random.Random(seed)
        e = e.sort_values(["u", "v"])
        kept = []
        for _ in range(trials):
            up = np.array([draw.random() >= rate for _ in range(len(e))], bool)
            kept.append(_largest(list(v.name), e.u[up], e.v[up]))
        return pd.DataFrame([(key[0], float(np.mean([k == len(v) for k in kept])), float(np.mean(kept)))], columns=[KEY, "connected_fraction", "mean_retained"])

    return names.groupBy(KEY).cogroup(fresh(selected.select(KEY, "u", "v")).groupBy(KEY)).applyInPandas(serial, f"{KEY} {kind}, connected_fraction double, mean_retained double")


def _largest(names: list[str], u, v) -> int:
    number = {x: i for i, x in enumerate(names)}
    part = S.components(len(names), np.array([number[x] for x in u], int), np.array([number[x] for x in v], int))
    return int(np.bincount(part).max()) if len(names) else 0


def summarize(vertices: DataFrame, selected: DataFrame, model: CostModel | None = None) -> DataFrame:
    """All of the above but the trials, with diameter, short cycles, bridges and coverage."""
    edges = G.settle(G.cycle_cover(vertices, selected))
    cover = edges.groupBy(KEY).agg(F.count_if("is_bridge").alias("bridges"), F.avg((~F.col("is_bridge")).cast("double")).alias("edge_cycle_coverage"))
    on = G.on_cycle(vertices, selected, edges).groupBy(KEY).agg(F.avg(F.col("on_cycle").cast("double")).alias("node_cycle_coverage"))
    out = costs(vertices, selected)
    for x in (gpu_hours(vertices, selected, model), degree_summary(vertices, selected), edge_budget_advice(vertices, selected).drop("n_edges"), G.diameter(vertices, selected), G.short_cycles(vertices, selected), cover, on):
        out = out.join(x, KEY, "left")
    return out.fillna(0, ["bridges"])

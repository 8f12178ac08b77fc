"""Replanning from per-edge diagnostics: read, cut, ban, plan again; and closure errors."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.keys import SEPARATOR
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import NetworkOptions, PlanError, pair_of
from loomgraph.plans.planners import GROUPED, Plan, plan


def read_lmi(spark: SparkSession, text: str) -> DataFrame:
    """(u, v, lmi) from JSON of one of three shapes: {"a~b": x}, {"edges": {"a~b": x}} or a list
    of {"edge" (or "source" and "target"), "lmi"}. A pair may occur in both directions with one
    value; two values are an error."""
    data = json.loads(text)
    if isinstance(data, dict):
        found = data.get("edges", data)
        items: Iterable = found.items() if isinstance(found, dict) else ((x.get("edge") or (x["source"], x["target"]), x["lmi"]) for x in found)
    else:
        items = ((x.get("edge") or (x["source"], x["target"]), x["lmi"]) for x in data)
    rows = spark.createDataFrame([(*pair_of(k), float(x)) for k, x in items], "u string, v string, lmi double").distinct()
    check_lmi(rows)
    return rows


def check_lmi(rows: DataFrame) -> None:
    bad = rows.groupBy("u", "v").agg(F.countDistinct("lmi").alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"edges with two values: {[SEPARATOR.join((r.u, r.v)) for r in bad]}")


def threshold(lmi: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(campaign, cut): the quantile of the selected edges' values, between neighbours linearly."""
    return lmi.groupBy(KEY).agg(F.percentile("lmi", quantile).alias("cut"))


def high_edges(selected: DataFrame, lmi: DataFrame, options: NetworkOptions, quantile: float = 0.9, cut: float | None = None, max_pruned: int | None = None, require_complete: bool = True) -> DataFrame:
    """(campaign, u, v, lmi) of selected edges strictly above the cut, but forced ones, the
    highest first (rank). Missing values are an error unless allowed; edges without any value
    always are. Without edges there is nothing to cut."""
    from pyspark.sql import Window

    on = [KEY, "u", "v"] if KEY in lmi.columns else ["u", "v"]
    joined = selected.select(KEY, "u", "v").join(lmi, on, "left")
    state = joined.agg(F.count("*").alias("n"), F.count("lmi").alias("have")).first()
    if state.n and not state.have:
        raise PlanError("no selected edge has a value")
    if require_complete and state.have < state.n:
        raise PlanError(f"{state.n - state.have} selected edges have no value")
    known = joined.where("lmi IS NOT NULL")
    over = known.where(F.col("lmi") > cut) if cut is not None else known.join(threshold(known, quantile), KEY).where("lmi > cut").drop("cut")
    forced = over.sparkSession.createDataFrame(sorted(options.forced_pairs), "u string, v string")
    ranked = over.join(forced, ["u", "v"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("lmi"), "u", "v")))
    return ranked.select(KEY, "u", "v", "lmi", "rank") if max_pruned is None else ranked.where(F.col("rank") <= max_pruned).select(KEY, "u", "v", "lmi", "rank")


def replan(vertices: DataFrame, candidates: DataFrame, selected: DataFrame, pruned: DataFrame, options: NetworkOptions, planner: str = "mst") -> Plan:
    """Plans again without the pruned edges and with all others that are still feasible, by the
    same planner. Bans and kept edges differ by campaign, so they are tables: planners that
    choose edge by edge take them as marks, and for the others pruned pairs leave the candidates
    and kept ones join what the planner selects.
    """
    out = pruned.select(KEY, "u", "v").distinct()
    feasible = candidates.where("feasible").withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    kept = selected.where("kind <> 'cbfe'").select(KEY, "u", "v").distinct().join(out, [KEY, "u", "v"], "left_anti").join(fresh(feasible.select(KEY, "u", "v").distinct()), [KEY, "u", "v"], "left_semi")
    options = dataclasses.replace(options, compat=None)
    if planner in GROUPED:
        marks = kept.withColumn("mark", F.lit("forced")).unionByName(out.withColumn("mark", F.lit("banned")))
        return plan(vertices, candidates, options, planner, marks)
    named = candidates.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    found = plan(vertices, named.join(out, [KEY, "u", "v"], "left_anti").drop("u", "v"), options, planner)
    lost = selected.join(fresh(kept), [KEY, "u", "v"], "left_semi").join(fresh(found.selected.select(KEY, "u", "v")), [KEY, "u", "v"], "left_anti")
    return Plan(found.selected.unionByName(lost.select(found.selected.columns)), found.unmet)

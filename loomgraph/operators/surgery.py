"""Edits of planned networks: delete, append, merge, concatenate, close cycles around a set.

A network is vertices, candidates and selected edges; an edit returns new tables and leaves
the rest as it is.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import selection as S
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import PlanError, pair_of


def delete_edge(vertices: DataFrame, selected: DataFrame, edge: str, must_stay_connected: bool = True) -> DataFrame:
    """Without an edge, in every campaign that has it; a bridge is refused, naming both sides."""
    u, v = pair_of(edge)
    hit = selected.where((F.col("u") == u) & (F.col("v") == v))
    if hit.isEmpty():
        raise PlanError(f"edge {u}~{v} is not in the network")
    rest = selected.where(~((F.col("u") == u) & (F.col("v") == v)))
    if must_stay_connected:
        touched = vertices.join(hit.select(KEY).distinct(), KEY, "left_semi")
        part = G.components(touched, rest.join(hit.select(KEY).distinct(), KEY, "left_semi"))
        ends = part.where(F.col("name").isin(u, v)).groupBy(KEY).agg(F.countDistinct("component").alias("n")).where("n > 1").limit(1).collect()
        if ends:
            sides = part.where(F.col(KEY) == ends[0][KEY]).groupBy("component").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy("component").collect()
            raise PlanError(f"edge {u}~{v} is a bridge between {' and '.join(str(r.names[:5]) for r in sides)}")
    return rest


def append_vertex(selected: DataFrame, candidates: DataFrame, name: str, n_edges: int = 2, cbfe: DataFrame | None = None, must_be_joined: bool = True) -> DataFrame:
    """selected with the vertex's ``n_edges`` cheapest feasible candidates; if it has none, its
    cheapest counterpoised edge (``cbfe``: campaign, u, v, total), else an error, unless it may
    stay alone."""
    mine = candidates.where("feasible").withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")}).where((F.col("u") == name) | (F.col("v") == name))
    row = Window.partitionBy(KEY).orderBy("total", "u", "v")
    new = mine.withColumn("_r", F.row_number().over(row)).where(F.col("_r") <= n_edges).select(KEY, "source", "target", "u", "v", F.lit("rbfe").alias("kind"), F.col("total").cast("double").alias("total"))
    if new.isEmpty():
        if cbfe is None:
            if not must_be_joined:
                return selected
            raise PlanError(f"nothing maps to {name!r}")
        own = cbfe.where((F.col("u") == name) | (F.col("v") == name)).withColumn("_r", F.row_number().over(row)).where("_r = 1")
        new = own.select(KEY, F.col("u").alias("source"), F.col("v").alias("target"), "u", "v", F.lit("cbfe").alias("kind"), F.col("total").cast("double").alias("total"))
    return selected.unionByName(new.select(selected.columns))


def merge(left: DataFrame, right: DataFrame, order: str = "total") -> DataFrame:
    """Edges of both networks; an edge of both comes from the cheaper, the left on ties."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    row = Window.partitionBy(KEY, "u", "v").orderBy(order, "_side")
    return both.withColumn("_r", F.row_number().over(row)).where("_r = 1").drop("_r", "_side")


def merge_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates of both, one per direction: feasible before rejected, then the cheaper."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    row = Window.partitionBy(KEY, "source", "target").orderBy(F.desc("feasible"), F.asc_nulls_last("total"), "_side")
    return both.withColumn("_r", F.row_number().over(row)).where("_r = 1").drop("_r", "_side")


def check_shared(left: DataFrame, right: DataFrame) -> None:
    """Networks are merged over vertices that both have."""
    if left.join(right, [KEY, "name"], "left_semi").isEmpty():
        raise PlanError("the networks share no vertex; concatenate them")


def concatenate(left: DataFrame, right: DataFrame, crossing: DataFrame, n_bridges: int = 2) -> DataFrame:
    """Two disjoint networks' edges with bridges from ``crossing`` (campaign, u, v, kind, source,
    target, total): the fewest used ends first, then cost, then names, one after the other."""
    kind = left.schema[KEY].dataType.simpleString()
    columns = [KEY, "source", "target", "u", "v", "kind", "total"]

    def one(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        rows, used, out = e.sort_values(["total", "u", "v"]).to_dict("records"), set(), []
        while rows and len(out) < n_bridges:
            k = min(range(len(rows)), key=lambda i: ((rows[i]["u"] in used) + (rows[i]["v"] in used), i))
            r = rows.pop(k)
            used |= {r["u"], r["v"]}
            out.append(r)
        return pd.DataFrame(out, columns=columns)

    new = crossing.select(columns).groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, source string, target string, u string, v string, kind string, total double")
    return left.select(columns).unionByName(right.select(columns)).unionByName(new)


def cyclize(vertices: DataFrame, selected: DataFrame, candidates: DataFrame, names: Iterable[str], longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Puts the named vertices on cycles with the candidates at hand: (selected, stranded)."""
    wanted = set(names)
    kind = vertices.schema[KEY].dataType.simpleString()
    pool = candidates.where("feasible").select(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.col("total").cast("double").alias("total"))
    pool = pool.groupBy(KEY, "u", "v").agg(F.min("total").alias("total"))
    held = selected.select(KEY, "u", "v", "total").withColumn("_held", F.lit(True))
    offered = pool.join(held.select(KEY, "u", "v"), [KEY, "u", "v"], "left_anti").withColumn("_held", F.lit(False)).unionByName(held)

    def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = sorted(v.name)
        p = S.Pool.of(names, [(r.u, r.v, r.total, False) for r in e.itertuples()])
        chosen = _held(p, e)
        before = chosen.copy()
        exempt = pd.Series(names).map(lambda x: x not in wanted).to_numpy(bool)
        S.close_cycles(p, chosen, ~chosen, 1.0, False, longest, exempt, None)
        forest = S.BridgeForest(len(names), p.a[chosen], p.b[chosen])
        rows = [(key[0], names[p.a[i]], names[p.b[i]], float(p.weight[i]), None) for i in (chosen & ~before).nonzero()[0]]
        rows += [(key[0], None, None, None, names[i]) for i in range(len(names)) if names[i] in wanted and not forest.on_cycle[i]]
        return pd.DataFrame(rows, columns=[KEY, "u", "v", "total", "stranded"])

    out = vertices.select(KEY, "name").groupBy(KEY).cogroup(fresh(offered).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, u string, v string, total double, stranded string")
    new = out.where("u IS NOT NULL").select(KEY, F.col("u").alias("source"), F.col("v").alias("target"), "u", "v", F.lit("rbfe").alias("kind"), "total")
    return selected.unionByName(new.select(selected.columns)), out.where("stranded IS NOT NULL").select(KEY, F.col("stranded").alias("name"))


def _held(pool: S.Pool, edges: pd.DataFrame):
    held = set(map(tuple, edges[edges["_held"]][["u", "v"]].to_numpy()))
    return pd.Series([(pool.names[x], pool.names[y]) in held for x, y in zip(pool.a, pool.b, strict=True)]).to_numpy(bool)


def validate(vertices: DataFrame, selected: DataFrame, require_connected: bool = True) -> DataFrame:
    """(campaign, problem) of loops, unknown ends, pairs selected twice, and pieces."""
    loops = selected.where("source = target").select(KEY, F.concat(F.lit("loop at "), "source").alias("problem"))
    ends = selected.select(KEY, F.explode(F.array("source", "target")).alias("name")).distinct()
    unknown = ends.join(vertices.select(KEY, "name"), [KEY, "name"], "left_anti").select(KEY, F.concat(F.lit("unknown vertex "), "name").alias("problem"))
    twice = selected.groupBy(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).count().where("count > 1").select(KEY, F.concat(F.lit("pair twice "), "u", F.lit("~"), "v").alias("problem"))
    out = loops.union(unknown).union(twice)
    if require_connected:
        pieces = G.components(vertices, selected.select(KEY, "u", "v")).groupBy(KEY).agg(F.countDistinct("component").alias("n")).where("n > 1")
        out = out.union(pieces.select(KEY, F.concat(F.col("n").cast("string"), F.lit(" components")).alias("problem")))
    return out

"""Graph operators over edge tables (campaign, u, v ...).

Two kinds. Set-level ones are joins and aggregations: degrees, short cycles, components by
label rounds, minimum spanning forests by rounds of cheapest outgoing edges. They scale with
the edges. Per-campaign ones (bridges, distances) are grouped maps: sequential within a
campaign, parallel across campaigns.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import selection as S
from loomgraph.operators.pairs import KEY, fresh


def settle(df: DataFrame) -> DataFrame:
    """Writes a round's table to the shared folder (spark.checkpoint.dir; on one machine, where
    that is unset, one beside the warehouse) and reads it back, so that a loop's plan doesn't
    grow and lost executors cost one round. The folder goes when the driver ends, or before by
    ``forget``."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for x in tables:
        _remove(x.sparkSession, x.settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def normal(edges: DataFrame) -> DataFrame:
    """Edges with u < v, each once, without loops."""
    return edges.select(KEY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, name, degree), vertices without edges included."""
    ends = edges.select(KEY, F.explode(F.array("u", "v")).alias("name")).groupBy(KEY, "name").agg(F.count("*").alias("degree"))
    return vertices.select(KEY, "name").join(ends, [KEY, "name"], "left").fillna(0, ["degree"])


def components(vertices: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(campaign, name, component): the smallest name that a vertex reaches.

    Rounds of: take the smallest label around; then the label's own label (so labels travel
    twice as far each round), until a round changes nothing.
    """
    both = settle(edges.select(KEY, F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(KEY, F.col("v"), F.col("u"))).distinct())
    labels = vertices.select(KEY, "name", F.col("name").alias("component"))
    before = None
    for _ in range(most):
        around = both.join(labels.select(KEY, F.col("name").alias("b"), "component"), [KEY, "b"]).groupBy(KEY, F.col("a").alias("name")).agg(F.min("component").alias("_near"))
        new = labels.join(around, [KEY, "name"], "left").select(KEY, "name", F.least("component", "_near").alias("component"))
        jump = new.select(KEY, F.col("name").alias("component"), F.col("component").alias("_next"))
        older, labels = labels, settle(new.join(jump, [KEY, "component"], "left").select(KEY, "name", F.least("component", "_next").alias("component")))
        if before is not None:
            forget(older)
        now = labels.agg(F.count("*"), F.sum(F.xxhash64(KEY, "name", "component").cast("decimal(38,0)"))).first()
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges (campaign, u, v, weight), ties by names, by rounds of
    contraction: every component takes its cheapest edge, components that are joined become one,
    and of the edges between two of them only the cheapest goes on. Each round halves the
    components at least, and the edges shrink with them."""
    known = vertices.select(KEY, "name")
    left = edges.select(KEY, "u", "v", "weight").where("u <> v")
    for x in ("u", "v"):
        left = left.join(known.withColumnRenamed("name", x), [KEY, x], "left_semi")
    left = settle(left.select(KEY, F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("edge")))
    chosen = []
    while True:
        ways = left.select(KEY, "edge", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("x")).select(KEY, "x.*", "edge")
        pick = settle(ways.groupBy(KEY, "at").agg(F.min_by("to", "edge").alias("to"), F.min("edge").alias("edge")))
        if pick.isEmpty():
            break
        chosen.append(pick.select(KEY, "edge.u", "edge.v", "edge.weight"))
        # edges are in strict order, so only two components that pick the same edge form a ring
        back = pick.select(KEY, F.col("at").alias("to"), F.col("to").alias("_back"))
        up = pick.join(fresh(back), [KEY, "to"], "left").select(KEY, "at", F.when((F.col("_back") == F.col("at")) & (F.col("at") < F.col("to")), F.col("at")).otherwise(F.col("to")).alias("up"))
        up = _roots(settle(up))
        moved = left
        for x in ("a", "b"):
            moved = moved.join(fresh(up.select(KEY, F.col("at").alias(x), F.col("up").alias(f"_{x}"))), [KEY, x], "left").withColumn(x, F.coalesce(f"_{x}", x)).drop(f"_{x}")
        moved = moved.where("a <> b").groupBy(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge"))
        older, left = left, settle(moved.select(KEY, "a", "b", "edge"))
        forget(older, up)
    if not chosen:
        return edges.select(KEY, "u", "v", "weight").limit(0)
    out = chosen[0]
    for x in chosen[1:]:
        out = out.union(x)
    return out.distinct()


def _roots(up: DataFrame) -> DataFrame:
    """(campaign, at, up) with up the root: steps of double length until none moves. A written
    table comes in and goes out; depths are the logarithm of the longest way."""
    while True:
        nxt = up
        for _ in range(2):
            nxt = nxt.join(fresh(up.select(KEY, F.col("at").alias("up"), F.col("up").alias("_next"))), [KEY, "up"], "left").select(KEY, "at", F.coalesce("_next", "up").alias("up"), (F.coalesce("_next", "up") != F.col("up")).alias("_moved"))
        nxt = settle(nxt)
        forget(up)
        up = nxt.select(KEY, "at", "up")
        up.settled_at = nxt.settled_at
        if nxt.where("_moved").isEmpty():
            return up


def triangles(edges: DataFrame) -> DataFrame:
    """(campaign, a, b, c), a < b < c: each triangle once, by joining paths to edges."""
    e = normal(edges)
    ab, bc, ac = (e.select(KEY, F.col("u").alias(x), F.col("v").alias(y)) for x, y in (("a", "b"), ("b", "c"), ("a", "c")))
    return ab.join(bc, [KEY, "b"]).join(ac, [KEY, "a", "c"]).select(KEY, "a", "b", "c")


def short_cycles(vertices: DataFrame, edges: DataFrame, longest: int = 4) -> DataFrame:
    """(campaign, cycles): simple cycles of at most 3 or 4 vertices. Four-cycles are counted
    from shared neighbours: every pair of vertices with c of them closes c (c - 1) / 2, and
    each four-cycle is found from both of its diagonals."""
    if longest not in (3, 4):
        raise ValueError("cycles of 3 or 4 vertices are counted by joins; use count_cycles for longer ones")
    e = normal(edges)
    three = triangles(e).groupBy(KEY).agg(F.count("*").alias("n"))
    parts = three
    if longest == 4:
        arcs = e.union(e.select(KEY, F.col("v").alias("u"), F.col("u").alias("v")))
        a, b = (arcs.select(KEY, F.col("u").alias("mid"), F.col("v").alias(x)) for x in ("x", "y"))
        shared = a.join(b, [KEY, "mid"]).where("x < y").groupBy(KEY, "x", "y").agg(F.count("*").alias("c"))
        four = shared.groupBy(KEY).agg((F.sum(F.col("c") * (F.col("c") - 1) / 2) / 2).cast("long").alias("n"))
        parts = three.union(four)
    counted = parts.groupBy(KEY).agg(F.sum("n").alias("cycles"))
    return vertices.select(KEY).distinct().join(counted, KEY, "left").fillna(0, ["cycles"])


def _grouped(vertices: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """run(names, a, b, edge frame) to a frame without the campaign, per campaign."""
    kind = vertices.schema[KEY].dataType.simpleString()

    def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = sorted(v.name)
        number = {x: i for i, x in enumerate(names)}
        e = e.sort_values(["u", "v"]).reset_index(drop=True)
        out = run(names, e.u.map(number).to_numpy(int), e.v.map(number).to_numpy(int), e)
        out.insert(0, KEY, key[0])
        return out

    extra = [c for c in ("weight", "value") if c in edges.columns]
    return vertices.select(KEY, "name").groupBy(KEY).cogroup(fresh(edges.select(KEY, "u", "v", *extra)).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, {schema}")


def cycle_cover(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, u, v, is_bridge) of every edge."""

    def run(names, a, b, e):
        return pd.DataFrame({"u": e.u, "v": e.v, "is_bridge": S.bridges(len(names), a, b)})

    return _grouped(vertices, edges, run, "u string, v string, is_bridge boolean")


def on_cycle(vertices: DataFrame, edges: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """(campaign, name, on_cycle): ends of edges that are no bridges. ``cover`` is the result of
    cycle_cover, where it is there already."""
    covered = (cycle_cover(vertices, edges) if cover is None else cover).where(~F.col("is_bridge")).select(KEY, F.explode(F.array("u", "v")).alias("name")).distinct().withColumn("on_cycle", F.lit(True))
    return vertices.select(KEY, "name").join(covered, [KEY, "name"], "left").fillna(False, ["on_cycle"])


def diameter(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, diameter): null in pieces, 0 below two vertices."""

    def run(names, a, b, e):
        d = S.distances(len(names), a, b)
        value = 0 if len(names) < 2 else None if np.isinf(d).any() else int(d.max())
        return pd.DataFrame({"diameter": pd.array([value], "Int64")})

    return _grouped(vertices, edges, run, "diameter long")


def hop_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, a, b, hops) of all reachable pairs a < b, by rounds of joins: the frontier of
    all sources moves one hop per round, as long as there is one. For graphs too large for one
    task; what is reached is as large as the pairs that are."""
    arcs = settle(normal(edges).select(KEY, F.col("u").alias("a"), F.col("v").alias("b")).union(normal(edges).select(KEY, F.col("v"), F.col("u"))))
    front = settle(arcs.withColumn("hops", F.lit(1)))
    rounds, before = [front], arcs.select(KEY, "a", F.col("a").alias("b")).distinct()
    while not front.isEmpty():
        step = front.select(KEY, F.col("a").alias("s"), F.col("b").alias("a")).join(arcs, [KEY, "a"]).select(KEY, F.col("s").alias("a"), "b").distinct()
        # a step from one front leads to the front before it, to itself or beyond
        new = step.join(fresh(front.select(KEY, "a", "b")), [KEY, "a", "b"], "left_anti").join(fresh(before), [KEY, "a", "b"], "left_anti")
        before, front = front.select(KEY, "a", "b"), settle(new.withColumn("hops", F.lit(len(rounds) + 1)))
        rounds.append(front)
    out = rounds[0]
    for x in rounds[1:-1]:
        out = out.unionByName(x)
    return out.where("a < b")


def count_cycles(vertices: DataFrame, edges: DataFrame, longest: int = 6) -> DataFrame:
    """(campaign, cycles): simple cycles of up to ``longest`` vertices, by walks that start at
    a cycle's smallest vertex and keep one of the two directions."""

    def run(names, a, b, e):
        near = [sorted(w for w, _ in x) for x in S.neighbours(len(names), a, b)]
        count = 0
        for s in range(len(names)):
            stack = [(w, (s, w)) for w in near[s] if w > s]
            while stack:
                v, walk = stack.pop()
                for w in near[v]:
                    if w == s and len(walk) > 2 and walk[1] < walk[-1]:
                        count += 1
                    elif w > s and w not in walk and len(walk) < longest:
                        stack.append((w, (*walk, w)))
        return pd.DataFrame({"cycles": [count]})

    return _grouped(vertices, edges, run, "cycles long")


def closure_errors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, cycle, size, error) of a basis of cycles: edges (campaign, u, v, value) hold a
    directed value, negated against their direction. A tree by hops is grown from the first
    vertex; every other edge closes one cycle. Edges of null value close none."""

    def run(names, a, b, e):
        n, value = len(names), e.value.to_numpy(float)
        known = ~np.isnan(value)
        near = S.neighbours(n, a[known], b[known])
        ids = np.flatnonzero(known)
        up, depth, potential = [-1] * n, [-1] * n, [0.0] * n
        used = set()
        for root in range(n):
            if depth[root] >= 0:
                continue
            depth[root], todo = 0, [root]
            while todo:
                x = todo.pop(0)
                for y, k in near[x]:
                    if depth[y] < 0:
                        at = int(ids[k])
                        depth[y], up[y] = depth[x] + 1, x
                        potential[y] = potential[x] + (value[at] if a[at] == x else -value[at])
                        used.add(at)
                        todo.append(y)
        rows = []
        for at in ids.tolist():
            if at in used:
                continue
            x, y = int(a[at]), int(b[at])
            p, q, size = x, y, 1
            while p != q:
                if depth[p] < depth[q]:
                    p, q = q, p
                p, size = up[p], size + 1
            rows.append((f"{e.u[at]}~{e.v[at]}", size, potential[x] + value[at] - potential[y]))
        return pd.DataFrame(rows, columns=["cycle", "size", "error"])

    return _grouped(vertices, edges, run, "cycle string, size int, error double")

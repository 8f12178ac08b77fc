"""Plans over all pairs that are never listed give what the planner gives over their list."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph import queries as Q
from loomgraph import views as V
from loomgraph.operators import dense, pairs
from loomgraph.operators import selection as S
from loomgraph.plans import planners
from loomgraph.plans.options import NetworkOptions, PlanError

SCHEMA = "campaign string, name string, ord long, fp array<int>"


def listed(v, options):
    """The plan over the list of all pairs."""
    p = pairs.similarities(pairs.expand(v), v)
    c = p.select("campaign", F.lit(0).alias("cand_ord"), "source", "target", (1 - F.col("sim")).alias("total"), F.lit(True).alias("feasible"))
    return planners.plan(v.drop("fp"), c, options)


def rows(df):
    return sorted(map(tuple, df.collect()))


def drawn(draw, n):
    """Sets that change step by step, so that networks are long, with copies at both ends; or any sets, or such that hardly differ."""
    how, wide = draw.choice(["chain", "any", "tree"]), draw.choice([3, 12, 40])
    if how == "chain":
        out = [list(range(k, k + draw.choice([3, 4]))) for k in range(n)]
        return [out[0]] * min(3, n) + out[3:-3] + [out[-1]] * min(3, n - 3) if n > 8 else out
    out = [[k for k in range(wide) if draw.random() < 0.5]]
    for _ in range(n - 1):
        out.append(sorted(set(draw.choice(out)) ^ {draw.randrange(wide)}) if how == "tree" else [k for k in range(wide) if draw.random() < 0.5])
    return out


@pytest.mark.parametrize("target", [2, 3])
def test_plan_over_all_pairs(spark, target):
    draw = random.Random(11)
    table = []
    for c, n in enumerate([1, 2, 3, 4, 5, 7, 9, 12, 12, 16, 16, 20, 20, 25, 25, 30, 30, 30]):
        place = draw.sample(range(n), n)
        table += [(f"c{c}", f"n{k:02}", place[k], None if n == 12 and k == 4 else fp) for k, fp in enumerate(drawn(draw, n))]
    v = spark.createDataFrame(table, SCHEMA)
    options = NetworkOptions(edges_per_ligand=target)
    got, want = planners.plan_similar(v, options), listed(v, options)
    assert got.selected.dtypes == want.selected.dtypes and got.unmet.dtypes == want.unmet.dtypes
    assert rows(got.selected) == rows(want.selected) and rows(got.unmet) == rows(want.unmet)


def test_plan_of_vectors_without_a_list_of_pairs(spark, data):
    v = V.vectors(spark, data)
    got = Q.QUERIES["i40_plan_vectors"](spark, data)
    assert rows(got) == rows(listed(v, NetworkOptions()).selected)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "CoGroup" not in plan  # vertices alone are sent


@pytest.mark.parametrize("seed", range(60))
def test_cycles_over_all_pairs(seed):
    """Rings that are joined by ways, where many vertices are on no cycle and costs are often equal."""
    draw = random.Random(seed)
    k = draw.randrange(2, 16)
    edges = {(max(0, i - 1 - draw.randrange(draw.choice([1, 2, 9]))), i) for i in range(1, k)}
    n = k
    for x in range(k):
        if sum(x in e for e in edges) < 2 or draw.random() < 0.15:
            ring = [x, *range(n, n + draw.choice([2, 2, 3]))]
            n += len(ring) - 1
            edges |= {(min(e), max(e)) for e in zip(ring, ring[1:] + ring[:1], strict=True)}
    cost = np.triu(np.array([[draw.randrange(4) for _ in range(n)] for _ in range(n)], float), 1)

    class Costs:
        def cost(self, x, y):
            return float(cost[min(x, y), max(x, y)])

    net = dense.Network(n)
    for x, y in edges:
        net.add(x, y, cost[x, y])
    names = [f"n{i:02}" for i in range(n)]
    pool = S.Pool.of(names, [(names[i], names[j], cost[i, j], False) for i, j in itertools.combinations(range(n), 2)])
    chosen = np.zeros(len(pool), bool)
    chosen[[pool.index[e] for e in edges]] = True
    S.close_cycles(pool, chosen, np.ones(len(pool), bool), 1.0, False, None, np.zeros(n, bool), None)
    dense.close_cycles(Costs(), net)
    assert set(net.cost) == {(int(x), int(y)) for x, y in zip(pool.a[chosen], pool.b[chosen], strict=True)}


def test_what_a_plan_over_all_pairs_refuses(spark):
    with pytest.raises(PlanError):
        planners.plan_similar(spark.createDataFrame([], SCHEMA), NetworkOptions(max_diameter=3))
    for table in ([("x", "a", 0, [1]), ("x", "a", 1, [1])], [("x", "a", 0, [1]), ("x", None, 1, [1])], [(None, "a", 0, [1]), (None, "b", 1, [1])]):
        with pytest.raises(Exception, match="PlanError"):
            planners.plan_similar(spark.createDataFrame(table, SCHEMA)).selected.collect()


def test_many_members():
    near = dense.Near(pa.array([[5, 900], [5, 5, 7], None, []], pa.list_(pa.int32())))
    assert near.row(0).tolist() == [0, 1 - 1 / 3, 1, 1] and near.row(2).tolist() == [1, 1, 1, 1]

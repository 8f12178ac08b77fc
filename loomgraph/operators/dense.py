"""The network of an ``mst`` plan whose candidates are all pairs of a campaign, at 1 less their similarity.

Pairs are never listed: a row of similarities is made where a vertex is looked at, so a campaign
of n vertices takes time in n squared but memory in n. Each step gives what its namesake in
``selection`` gives over all pairs; that every pair may be taken is what lets it look at few.

* spanning: from one vertex on, the first edge that leads out, as the order of edges is strict.
* degrees: edges that help two vertices go before those that help one, and what has stopped
  helping never helps again. So each vertex keeps its first partner, and looks for another only
  when that one is gone.
* cycles: an added edge covers the vertices on the bridges between its ends. What lies on no cycle
  is a part of its own among the parts that bridges join, so the most that an edge can cover is a
  longest way between parts. Of the edges that cover as many the shortest end at such vertices, or
  two hops apart.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from loomgraph.operators.selection import BridgeForest, neighbours


class Near:
    """Costs between vertices with sets of members (null: empty)."""

    def __init__(self, fp: pa.Array) -> None:
        count = fp.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        member = np.asarray(fp.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), np.int64)
        self.has = np.zeros((len(count), int(member.max(initial=-1)) + 1), np.float32)
        self.has[np.repeat(np.arange(len(count)), count), member] = 1
        self.total = self.has.sum(axis=1, dtype=np.float64)

    def costs(self, x: int, has: np.ndarray, total: np.ndarray) -> np.ndarray:
        shared = has @ self.has[x]
        union = self.total[x] + total - shared
        return 1 - np.divide(shared, union, out=np.zeros(len(union)), where=union > 0)

    def row(self, x: int) -> np.ndarray:
        return self.costs(x, self.has, self.total)

    def cost(self, x: int, y: int) -> float:
        return float(self.costs(x, self.has[[y]], self.total[[y]])[0])


class Network:
    """Chosen edges between numbers 0 .. n - 1, which go by name."""

    def __init__(self, n: int) -> None:
        self.cost: dict[tuple[int, int], float] = {}
        self.near: list[set[int]] = [set() for _ in range(n)]

    def add(self, x: int, y: int, cost: float) -> None:
        self.cost[min(x, y), max(x, y)] = float(cost)
        self.near[x].add(y)
        self.near[y].add(x)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(list(self.cost), int).reshape(-1, 2).T)

    def hops(self, x: int) -> np.ndarray:
        out = np.full(len(self.near), -1)
        out[x], todo = 0, deque([x])
        while todo:
            v = todo.popleft()
            for w in self.near[v]:
                if out[w] < 0:
                    out[w] = out[v] + 1
                    todo.append(w)
        return out


def span(near: Near, place: np.ndarray, net: Network) -> None:
    """The spanning tree of least cost; of equal costs goes first what has the lesser name at its
    earlier end (by ``place``), then at its later."""
    n = len(place)
    number = np.arange(n)
    left, best, tie, by = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    x = 0
    for _ in range(n - 1):
        left[x], best[x] = False, np.inf
        cost = near.row(x)
        key = np.where(place[x] < place, x * n + number, number * n + x)
        better = left & ((cost < best) | ((cost == best) & (key < tie)))
        best[better], tie[better], by[better] = cost[better], key[better], x
        ties = np.flatnonzero(best == best.min())
        x = int(ties[tie[ties].argmin()])
        net.add(int(by[x]), x, best[x])


def raise_degrees(near: Near, net: Network, target: int) -> list[int]:
    """Adds the cheapest edges between two vertices below the target degree, then those at one.
    Returns those that stay below it."""
    n = len(net.near)
    for both in (True, False):
        short = [x for x in range(n) if len(net.near[x]) < target]
        others = np.array(short if both else range(n), int)
        where, has, total = {x: k for k, x in enumerate(others.tolist())}, near.has[others], near.total[others]
        gone = np.zeros(len(others), bool)

        def first(x: int) -> tuple[float, int, int, int] | None:
            cost = near.costs(x, has, total)  # noqa: B023
            cost[gone] = np.inf  # noqa: B023
            cost[[where[y] for y in (x, *net.near[x]) if y in where]] = np.inf  # noqa: B023
            k = int(cost.argmin())  # of equal costs, the least number makes the first pair
            y = int(others[k])  # noqa: B023
            return None if cost[k] == np.inf else (float(cost[k]), min(x, y), max(x, y), x)

        todo = [e for x in short if (e := first(x))]
        heapify(todo)
        while todo:
            cost, a, b, x = heappop(todo)
            if len(net.near[x]) >= target:
                continue
            y = a + b - x
            if y not in net.near[x] and not gone[where[y]]:
                net.add(x, y, cost)
                for z in (x, y) if both else ():
                    gone[where[z]] = len(net.near[z]) >= target
                if len(net.near[x]) >= target:
                    continue
            if e := first(x):
                heappush(todo, e)
    return [x for x in range(n) if len(net.near[x]) < target]


def _ways(near: list[list[tuple[int, int]]], weight: np.ndarray, start: int) -> np.ndarray:
    """Weights summed on the way from ``start`` to each part, both ends included."""
    out = np.full(len(near), -1)
    out[start], todo = weight[start], [start]
    while todo:
        v = todo.pop()
        for w, _ in near[v]:
            if out[w] < 0:
                out[w] = out[v] + weight[w]
                todo.append(w)
    return out


def close_cycles(near: Near, net: Network) -> None:
    """Adds edges until every vertex is on a cycle: most newly covered first, then short cycles,
    then cost. All are joined, and none has fewer than two edges."""
    n = len(net.near)
    while n > 2:
        a, b = net.ends()
        forest = BridgeForest(n, a, b)
        alone = np.flatnonzero(~forest.on_cycle).tolist()
        if not alone:
            break
        part, bare = forest.part, set(alone)
        weight = np.zeros(int(part.max()) + 1, int)
        weight[part[alone]] = 1
        parts = neighbours(len(weight), part[a[forest.is_bridge]], part[b[forest.is_bridge]])
        one = _ways(parts, weight, int(_ways(parts, weight, 0).argmax()))
        two = _ways(parts, weight, int(one.argmax()))
        most, reach = int(one.max()), np.maximum(one, two)
        found: list[tuple[float, float, int, int]] = []
        if most < 3:
            for s in alone:
                steps = {(x, s, y) for x in net.near[s] for y in net.near[s]} | {(s, m, y) for m in net.near[s] for y in net.near[m]}
                found += [(3, near.cost(min(x, y), max(x, y)), min(x, y), max(x, y)) for x, m, y in steps if x != y and y not in net.near[x] and len({x, m, y} & bare) == most]
        if not found:
            for x in (x for x in alone if reach[part[x]] == most):
                ways = _ways(parts, weight, int(part[x]))
                if ys := [y for y in alone if y > x and ways[part[y]] == most and y not in net.near[x]]:
                    hops = net.hops(x)
                    least = min(hops[y] for y in ys)
                    found += [(int(least) + 1, near.cost(x, y), x, y) for y in ys if hops[y] == least]
        _, cost, x, y = min(found)
        net.add(x, y, cost)


def network(fp: pa.Array, place: np.ndarray, target: int) -> tuple[Network, list[int]]:
    """Edges between vertices in name order, at ``place`` in the input, and who has fewer than
    ``target`` of them."""
    near, net = Near(fp), Network(len(place))
    span(near, place, net)
    short = raise_degrees(near, net, target) if target > 1 else []
    close_cycles(near, net)
    return net, short

"""Greedy network selection on one campaign: the sequential part of the planners.

Vertices are numbers in name order; candidate edges are arrays sorted by (weight, pair), so
"first" means cheapest. Bridges are found once per step, and a candidate's gain is read off
the forest of bridges: an added edge puts exactly the bridges on the path between its ends
on a cycle. Distances are one matrix, updated in place when an edge is added.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np

from loomgraph.operators.unionfind import Forest

LEAST_COST = 1e-9


@dataclass
class Pool:
    """Candidate edges of a campaign, sorted by (weight, pair)."""

    names: list[str]
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray
    cbfe: np.ndarray
    index: dict[tuple[int, int], int] = field(init=False)

    def __post_init__(self) -> None:
        self.index = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(self.a, self.b, strict=True))}

    @classmethod
    def of(cls, names: list[str], edges: list[tuple[str, str, float, bool]]) -> Pool:
        number = {x: i for i, x in enumerate(names)}
        rows = sorted((float(w), number[u], number[v], bool(c)) for u, v, w, c in edges)
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return cls(names, np.array(cols[1], int), np.array(cols[2], int), np.array(cols[0], float), np.array(cols[3], bool))

    def __len__(self) -> int:
        return len(self.a)

    def spec(self, i: int) -> str:
        return f"{self.names[self.a[i]]}~{self.names[self.b[i]]}"


def neighbours(n: int, a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[x].append((y, e))
        out[y].append((x, e))
    return out


def bridges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges are bridges: an edge is none if some edge below it in a depth-first tree
    leads above it. Discovery numbers are spread upwards in reverse order of discovery."""
    near = neighbours(n, a, b)
    seen, up, order = np.full(n, -1), np.full(n, -1), []
    out = np.zeros(len(a), bool)
    low = np.zeros(n, int)
    for start in range(n):
        if seen[start] >= 0:
            continue
        stack = [(start, -1, iter(near[start]))]
        seen[start] = low[start] = len(order)
        order.append(start)
        while stack:
            v, by, rest = stack[-1]
            for w, e in rest:
                if e == by:
                    continue
                if seen[w] < 0:
                    seen[w] = low[w] = len(order)
                    order.append(w)
                    up[w] = e
                    stack.append((w, e, iter(near[w])))
                    break
                low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[v])
                    out[by] = low[v] > seen[parent]
    return out


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A component number for each vertex, in order of their smallest vertices."""
    forest = Forest(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(x, y)
    first: dict[int, int] = {}
    return np.array([first.setdefault(forest.root(i), len(first)) for i in range(n)], int)


def distances(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hops between all vertices, inf where there is no way."""
    out = np.full((n, n), np.inf)
    near = neighbours(n, a, b)
    for s in range(n):
        out[s, s] = 0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            for w, _ in near[v]:
                if out[s, w] == np.inf:
                    out[s, w] = out[s, v] + 1
                    todo.append(w)
    return out


def with_edge(d: np.ndarray, x: int, y: int) -> np.ndarray:
    """Distances once x and y are joined."""
    return np.minimum(d, np.minimum(d[:, [x]] + 1 + d[[y], :], d[:, [y]] + 1 + d[[x], :]))


class BridgeForest:
    """The bridges between the parts of a graph that no single edge can cut."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray) -> None:
        self.is_bridge = bridges(n, a, b)
        self.on_cycle = np.zeros(n, bool)
        for ends in (a, b):
            self.on_cycle[ends[~self.is_bridge]] = True
        self.part = components(n, a[~self.is_bridge], b[~self.is_bridge])
        k = int(self.part.max()) + 1 if n else 0
        at = np.flatnonzero(self.is_bridge)
        self.ends = {int(e): (int(a[e]), int(b[e])) for e in at}
        near = neighbours(k, self.part[a[at]], self.part[b[at]])
        self.parent, self.edge, self.depth = [-1] * k, [-1] * k, [-1] * k
        self.tree = [-1] * k
        for root in range(k):
            if self.depth[root] >= 0:
                continue
            self.depth[root], self.tree[root] = 0, root
            todo = [root]
            while todo:
                v = todo.pop()
                for w, e in near[v]:
                    if self.depth[w] < 0:
                        self.parent[w], self.edge[w], self.depth[w], self.tree[w] = v, int(at[e]), self.depth[v] + 1, root
                        todo.append(w)

    def path(self, x: int, y: int) -> list[int] | None:
        """The bridges between x and y, or None if there is no way."""
        p, q = int(self.part[x]), int(self.part[y])
        if self.tree[p] != self.tree[q]:
            return None
        out = []
        while p != q:
            if self.depth[p] < self.depth[q]:
                p, q = q, p
            out.append(self.edge[p])
            p = self.parent[p]
        return out


def kruskal(pool: Pool, seeds: list[int], order: np.ndarray, allowed: np.ndarray | None = None) -> list[int]:
    """Seeds, and then the first edges in order that join what is apart."""
    forest, out = Forest(range(len(pool.names))), []
    for e in seeds:
        forest.join(int(pool.a[e]), int(pool.b[e]))
        out.append(e)
    for e in order.tolist():
        if (allowed is None or allowed[e]) and forest.join(int(pool.a[e]), int(pool.b[e])):
            out.append(e)
    return list(dict.fromkeys(out))


def overlaid_trees(pool: Pool, seeds: list[int], order: np.ndarray, passes: int, allowed: np.ndarray) -> list[int]:
    """Spanning forests one on the other: each pass does without the edges of those before."""
    left, out = allowed.copy(), []
    for k in range(passes):
        if not left.any():
            break
        taken = kruskal(pool, seeds if k == 0 else [], order, left)
        out += taken
        left[taken] = False
    return list(dict.fromkeys(out))


def raise_degrees(pool: Pool, chosen: np.ndarray, usable: np.ndarray, target: int, exempt: np.ndarray, cap: int | None) -> list[str]:
    """Adds, in place, the cheapest edges at the most vertices below the target degree.
    Returns the names that stay below it."""
    degree = np.bincount(np.concatenate([pool.a[chosen], pool.b[chosen]]), minlength=len(pool.names))
    while cap is None or chosen.sum() < cap:
        short = (degree < target) & ~exempt
        helps = (short[pool.a].astype(int) + short[pool.b]) * (usable & ~chosen)
        if not helps.any():
            break
        e = int(helps.argmax())  # the first of the most helpful: edges are in order of cost
        chosen[e] = True
        degree[[pool.a[e], pool.b[e]]] += 1
    return [pool.names[i] for i in np.flatnonzero((degree < target) & ~exempt)]


@dataclass(frozen=True)
class Coverage:
    reached: float
    met: bool


def close_cycles(pool: Pool, chosen: np.ndarray, usable: np.ndarray, share: float, by_edge: bool, longest: int | None, exempt: np.ndarray, cap: int | None) -> Coverage:
    """Adds, in place, edges until the share of vertices (or edges) on cycles is reached: most
    newly covered first, then mapped before counterpoised, short cycles, cost."""
    n = len(pool.names)
    real = n - int(exempt.sum())

    def state() -> tuple[BridgeForest, int, int]:
        forest = BridgeForest(n, pool.a[chosen], pool.b[chosen])
        covered = int((~forest.is_bridge).sum()) if by_edge else int((forest.on_cycle & ~exempt).sum())
        return forest, covered, int(chosen.sum()) if by_edge else real

    if n < 3:
        return Coverage(1.0, True)
    hops = distances(n, pool.a[chosen], pool.b[chosen])
    forest, covered, whole = state()
    while covered < share * whole and (cap is None or chosen.sum() < cap):
        free = ~forest.on_cycle | exempt  # a counterpoised edge must put such an end on a cycle
        best, pick = None, -1
        for e in np.flatnonzero(usable & ~chosen).tolist():
            x, y = int(pool.a[e]), int(pool.b[e])
            if pool.cbfe[e] and not (free[x] or free[y]):
                continue
            size = hops[x, y] + 1
            if size == np.inf or (longest is not None and size > longest):
                continue
            on_path = forest.path(x, y) or []
            if by_edge:
                gain = len(on_path) + 1
            else:
                ends = {x, y, *(v for k in on_path for v in forest.ends[k])}
                gain = sum(1 for v in ends if not forest.on_cycle[v] and not exempt[v]) if on_path else 0
            if gain > 0:
                rank = (-gain, bool(pool.cbfe[e]), size, e)
                if best is None or rank < best:
                    best, pick = rank, e
        if pick < 0:
            break
        chosen[pick] = True
        hops = with_edge(hops, int(pool.a[pick]), int(pool.b[pick]))
        forest, covered, whole = state()
    reached = covered / whole if whole else 1.0
    return Coverage(reached, reached >= share)


def reduce_diameter(pool: Pool, chosen: np.ndarray, usable: np.ndarray, most: int, cap: int | None) -> int | None:
    """Adds, in place, the shortcuts that bring most pairs within ``most`` hops per cost.
    Returns the diameter reached, or None if the network is in pieces."""
    hops = distances(len(pool.names), pool.a[chosen], pool.b[chosen])
    if np.isinf(hops).any():
        return None
    far = int((hops > most).sum()) // 2
    while far and (cap is None or chosen.sum() < cap):
        best, pick, new = None, -1, hops
        for e in np.flatnonzero(usable & ~chosen).tolist():
            d = with_edge(hops, int(pool.a[e]), int(pool.b[e]))
            fewer = far - int((d > most).sum()) // 2
            if fewer > 0:
                rank = (-fewer / max(pool.weight[e], LEAST_COST), -fewer, pool.weight[e], e)
                if best is None or rank < best:
                    best, pick, new = rank, e, d
        if pick < 0:
            break
        chosen[pick], hops = True, new
        far = int((hops > most).sum()) // 2
    return int(hops.max()) if len(hops) > 1 else 0


def centrality(n: int, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Degree over the largest degree of the own group; 1 where that is 0."""
    degree = np.bincount(np.concatenate([a, b]), minlength=n).astype(float)
    peak = np.zeros(int(group.max()) + 1 if n else 0)
    np.maximum.at(peak, group, degree)
    return np.where(peak[group] > 0, degree / np.maximum(peak[group], 1), 1.0)


def join_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray, merit: np.ndarray, per_pair: int = 1) -> list[int]:
    """The ``per_pair`` best edges of every pair of groups in a spanning forest over the groups,
    whose links are their best edges: by merit, then cost, then place."""
    p, q = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
    order = np.lexsort((b, a, cost, -merit))
    order = order[p[order] != q[order]]
    if not len(order):
        return []
    links, first, number, size = np.unique(np.stack([p, q], axis=1)[order], axis=0, return_index=True, return_inverse=True, return_counts=True)
    number = number.ravel()
    forest, tree = Forest(set(group.tolist())), np.zeros(len(links), bool)
    for k in first.argsort():
        tree[k] = forest.join(*links[k].tolist())
    # the place of each edge among those of its pair
    by_pair = np.argsort(number, kind="stable")
    rank = np.empty(len(order), int)
    rank[by_pair] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    return order[tree[number] & (rank < per_pair)].tolist()

"""Structures of one vertex, for the tasks that map and repair pairs.

Sets of atoms are bit masks (plain ints), so unions, intersections and neighbourhoods are
single operations. Nothing here needs a chemistry toolkit; canonical structures, embeddings
and logP do, and are left to an optional backend.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def mask_of(atoms: Iterable[int]) -> int:
    out = 0
    for a in atoms:
        out |= 1 << a
    return out


@dataclass(frozen=True)
class Molecule:
    """Elements, formal charges, aromatic flags, points and bonds (a, b) of a structure."""

    elements: tuple[int, ...]
    bonds: tuple[tuple[int, int], ...]
    points: np.ndarray | None = None
    charges: tuple[int, ...] = ()
    aromatic: tuple[bool, ...] = ()
    orders: tuple[float, ...] = ()

    @classmethod
    def of(cls, atoms: Iterable, bonds: Iterable) -> Molecule:
        """From rows: atoms with elem, x, y, z, charge, aromatic; bonds with a, b, order."""
        atoms, bonds = sorted((dict(a) for a in atoms), key=lambda a: a["idx"]), [dict(b) for b in bonds]
        return cls(
            tuple(int(a["elem"]) for a in atoms), tuple((int(b["a"]), int(b["b"])) for b in bonds), np.array([[a["x"], a["y"], a["z"]] for a in atoms], float).reshape(-1, 3),
            tuple(int(a.get("charge") or 0) for a in atoms), tuple(bool(a.get("aromatic")) for a in atoms), tuple(float(b.get("order") or 1.0) for b in bonds),
        )

    @property
    def n(self) -> int:
        return len(self.elements)

    @cached_property
    def near(self) -> tuple[int, ...]:
        """Neighbours of each atom."""
        out = [0] * self.n
        for a, b in self.bonds:
            out[a] |= 1 << b
            out[b] |= 1 << a
        return tuple(out)

    @cached_property
    def heavy(self) -> int:
        return mask_of(i for i, e in enumerate(self.elements) if e != 1)

    @cached_property
    def parents(self) -> dict[int, int]:
        """The one neighbour of every terminal hydrogen."""
        return {i: self.near[i].bit_length() - 1 for i, e in enumerate(self.elements) if e == 1 and self.near[i].bit_count() == 1}

    def spread(self, start: int, within: int) -> int:
        """All that is reached from the mask ``start`` inside ``within``."""
        seen = front = start & within
        while front:
            step = 0
            for a in bits(front):
                step |= self.near[a]
            front = step & within & ~seen
            seen |= front
        return seen

    def pieces(self, atoms: int) -> list[int]:
        """Connected parts of a set of atoms, the largest first, then by smallest atom."""
        out = []
        while atoms:
            part = self.spread(atoms & -atoms, atoms)
            out.append(part)
            atoms &= ~part
        return sorted(out, key=lambda p: (-p.bit_count(), (p & -p).bit_length()))

    def stranded(self, removed: int) -> int:
        """What the removal cuts off from the largest rest."""
        out = 0
        for part in self.pieces(((1 << self.n) - 1) & ~removed)[1:]:
            out |= part
        return out

    def beyond(self, keep: int, start: int) -> int:
        """Reached from start without passing keep."""
        return self.spread(1 << start, ((1 << self.n) - 1) & ~(1 << keep))

    @cached_property
    def ring_bonds(self) -> frozenset[tuple[int, int]]:
        """Bonds whose ends stay connected without them."""
        whole, out = (1 << self.n) - 1, set()
        for a, b in self.bonds:
            seen = front = 1 << a
            while front:
                step = 0
                for x in bits(front):
                    near = self.near[x]
                    if x == a:
                        near &= ~(1 << b)
                    step |= near
                front = step & whole & ~seen
                seen |= front
            if seen >> b & 1:
                out.add((min(a, b), max(a, b)))
        return frozenset(out)

    @cached_property
    def rings(self) -> tuple[int, ...]:
        """A smallest set of smallest rings, as masks: for every ring bond the shortest way
        around it, taken by size while it isn't a sum of rings already taken. For cages, where
        the set isn't unique, ties go to the ring found first in bond order."""
        number = {bond: i for i, bond in enumerate(sorted(self.ring_bonds))}
        found = []
        for a, b in number:
            for path in self._shortest_around(a, b):
                edges = mask_of(number[min(x, y), max(x, y)] for x, y in zip(path, [*path[1:], path[0]], strict=True))
                found.append((len(path), mask_of(path), edges))
        basis: dict[int, int] = {}
        out: list[int] = []
        for _, atoms, edges in sorted(set(found)):
            rest = edges
            while rest:
                top = rest.bit_length()
                if top not in basis:
                    basis[top] = rest
                    out.append(atoms)
                    break
                rest ^= basis[top]
        return tuple(out)

    def _shortest_around(self, a: int, b: int) -> list[list[int]]:
        """All shortest paths from a to b that don't use their bond (64 at most)."""
        depth, front = {a: 0}, [a]
        while front and b not in depth:
            step = []
            for x in front:
                for y in bits(self.near[x]):
                    if y not in depth and not (x == a and y == b):
                        depth[y] = depth[x] + 1
                        step.append(y)
            front = step
        if b not in depth:
            return []
        done, todo = [], [[b]]
        while todo and len(done) < 64:
            path = todo.pop()
            if path[-1] == a:
                done.append(path)
                continue
            todo += [[*path, x] for x in bits(self.near[path[-1]]) if depth.get(x, -2) == depth[path[-1]] - 1 and not (path[-1] == b and x == a)]
        return done

    @cached_property
    def ring_atoms(self) -> int:
        out = 0
        for r in self.rings:
            out |= r
        return out

    def branches(self, center: int) -> dict[int, int]:
        """By neighbour over a bond outside rings: all that hangs there. Disjoint."""
        return {x: self.beyond(center, x) for x in bits(self.near[center]) if (min(center, x), max(center, x)) not in self.ring_bonds}


def connect(mol: Molecule, parts: list[int], cost: Callable[[int], float]) -> tuple[int, bool]:
    """Atoms that join the parts at small cost, and whether that is a heuristic: for two parts
    a cheapest path; for more, the cheapest path between any two, again and again."""
    parts, taken = [p for p in parts if p], 0
    heuristic = len(parts) > 2
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p.bit_count(), (p & -p).bit_length()))
        best = None
        for i, part in enumerate(parts[:-1]):
            rest = [(j, q) for j, q in enumerate(parts) if j > i]
            hit = _cheapest(mol, part, rest, parts, cost)
            if hit is not None and (best is None or (hit[0], i, hit[1]) < best[:3]):
                best = (hit[0], i, hit[1], hit[2])
        if best is None:
            raise ValueError("the structure itself is in pieces")
        _, i, j, path = best
        taken |= path
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j] | path]
    return taken, heuristic


def _cheapest(mol: Molecule, start: int, goals: list[tuple[int, int]], parts: list[int], cost: Callable[[int], float]) -> tuple[float, int, int] | None:
    """(cost, number of the goal, atoms on the way) of a cheapest way; other parts are free."""
    free = 0
    for p in parts:
        free |= p
    seen: dict[int, float] = {}
    heap = [(0.0, 0, a) for a in bits(start)]
    best = None
    while heap:
        d, path, a = heapq.heappop(heap)
        if seen.get(a, float("inf")) <= d:
            continue
        seen[a] = d
        for j, goal in goals:
            if goal >> a & 1 and (best is None or (d, j) < best[:2]):
                best = (d, j, path)
        if best is not None and d > best[0]:
            break
        for b in bits(mol.near[a]):
            step = 0.0 if free >> b & 1 else cost(b)
            if d + step < seen.get(b, float("inf")):
                heapq.heappush(heap, (d + step, path if free >> b & 1 else path | 1 << b, b))
    return best

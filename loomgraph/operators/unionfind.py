"""Disjoint sets, for the sequential part of grouped maps."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class Forest:
    """Sets of items that only ever merge; joins by size, halves paths on the way up."""

    def __init__(self, items: Iterable[Hashable]) -> None:
        self._up = {x: x for x in items}
        self._size = dict.fromkeys(self._up, 1)
        self.sets = len(self._up)

    def root(self, x: Hashable) -> Hashable:
        up = self._up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: Hashable, b: Hashable) -> bool:
        """Whether a and b were apart until now."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if self._size[a] < self._size[b]:
            a, b = b, a
        self._up[b] = a
        self._size[a] += self._size[b]
        self.sets -= 1
        return True

    def together(self, a: Hashable, b: Hashable) -> bool:
        return self.root(a) == self.root(b)

    def groups(self) -> list[list]:
        """The sets, each sorted, ordered by their first members."""
        out: dict[Hashable, list] = {}
        for x in self._up:
            out.setdefault(self.root(x), []).append(x)
        return sorted(sorted(g) for g in out.values())

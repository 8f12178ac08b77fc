"""What can be plugged in, by kind and name: metadata first, code when it is asked for."""

from __future__ import annotations

import importlib
import importlib.util
from dataclasses import dataclass
from typing import Any

KINDS = ("mapper", "scorer", "planner", "exporter", "intermediate")


@dataclass(frozen=True)
class Plugin:
    """``target`` is ``module:attribute[key]`` or ``module:attribute``; ``requires`` are modules."""

    kind: str
    name: str
    target: str
    requires: tuple[str, ...] = ()

    @property
    def missing(self) -> list[str]:
        return [m for m in self.requires if importlib.util.find_spec(m) is None]

    def load(self) -> Any:
        if self.missing:
            raise LookupError(f"{self.kind} {self.name!r} needs {self.missing}")
        module, _, rest = self.target.partition(":")
        attribute, _, key = rest.partition("[")
        found = getattr(importlib.import_module(module), attribute)
        return found[key.rstrip("]")] if key else found


class Registry:
    def __init__(self) -> None:
        self._plugins: dict[tuple[str, str], Plugin] = {}
        self._off: set[tuple[str, str]] = set()

    def register(self, plugin: Plugin) -> None:
        if plugin.kind not in KINDS:
            raise ValueError(f"no kind {plugin.kind!r}; there are {KINDS}")
        if (plugin.kind, plugin.name) in self._plugins:
            raise ValueError(f"{plugin.kind} {plugin.name!r} is there already")
        self._plugins[plugin.kind, plugin.name] = plugin

    def create(self, kind: str, name: str) -> Any:
        plugin = self._plugins.get((kind, name))
        if plugin is None or (kind, name) in self._off:
            raise LookupError(f"no {kind} {name!r}; there are {[p.name for p in self.list(kind)]}")
        return plugin.load()

    def switch(self, kind: str, name: str, on: bool) -> None:
        (self._off.discard if on else self._off.add)((kind, name))

    def list(self, kind: str | None = None) -> list[Plugin]:
        return sorted((p for k, p in self._plugins.items() if k not in self._off and kind in (None, p.kind)), key=lambda p: (p.kind, p.name))


def default() -> Registry:
    out = Registry()
    for name in ("mcss", "mcss-e", "mcss-e2", "cartograph", "identity"):
        out.register(Plugin("mapper", name, f"loomgraph.operators.mapping:MAPPERS[{name}]"))
    out.register(Plugin("mapper", "kartograf", "kartograf:KartografAtomMapper", ("kartograf",)))
    for name in ("linear", "lomaplike", "softcore-size", "variance"):
        out.register(Plugin("scorer", name, f"loomgraph.functions.scoring:SCORERS[{name}]"))
    for name in ("mst", "redundant-mst", "star", "explicit", "complete", "optimal"):
        out.register(Plugin("planner", name, f"loomgraph.plans.planners:PLANNERS[{name}]"))
    for name, target in (("json", "writers:network_json"), ("edgelist", "writers:write_edge_list"), ("graphml", "writers:graphml"), ("amber", "runfiles:write_runfiles"), ("html", "report:html_report")):
        out.register(Plugin("exporter", name, f"loomgraph.sources.{target}"))
    out.register(Plugin("intermediate", "pairmap", "loomgraph.operators.intermediates:propose"))
    out.register(Plugin("intermediate", "fragment-swap", "rdkit:Chem", ("rdkit",)))
    return out

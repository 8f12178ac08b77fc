"""Mapping and repairing pairs: the distributed hot path, one Arrow batch of pairs at a time.

``evaluate`` joins pairs to both structures and maps, prunes and repairs them in a grouped
Python stage; what SQL can decide (prechecks, geometry, scores) stays in SQL around it. A
pair that can't be mapped becomes a row with a reason, never an error.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators.molecule import Molecule, bits, connect, mask_of
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import CorePruning, MappingOptions, SoftcorePolicy


# ---------------------------------------------------------------- rigid fits


def kabsch(mobile: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift (x @ R.T + t) that bring mobile nearest to fixed, without mirroring."""
    if len(mobile) != len(fixed) or not len(mobile):
        raise ValueError("a fit needs as many points on both sides")
    a, b = mobile.mean(axis=0), fixed.mean(axis=0)
    u, _, vt = np.linalg.svd((mobile - a).T @ (fixed - b))
    sign = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag([1.0, 1.0, sign]) @ u.T
    return r, b - r @ a


def superpose(mobile: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    r, t = kabsch(mobile, fixed)
    return mobile @ r.T + t


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(axis=1).mean())) if len(a) else 0.0


def collinear(points: np.ndarray) -> bool:
    return len(points) < 3 or float(np.linalg.svd(points - points.mean(axis=0), compute_uv=False)[1]) < 0.1


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """A cheapest pairing of all rows (or all columns, if those are fewer): shortest augmenting
    paths with potentials, cubic in the size."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            done[j0] = True
            i0 = match[j0]
            open_ = ~done
            open_[0] = False
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = np.concatenate(([False], now < least[1:])) & open_
            least[better] = now[better[1:]]
            way[better] = j0
            j1 = int(np.where(open_, least, np.inf).argmin())
            delta = least[j1]
            u[match[done]] += delta
            v[done] -= delta
            least[open_] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


# ---------------------------------------------------------------- cores


@dataclass
class Cores:
    """The largest common cores of two structures, each embedding once, and whether the search
    came to its end: within its steps, and with all embeddings kept."""

    found: list[dict[int, int]]
    complete: bool


def common_cores(p: Molecule, q: Molecule, options: MappingOptions, elements: bool = False) -> Cores:
    """All largest connected common substructures of the heavy atoms, any bonds, by growing
    from every start pair; hydrogens are paired after."""
    best, steps, cut = 0, 0, False
    kept: dict[frozenset[tuple[int, int]], dict[int, int]] = {}
    valences = [[round(sum(o for (x, y), o in zip(m.bonds, m.orders or (1.0,) * len(m.bonds), strict=True) if i in (x, y))) for i in range(m.n)] for m in (p, q)] if options.match_valences else None

    def fits(a: int, b: int) -> bool:
        if (elements and p.elements[a] != q.elements[b]) or (valences and valences[0][a] != valences[1][b]):
            return False
        return not options.ring_matches_ring_only or (p.ring_atoms >> a & 1) == (q.ring_atoms >> b & 1)

    def bond_ok(a: int, x: int, b: int, y: int) -> bool:
        return not options.ring_matches_ring_only or ((min(a, x), max(a, x)) in p.ring_bonds) == ((min(b, y), max(b, y)) in q.ring_bonds)

    def keep(core: dict[int, int]) -> None:
        nonlocal best, cut
        core = whole_rings(p, q, core) if options.complete_rings_only else core
        if len(core) < max(best, 1):
            return
        if len(core) > best:
            best = len(core)
            kept.clear()
        if len(kept) < options.max_matches:
            kept.setdefault(frozenset(core.items()), dict(core))
        else:
            cut = cut or frozenset(core.items()) not in kept

    def grow(core: dict[int, int], used: int, barred: frozenset[tuple[int, int]]) -> None:
        nonlocal steps, cut
        steps += 1
        keep(core)
        if steps > options.max_steps:
            cut = True
            return
        room = len(core) + min((p.heavy & ~mask_of(core)).bit_count(), (q.heavy & ~used).bit_count())
        if room < best:
            return
        for x, y in sorted(core.items()):
            for a in bits(p.near[x] & p.heavy):
                if a in core:
                    continue
                for b in sorted(bits(q.near[y] & q.heavy & ~used), key=lambda b: float(((p.points[a] - q.points[b]) ** 2).sum())):
                    if (a, b) in barred or not fits(a, b) or not bond_ok(x, a, y, b):
                        continue
                    if all(bool(p.near[a] >> i & 1) == bool(q.near[b] >> j & 1) for i, j in core.items()):
                        core[a] = b
                        grow(core, used | 1 << b, barred)
                        del core[a]
                        barred = barred | {(a, b)}
                        if steps > options.max_steps:
                            return

    starts = sorted(((float(((p.points[a] - q.points[b]) ** 2).sum()), a, b) for a in bits(p.heavy) for b in bits(q.heavy) if fits(a, b)))
    barred: frozenset[tuple[int, int]] = frozenset()
    for i, (_, a, b) in enumerate(starts):
        if steps > options.max_steps:
            break
        # no start that is left can hold as many pairs as the best core
        left_1, left_2 = (mask_of(x[k] for x in starts[i:]).bit_count() for k in (1, 2))
        if min(left_1, left_2) < best:
            break
        grow({a: b}, 1 << b, barred)
        barred = barred | {(a, b)}
    return Cores(list(kept.values()), not cut)


def choose_core(p: Molecule, q: Molecule, found: list[dict[int, int]], how: str) -> dict[int, int]:
    """One of equally large cores. fewest_fragments: connected changed regions, then RMSD in
    place; best_rmsd: the other way round; first: as found, the nearest start first. What is
    equal in both goes by its atoms."""
    if not found or how == "first":
        return found[0] if found else {}

    def rank(core: dict[int, int]) -> tuple:
        regions = float(sum(len(m.pieces(m.heavy & ~mask_of(x))) for m, x in ((p, core), (q, core.values()))))
        off = round(rmsd(p.points[list(core)], q.points[list(core.values())]), 9)
        return (*((regions, off) if how == "fewest_fragments" else (off, regions)), sorted(core.items()))

    return min(found, key=rank)


def common_core(p: Molecule, q: Molecule, options: MappingOptions, elements: bool = False) -> dict[int, int]:
    return choose_core(p, q, common_cores(p, q, options, elements).found, options.match_selection)


def whole_rings(p: Molecule, q: Molecule, core: dict[int, int]) -> dict[int, int]:
    """Without ring atoms of rings that aren't mapped whole, on either side, to a fixpoint."""
    core = dict(core)
    while True:
        drop = set()
        for mol, mine in ((p, mask_of(core)), (q, mask_of(core.values()))):
            kept = 0
            for ring in mol.rings:
                if ring & ~mine == 0:
                    kept |= ring
            bad = mol.ring_atoms & mine & ~kept
            drop |= {a for a, b in core.items() if bad >> (a if mol is p else b) & 1}
        if not drop:
            return core
        core = {a: b for a, b in core.items() if a not in drop}


def pair_hydrogens(p: Molecule, q: Molecule, core: dict[int, int]) -> dict[int, int]:
    """The core with hydrogens of paired parents, paired by least summed squares of distance."""
    out = dict(core)
    for x, y in core.items():
        hs, ht = ([h for h, parent in m.parents.items() if parent == a] for m, a in ((p, x), (q, y)))
        if hs and ht:
            cost = ((p.points[hs][:, None] - q.points[ht][None]) ** 2).sum(axis=2)
            out |= {hs[i]: ht[j] for i, j in assign(cost)}
    return out


def cartograph(p: Molecule, q: Molecule, options: MappingOptions) -> dict[int, int]:
    """Pairs of near atoms in the common frame (least summed distance, up to the threshold),
    without those that differ in kind, break rings or bonds, or stand apart."""
    d = np.sqrt(((p.points[:, None] - q.points[None]) ** 2).sum(axis=2))
    core = {i: j for i, j in assign(d) if d[i, j] <= options.distance_threshold}
    ring_sizes = lambda m, a: {r.bit_count() for r in m.rings if r >> a & 1}
    core = {a: b for a, b in core.items() if (p.elements[a] == 1) == (q.elements[b] == 1)}
    core = {a: b for a, b in core.items() if (p.ring_atoms >> a & 1) == (q.ring_atoms >> b & 1)}
    core = {a: b for a, b in core.items() if not ring_sizes(p, a) or ring_sizes(p, a) & ring_sizes(q, b)}
    core = whole_rings(p, q, core)
    while True:  # bonds between core atoms exist on both sides
        back = {b: a for a, b in core.items()}
        bad = {a for a, b in core.items() if any(x in core and not q.near[b] >> core[x] & 1 for x in bits(p.near[a])) or any(y in back and not p.near[a] >> back[y] & 1 for y in bits(q.near[b]))}
        if not bad:
            break
        worst = max(bad, key=lambda a: (d[a, core[a]], a))
        core = {a: b for a, b in core.items() if a != worst}
    parts = p.pieces(mask_of(core))
    return {a: b for a, b in core.items() if parts and parts[0] >> a & 1}


def mcss(p: Molecule, q: Molecule, options: MappingOptions, elements: bool = False) -> tuple[dict[int, int], bool]:
    """The chosen common core with its hydrogens, and whether the search came to its end."""
    cores = common_cores(p, q, options, elements)
    return pair_hydrogens(p, q, choose_core(p, q, cores.found, options.match_selection)), cores.complete


#: Each gives the core of a pair and whether nothing was left untried.
MAPPERS = {
    "mcss": mcss,
    "mcss-e": mcss,
    "mcss-e2": lambda p, q, o: mcss(p, q, o, elements=True),
    "cartograph": lambda p, q, o: (cartograph(p, q, o), True),
    "identity": lambda p, q, o: ({i: i for i in range(min(p.n, q.n))}, True),
}


def prune(p: Molecule, q: Molecule, core: dict[int, int], policy: CorePruning) -> dict[int, int]:
    """Without pairs whose properties differ as the policy says. A hydrogen paired with a heavy
    atom takes the heavy side's less conserved branches along."""

    # structures may come without charges and flags
    charges, aromatic = [m.charges or (0,) * m.n for m in (p, q)], [m.aromatic or (False,) * m.n for m in (p, q)]

    def differs(a: int, b: int) -> bool:
        tests = (
            (policy.demote_element_mismatch, p.elements[a], q.elements[b]), (policy.demote_degree_mismatch, p.near[a].bit_count(), q.near[b].bit_count()),
            (policy.demote_formal_charge_mismatch, charges[0][a], charges[1][b]), (policy.demote_aromaticity_mismatch, aromatic[0][a], aromatic[1][b]),
            (policy.demote_ring_membership_mismatch, p.ring_atoms >> a & 1, q.ring_atoms >> b & 1),
        )
        return any(on and x != y for on, x, y in tests)

    def branch(m: Molecule, mine: int, center: int) -> int:
        held = {x: (atoms & mine).bit_count() for x, atoms in m.branches(center).items()}
        out = 0
        if len(held) > 1:
            for x, atoms in m.branches(center).items():
                if held[x] < max(held.values()):
                    out |= atoms
        return out

    out_1 = out_2 = 0
    for a, b in core.items():
        if policy.demote_light_element_swap and (p.elements[a] == 1) != (q.elements[b] == 1):
            out_1 |= 1 << a | (branch(p, mask_of(core), a) if p.elements[a] != 1 else 0)
            out_2 |= 1 << b | (branch(q, mask_of(core.values()), b) if q.elements[b] != 1 else 0)
        elif differs(a, b):
            out_1, out_2 = out_1 | 1 << a, out_2 | 1 << b
    return {a: b for a, b in core.items() if not out_1 >> a & 1 and not out_2 >> b & 1}


# ---------------------------------------------------------------- repair


@dataclass
class Repair:
    """What the repair did; on rejection the core is the one that came in."""

    core: dict[int, int]
    fragments_before: tuple[int, int]
    fragments_after: tuple[int, int]
    demoted_1: list[int]
    demoted_2: list[int]
    iterations: int
    rejection: str | None
    trace: list[str]


def repair(p: Molecule, q: Molecule, core: dict[int, int], policy: SoftcorePolicy) -> Repair:
    """Makes the changed region of each side one connected substituent.

    Closure: a ring with a changed atom changes whole, hydrogens follow their parents, a partner
    follows its partner. Then rounds: join the regions by a cheap set of core atoms (an atom
    costs what its closure takes along), take in what is cut off, close again, check the budget.
    """
    back = {b: a for a, b in core.items()}
    whole = ((1 << p.n) - 1, (1 << q.n) - 1)
    start = (whole[0] & ~mask_of(core), whole[1] & ~mask_of(back))
    sides = (p, q)
    costs: dict[tuple[int, int], float] = {}

    def close(s1: int, s2: int) -> tuple[int, int]:
        soft = [s1, s2]
        while True:
            old = tuple(soft)
            for k, mol in enumerate(sides):
                if policy.ring_policy == "ring_system":
                    for ring in mol.rings:
                        if ring & soft[k]:
                            soft[k] |= ring
                for h, parent in mol.parents.items():
                    if soft[k] >> parent & 1:
                        soft[k] |= 1 << h
            soft[1] |= mask_of(core[a] for a in bits(soft[0]) if a in core)
            soft[0] |= mask_of(back[b] for b in bits(soft[1]) if b in back)
            if tuple(soft) == old:
                return old

    def price(k: int):
        def of(a: int) -> float:
            if (k, a) not in costs:
                both = close(1 << a if k == 0 else 0, 1 << a if k == 1 else 0)
                costs[k, a] = float(both[0].bit_count() + both[1].bit_count())
            return costs[k, a]

        return of

    def over_budget(soft: tuple[int, int]) -> str | None:
        if any(s == w for s, w in zip(soft, whole, strict=True)):
            return "no_common_core"
        if sum(1 for a in core if not soft[0] >> a & 1 and p.heavy >> a & 1) < policy.min_core_atoms:
            return "core_too_small"
        sizes = [(s & m.heavy).bit_count() for s, m in zip(soft, sides, strict=True)]
        if max(sizes) > policy.max_softcore_atoms:
            return "softcore_too_large"
        if any(m.heavy and z / m.heavy.bit_count() > policy.max_softcore_fraction for z, m in zip(sizes, sides, strict=True)):
            return "softcore_fraction_exceeded"
        return None

    soft = close(*start)
    parts = [m.pieces(s) for m, s in zip(sides, soft, strict=True)]
    before = (len(parts[0]), len(parts[1]))
    trace = [f"regions {before[0]}/{before[1]}"]
    reason, done = None, 0
    limit = policy.max_iterations or p.n + q.n
    for done in range(limit + 1):
        parts = [m.pieces(s) for m, s in zip(sides, soft, strict=True)]
        lost = [m.stranded(s) for m, s in zip(sides, soft, strict=True)]
        if max(map(len, parts)) <= 1 and not any(lost):
            break
        if done == limit:
            reason = "repair_did_not_converge"
            break
        grown = list(soft)
        for k, mol in enumerate(sides):
            if len(parts[k]) > 1:
                taken, heuristic = connect(mol, parts[k], price(k))
                grown[k] |= taken
                trace.append(f"round {done + 1} side {k + 1}: {len(parts[k])} regions joined by {sorted(bits(taken))}" + " (heuristic)" * heuristic)
        for k, mol in enumerate(sides):
            if cut := mol.stranded(grown[k]):
                grown[k] |= cut
                trace.append(f"round {done + 1} side {k + 1}: took in {sorted(bits(cut))}")
        soft = close(*grown)
        if reason := over_budget(soft):
            break
    reason = reason or over_budget(soft)
    if reason is None and any(s and sum((m.near[a] & ~s).bit_count() for a in bits(s)) != 1 for m, s in zip(sides, soft, strict=True)):
        reason = "softcore_multiple_attachments"
    after = tuple(len(m.pieces(s)) for m, s in zip(sides, soft, strict=True))
    if reason:
        trace.append(f"rejected: {reason}")
    new = core if reason else {a: b for a, b in core.items() if not soft[0] >> a & 1}
    return Repair(new, before, after, sorted(bits(soft[0] & ~start[0])), sorted(bits(soft[1] & ~start[1])), done, reason, trace)


# ---------------------------------------------------------------- over tables

RESULT = "cc1 array<int>, cc2 array<int>, sc1 array<int>, sc2 array<int>, method string, reason string, fragments_before array<int>, fragments_after array<int>, demoted_1 array<int>, demoted_2 array<int>, iterations int, trace array<string>, complete boolean"


def _result(p: Molecule, q: Molecule, core: dict[int, int], method: str, reason: str | None, r: Repair | None, complete: bool = True) -> dict:
    """A row of RESULT."""
    a, b = sorted(core), [core[x] for x in sorted(core)]
    return {
        "cc1": a, "cc2": b, "sc1": [x for x in range(p.n) if x not in core], "sc2": sorted(set(range(q.n)) - set(b)), "method": method, "reason": reason,
        "fragments_before": list(r.fragments_before) if r else [0, 0], "fragments_after": list(r.fragments_after) if r else [0, 0],
        "demoted_1": r.demoted_1 if r else [], "demoted_2": r.demoted_2 if r else [], "iterations": r.iterations if r else 0, "trace": r.trace if r else [], "complete": complete,
    }


def map_pair(p: Molecule, q: Molecule, mapper: str, options: MappingOptions, policy: SoftcorePolicy, charges_differ: bool = False) -> dict:
    """One pair mapped, pruned, prechecked and repaired, as a row of RESULT."""

    def row(core: dict[int, int], reason: str | None, r: Repair | None = None) -> dict:
        return _result(p, q, core, mapper, reason, r, complete)

    complete = True
    try:
        core, complete = MAPPERS[mapper](p, q, options)
    except (ValueError, IndexError):
        return row({}, "mapper_failed")
    if mapper != "identity":
        core = prune(p, q, core, CorePruning.preset(mapper) if mapper.startswith("mcss") else options.core_pruning)
    held = sum(1 for a in core if p.heavy >> a & 1)
    smaller = min(p.heavy.bit_count(), q.heavy.bit_count())
    if held == 0:
        return row(core, "no_common_core")
    if smaller and held / smaller < policy.min_mcs_fraction:
        return row(core, "mcs_fraction_too_low")
    if charges_differ and policy.charge_change_policy == "reject":
        return row(core, "net_charge_change")
    try:
        r = repair(p, q, core, policy)
    except ValueError:
        return row(core, "softcore_fragmented")
    return row(r.core, r.rejection, r)


def evaluate(pairs: DataFrame, vertices: DataFrame, mapper: str = "mcss-e2", options: MappingOptions | None = None, policy: SoftcorePolicy | None = None) -> DataFrame:
    """pairs (campaign, source, target ...) with the columns of RESULT. Structures travel once
    per pair to the task that maps it; batches are small, as a search may be slow."""
    options, policy = options or MappingOptions(), policy or SoftcorePolicy()
    v = vertices.select(KEY, "name", "charge", "atoms", "bonds")
    one, two = (v.select(KEY, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "charge", "atoms", "bonds")]) for s in (1, 2))
    # by number, as few rows of structures would be put into one task again
    n = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = pairs.select(KEY, "source", "target").join(one.withColumnRenamed("name_1", "source"), [KEY, "source"]).join(two.withColumnRenamed("name_2", "target"), [KEY, "target"])
    kind = vertices.schema[KEY].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            known: dict[str, Molecule] = {}
            rows = []
            for r in pdf.itertuples():
                sides = []
                for name, atoms, bonds in ((r.source, r.atoms_1, r.bonds_1), (r.target, r.atoms_2, r.bonds_2)):
                    key = f"{getattr(r, KEY)}|{name}"
                    if key not in known:
                        known[key] = Molecule.of(_rows(atoms), _rows(bonds))
                    sides.append(known[key])
                rows.append({KEY: getattr(r, KEY), "source": r.source, "target": r.target, **map_pair(*sides, mapper, options, policy, r.charge_1 != r.charge_2)})
            yield pd.DataFrame(rows)

    return joined.repartition(n, KEY, "source", "target").mapInPandas(run, f"{KEY} {kind}, source string, target string, {RESULT}")


def _rows(xs) -> list[dict]:
    return [x if isinstance(x, dict) else x.asDict() for x in xs]


def cores_by_vertex(mapped: DataFrame) -> DataFrame:
    """(campaign, name, atom): core atoms that a vertex has in all its mapped pairs: per atom
    the pairs that hold it, kept where those are all. No array is intersected in a task."""
    ends = mapped.select(KEY, F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("cc1").alias("core")), F.struct(F.col("target").alias("name"), F.col("cc2").alias("core")))).alias("x")).select(KEY, "x.*")
    pairs = ends.groupBy(KEY, "name").agg(F.count("*").alias("n"))
    held = ends.select(KEY, "name", F.explode("core").alias("atom")).groupBy(KEY, "name", "atom").agg(F.count("*").alias("k"))
    return held.join(pairs, [KEY, "name"]).where("k = n").select(KEY, "name", "atom")


def consistent(edges: DataFrame, vertices: DataFrame, policy: SoftcorePolicy | None = None) -> DataFrame:
    """edges (campaign, source, target, cc1, cc2, method) with one core for every vertex over all
    its edges, as rows like those of ``evaluate``. Cores meet only over shared vertices, so a
    group is a connected part of a campaign; an edge that can't be repaired any more is an error."""
    policy = policy or SoftcorePolicy()
    kind = vertices.schema[KEY].dataType.simpleString()
    named = edges.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    part = G.components(vertices, named)
    inside = edges.select(KEY, "source", "target", "cc1", "cc2", "method").join(part.select(KEY, F.col("name").alias("source"), "component"), [KEY, "source"])
    held = vertices.select(KEY, "name", "atoms", "bonds").join(fresh(part), [KEY, "name"])

    def one(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        mols = {r.name: Molecule.of(_rows(r.atoms), _rows(r.bonds)) for r in v.itertuples(index=False)}
        e = e.sort_values(["source", "target"])
        mapped = [(r.source, r.target, dict(zip(map(int, r.cc1), map(int, r.cc2), strict=True))) for r in e.itertuples(index=False)]
        rows = []
        for (s, t, r), method in zip(make_consistent(mapped, mols, policy) if mapped else [], e.method, strict=True):
            rows.append({KEY: key[0], "source": s, "target": t, **_result(mols[s], mols[t], r.core, method, None, r)})
        return pd.DataFrame(rows, columns=[KEY, "source", "target", *[x.split()[0] for x in RESULT.split(", ")]])

    return held.groupBy(KEY, "component").cogroup(fresh(inside).groupBy(KEY, "component")).applyInPandas(one, f"{KEY} {kind}, source string, target string, {RESULT}")


def make_consistent(mapped: list[tuple[str, str, dict[int, int]]], mols: dict[str, Molecule], policy: SoftcorePolicy, rounds: int = 50) -> list[tuple[str, str, Repair]]:
    """Gives every vertex one core over all its pairs: intersect, restrict, repair, until nothing
    changes. Heavy atoms are intersected by index, hydrogens by number per parent, the lowest
    kept. A pair that can't be repaired any more is an error."""
    now = [(s, t, dict(core)) for s, t, core in mapped]
    for _ in range(rounds):
        keep: dict[str, int] = {}
        caps: dict[str, dict[int, int]] = {}
        for s, t, core in now:
            for name, atoms in ((s, set(core)), (t, set(core.values()))):
                mol = mols[name]
                heavy = mask_of(a for a in atoms if mol.heavy >> a & 1)
                keep[name] = keep.get(name, heavy) & heavy
                counts: dict[int, int] = {}
                for h in atoms:
                    if h in mol.parents:
                        counts[mol.parents[h]] = counts.get(mol.parents[h], 0) + 1
                caps[name] = counts if name not in caps else {k: min(n, counts.get(k, 0)) for k, n in caps[name].items()}
        new, out = [], []
        for s, t, core in now:
            p, q = mols[s], mols[t]
            held = {a: b for a, b in core.items() if keep[s] >> a & 1 and keep[t] >> b & 1}
            for a, b in list(held.items()):
                some = min(caps[s].get(a, 0), caps[t].get(b, 0))
                hs, ht = (sorted(h for h, x in m.parents.items() if x == at)[:some] for m, at in ((p, a), (q, b)))
                held |= dict(itertools.zip_longest(hs, ht)) if len(hs) == len(ht) else {}
            r = repair(p, q, held, policy)
            if r.rejection:
                raise ValueError(f"{s}~{t} has no consistent core: {r.rejection}")
            new.append((s, t, r.core))
            out.append((s, t, r))
        if new == now:
            return out
        now = new
    raise ValueError("cores did not settle")

"""Bringing all structures of a campaign into one frame.

A tree grows from the reference to the vertices that are most similar to one already placed;
each is fitted to its parent on the heavy atoms of their common core. The order is sequential
within a campaign, so a campaign is one group of a grouped map.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import mapping as M
from loomgraph.operators.molecule import Molecule, mask_of
from loomgraph.operators.pairs import KEY, fresh
from loomgraph.plans.options import MappingOptions

MIN_ATOMS = 3


def reference_of(names: list[str], heavy: list[int], wanted: str | None = None) -> str:
    """The wanted vertex, or the one with the most heavy atoms, the first by name on ties."""
    if not names:
        raise ValueError("nothing to align")
    if wanted is not None and wanted not in names:
        raise ValueError(f"no vertex {wanted!r} to align to")
    return wanted or min(zip(names, heavy, strict=True), key=lambda x: (-x[1], x[0]))[0]


def order(names: list[str], similarity: dict[tuple[str, str], float], root: str) -> list[tuple[str, str]]:
    """(vertex, parent) in the order of placement: always the most similar of a placed and an
    open vertex next; ties by the open one's name, then the parent's."""
    best = {x: (-similarity.get((min(x, root), max(x, root)), 0.0), root) for x in names if x != root}
    out = []
    while best:
        x = min(best, key=lambda k: (best[k][0], k, best[k][1]))
        out.append((x, best.pop(x)[1]))
        for y in best:
            best[y] = min(best[y], (-similarity.get((min(x, y), max(x, y)), 0.0), x))
    return out


def align(vertices: DataFrame, sims: DataFrame, reference: str | None = None, star: bool = False, options: MappingOptions | None = None) -> DataFrame:
    """(campaign, name, parent, n_fit_atoms, rmsd, ok, note, points): points are arrays of x, y,
    z after the move. sims (campaign, u, v, sim) steer the tree; ``star`` fits all to the root."""
    options = options or MappingOptions()
    kind = vertices.schema[KEY].dataType.simpleString()
    columns = [KEY, "name", "parent", "n_fit_atoms", "rmsd", "ok", "note", "points"]

    def one(key: tuple, v: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        mols = {r.name: Molecule.of(M._rows(r.atoms), M._rows(r.bonds)) for r in v.itertuples(index=False)}
        names = sorted(mols)
        if not names:
            return pd.DataFrame([], columns=columns)
        root = reference_of(names, [mols[x].heavy.bit_count() for x in names], reference)
        sim = {(r.u, r.v): r.sim for r in s.itertuples(index=False)}
        placed = {root: mols[root].points}
        rows = [(key[0], root, None, 0, 0.0, True, "", placed[root].tolist())]
        for x, parent in [(x, root) for x in names if x != root] if star else order(names, sim, root):
            p, q = mols[x], mols[parent]
            core = M.common_core(p, Molecule(q.elements, q.bonds, placed[parent], q.charges, q.aromatic), options)
            a, b = list(core), list(core.values())
            if len(a) < MIN_ATOMS:
                placed[x] = p.points
                rows.append((key[0], x, parent, len(a), None, False, "too few common atoms", p.points.tolist()))
                continue
            r, t = M.kabsch(p.points[a], placed[parent][b])
            placed[x] = p.points @ r.T + t
            note = "the fitted atoms are nearly on a line" if M.collinear(placed[parent][b]) else ""
            rows.append((key[0], x, parent, len(a), M.rmsd(placed[x][a], placed[parent][b]), True, note, placed[x].tolist()))
        return pd.DataFrame(rows, columns=columns)

    cols = vertices.select(KEY, "name", "atoms", "bonds")
    return cols.groupBy(KEY).cogroup(fresh(sims.select(KEY, "u", "v", "sim")).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, name string, parent string, n_fit_atoms int, rmsd double, ok boolean, note string, points array<array<double>>")


def median_rmsd(aligned: DataFrame) -> DataFrame:
    """(campaign, median_rmsd) over the vertices that were moved."""
    return aligned.where("ok AND parent IS NOT NULL").groupBy(KEY).agg(F.median("rmsd").alias("median_rmsd"))


def path_fingerprint(mol: Molecule, longest: int = 5, size: int = 2048) -> list[int]:
    """Bits of all heavy-atom paths of up to so many atoms, by their elements: a fingerprint of
    our own, for prefilters and trees where no toolkit's is at hand."""
    import zlib

    out = set()
    heavy = mask_of(i for i, e in enumerate(mol.elements) if e != 1)

    def walk(path: tuple[int, ...]) -> None:
        word = [mol.elements[a] for a in path]
        out.add(zlib.crc32(bytes(min(word, word[::-1]))) % size)
        if len(path) < longest:
            for b in range(mol.n):
                if mol.near[path[-1]] >> b & 1 and heavy >> b & 1 and b not in path:
                    walk((*path, b))

    for a in range(mol.n):
        if heavy >> a & 1:
            walk((a,))
    return sorted(out)


def with_fingerprints(vertices: DataFrame) -> DataFrame:
    """vertices with ``fp``, in Arrow batches."""
    schema = T.StructType([*vertices.drop("fp").schema.fields, T.StructField("fp", T.ArrayType(T.IntegerType()))])

    def run(frames):
        for pdf in frames:
            pdf = pdf.copy()
            pdf["fp"] = [path_fingerprint(Molecule.of(M._rows(a), M._rows(b))) for a, b in zip(pdf.atoms, pdf.bonds, strict=True)]
            yield pdf

    return vertices.drop("fp").mapInPandas(run, schema)


def moved(vertices: DataFrame, aligned: DataFrame) -> DataFrame:
    """vertices with the points of ``aligned``."""
    joined = vertices.join(aligned.select(KEY, "name", "points"), [KEY, "name"])
    atom = F.transform("atoms", lambda a, i: a.withField("x", F.get(F.get("points", i), F.lit(0))).withField("y", F.get(F.get("points", i), F.lit(1))).withField("z", F.get(F.get("points", i), F.lit(2))))
    return joined.withColumn("atoms", atom).drop("points")



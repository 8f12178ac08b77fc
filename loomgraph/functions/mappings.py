"""Atom mappings as struct columns and higher-order functions: no UDF.

A mapping is struct<cc1, cc2, sc1, sc2: array<int>, n_atoms_1, n_atoms_2: int, method:
string>; cc1[i] is mapped on cc2[i], and cc and sc of a side hold each of its atoms once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def from_core(core_1: Column, core_2: Column, n_1: Column, n_2: Column, method: str = "given") -> Column:
    """The mapping with this core; pairs are sorted together by the first side."""
    pairs = F.array_sort(F.arrays_zip(core_1.alias("a"), core_2.alias("b")))
    return F.struct(
        F.transform(pairs, lambda p: p["a"]).alias("cc1"),
        F.transform(pairs, lambda p: p["b"]).alias("cc2"),
        F.array_sort(F.array_except(_all(n_1), core_1)).alias("sc1"),
        F.array_sort(F.array_except(_all(n_2), core_2)).alias("sc2"),
        n_1.cast("int").alias("n_atoms_1"),
        n_2.cast("int").alias("n_atoms_2"),
        F.lit(method).alias("method"),
    )


def identity(n_1: Column, n_2: Column) -> Column:
    """Atom i on atom i, as far as both sides go."""
    return from_core(_all(F.least(n_1, n_2)), _all(F.least(n_1, n_2)), n_1, n_2, "identity")


def swapped(m: Column) -> Column:
    return from_core(m["cc2"], m["cc1"], m["n_atoms_2"], m["n_atoms_1"]).withField("method", m["method"])


def forward(m: Column) -> Column:
    return F.map_from_arrays(m["cc1"], m["cc2"])


def problem(m: Column) -> Column:
    """What is wrong with a mapping, or null."""

    def side(cc: Column, sc: Column, n: Column, k: int) -> list[tuple[Column, str]]:
        both = F.concat(cc, sc)
        return [
            (F.size(F.array_distinct(cc)) != F.size(cc), f"core of side {k} repeats an atom"),
            (F.exists(both, lambda x: (x < 0) | (x >= n)), f"side {k} names an atom out of range"),
            ((F.size(both) != n) | (F.size(F.array_distinct(both)) != n), f"side {k} is not a partition of its atoms"),
        ]

    out = F.when(F.size(m["cc1"]) != F.size(m["cc2"]), "cores differ in size")
    for test, text in [*side(m["cc1"], m["sc1"], m["n_atoms_1"], 1), *side(m["cc2"], m["sc2"], m["n_atoms_2"], 2)]:
        out = out.when(test, text)
    return out


def rmsd(points_1: Column, points_2: Column) -> Column:
    """Root mean square distance of paired points (arrays of structs x, y, z), in place."""
    squares = F.zip_with(points_1, points_2, lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) + F.pow(p["z"] - q["z"], 2))
    return F.when(F.size(points_1) > 0, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.size(points_1))).otherwise(0.0)


def descriptors(m: Column, v1: Column, v2: Column) -> dict[str, Column]:
    """The descriptors of a pair that need no chemistry backend. v1 and v2 are vertex structs
    (charge, n_heavy, atoms: array<struct<idx, elem, x, y, z ...>>, rings: array<array<int>>)."""

    def heavy_in(side: Column, atoms: Column) -> Column:
        return F.size(F.filter(atoms, lambda a: (a["elem"] != 1) & F.array_contains(side, a["idx"]))).cast("double")

    def points(v: Column, core: Column) -> Column:
        return F.transform(core, lambda i: F.get(v["atoms"], i))

    def ring_atoms(v: Column, soft: Column) -> Column:
        return F.size(F.array_intersect(F.flatten(v["rings"]), soft)).cast("double")

    soft_1, soft_2, core = heavy_in(m["sc1"], v1["atoms"]), heavy_in(m["sc2"], v2["atoms"]), heavy_in(m["cc1"], v1["atoms"])
    rings_1, rings_2 = F.size(v1["rings"]).cast("double"), F.size(v2["rings"]).cast("double")
    h1, h2 = v1["n_heavy"].cast("double"), v2["n_heavy"].cast("double")
    p, q = points(v1, m["cc1"]), points(v2, m["cc2"])
    farthest = F.array_max(F.zip_with(p, q, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))))
    smaller = F.least(h1, h2)
    return {
        "n_core_heavy": core,
        "n_softcore_heavy_1": soft_1,
        "n_softcore_heavy_2": soft_2,
        "n_softcore_max_heavy": F.greatest(soft_1, soft_2),
        "softcore_asymmetry": F.abs(soft_1 - soft_2),
        "n_heavy_1": h1,
        "n_heavy_2": h2,
        "heavy_atom_delta": F.abs(h1 - h2),
        "charge_delta": F.abs(v1["charge"] - v2["charge"]).cast("double"),
        "n_rings_1": rings_1,
        "n_rings_2": rings_2,
        "ring_delta": F.abs(rings_1 - rings_2),
        "n_ring_atoms_in_softcore": F.greatest(ring_atoms(v1, m["sc1"]), ring_atoms(v2, m["sc2"])),
        "mcs_fraction": core / F.when(smaller > 0, smaller).otherwise(1.0),
        "core_rmsd": rmsd(p, q),
        "core_max_pair_distance": F.coalesce(farthest, F.lit(0.0)),
    }

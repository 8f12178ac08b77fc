"""Readers of structure files: SDF and MOL (V2000), mol2, SMILES lists. Files are read by
Spark as whole texts and parsed in Arrow batches; a record that can't be read is skipped and
counted, as one bad record shouldn't end a load of millions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.keys import sanitize_name
from loomgraph.operators.molecule import Molecule, bits
from loomgraph.operators.pairs import KEY, check_names

#: Element symbols by number from 1.
SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I".split()
NUMBERS = {s: i + 1 for i, s in enumerate(SYMBOLS)}
#: Charge codes of V2000 atom lines.
V2000_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}
SCHEMA = "raw string, fallback string, ord long, charge int, atoms array<struct<idx: int, elem: int, name: string, x: double, y: double, z: double, charge: int, aromatic: boolean>>, bonds array<struct<a: int, b: int, order: double, in_ring: boolean>>, rings array<array<int>>, source string"


def _row(raw: str, fallback: str, atoms: list[dict], bonds: list[dict], source: str, place: int) -> dict:
    mol = Molecule.of(atoms, bonds)
    for b in bonds:
        b["in_ring"] = (min(b["a"], b["b"]), max(b["a"], b["b"])) in mol.ring_bonds
    return {"raw": raw, "fallback": fallback, "ord": place, "charge": sum(a["charge"] for a in atoms), "atoms": atoms, "bonds": bonds, "rings": [list(bits(r)) for r in mol.rings], "source": source}


def parse_v2000(block: str) -> tuple[str, list[dict], list[dict]]:
    lines = block.splitlines()
    counts = lines[3]
    if "V2000" not in counts:
        raise ValueError("not a V2000 block")
    n, m = int(counts[:3]), int(counts[3:6])
    atoms = []
    for i, x in enumerate(lines[4 : 4 + n]):
        symbol = x[31:34].strip()
        atoms.append({"idx": i, "elem": NUMBERS[symbol], "name": f"{symbol.upper()}{i + 1}", "x": float(x[:10]), "y": float(x[10:20]), "z": float(x[20:30]), "charge": V2000_CHARGES.get(int(x[36:39].strip() or 0), 0), "aromatic": False})
    bonds = [{"a": int(x[:3]) - 1, "b": int(x[3:6]) - 1, "order": 1.5 if int(x[6:9]) == 4 else float(int(x[6:9]))} for x in lines[4 + n : 4 + n + m]]
    charged = [x for x in lines[4 + n + m :] if x.startswith("M  CHG")]
    if charged:
        for a in atoms:
            a["charge"] = 0
    for x in charged:
        f = x.split()[3:]
        for at, q in zip(f[::2], f[1::2], strict=True):
            atoms[int(at) - 1]["charge"] = int(q)
    for b in bonds:
        if b["order"] == 1.5:
            atoms[b["a"]]["aromatic"] = atoms[b["b"]]["aromatic"] = True
    return lines[0].strip(), atoms, bonds


def parse_sdf(text: str, stem: str, source: str, name_property: str | None = None) -> Iterator[dict]:
    records = [r[1:] if i and r.startswith("\n") else r for i, r in enumerate(text.replace("\r\n", "\n").split("$$$$"))]
    for i, record in enumerate(r for r in records if r.strip()):
        try:
            title, atoms, bonds = parse_v2000(record)
        except (ValueError, KeyError, IndexError):
            continue
        found = re.search(rf">\s*<{re.escape(name_property)}>[^\n]*\n([^\n]*)", record) if name_property else None
        yield _row(found[1].strip() if found else title, f"{stem}_{i}", atoms, bonds, source, i)


def parse_mol2(text: str, stem: str, source: str) -> Iterator[dict]:
    for i, record in enumerate(text.replace("\r\n", "\n").split("@<TRIPOS>MOLECULE")[1:]):
        try:
            parts = dict(re.findall(r"@<TRIPOS>(\w+)\n(.*?)(?=@<TRIPOS>|\Z)", "@<TRIPOS>MOLECULE" + record, re.S))
            atoms, bonds = [], []
            for k, line in enumerate(x for x in parts["ATOM"].splitlines() if x.strip()):
                f = line.split()
                symbol = f[5].split(".")[0].capitalize()
                if symbol not in NUMBERS:  # force-field types: the element is in the atom's name
                    symbol = re.match(r"[A-Za-z]+", f[1])[0].capitalize()
                    symbol = symbol if symbol in NUMBERS and symbol in ("Cl", "Br") else symbol[0]
                atoms.append({"idx": k, "elem": NUMBERS[symbol], "name": f[1], "x": float(f[2]), "y": float(f[3]), "z": float(f[4]), "charge": 0, "aromatic": f[5].endswith(".ar")})
            total = round(sum(float(x.split()[8]) for x in parts["ATOM"].splitlines() if len(x.split()) > 8))
            for line in parts.get("BOND", "").splitlines():
                f = line.split()
                if len(f) >= 4:
                    bonds.append({"a": int(f[1]) - 1, "b": int(f[2]) - 1, "order": {"ar": 1.5, "am": 1.0}.get(f[3]) or float(f[3])})
        except (ValueError, KeyError, IndexError, TypeError):
            continue
        row = _row(f"{stem}_{i}" if i else stem, stem, atoms, bonds, source, i)
        yield row | {"charge": int(total)}  # titles name a residue as a rule, so the file names the vertex


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles, ord) of ``SMILES name`` lines; # starts a comment. Structures with points
    need a chemistry backend."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).withColumn("value", F.trim("value")).where("value <> '' AND NOT value LIKE '#%'")
    parts = F.split("value", r"\s+")
    return lines.select(sanitize_name(F.get(parts, F.lit(1)), F.concat(F.lit("mol_"), F.col("ord").cast("string"))).alias("name"), parts[0].alias("smiles"), "ord")


def read_structures(spark: SparkSession, path: str, campaign: str = "default", name_property: str | None = None) -> DataFrame:
    """Vertices of all .sdf, .mol and .mol2 files at a path (file, folder or glob); names that
    occur twice are an error."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(sdf|mol|mol2)$")).select("path", F.decode("content", "UTF-8").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file, text in zip(pdf.path, pdf.text, strict=True):
                stem, _, kind = file.rsplit("/", 1)[-1].rpartition(".")
                rows += parse_mol2(text, stem, file) if kind.lower() == "mol2" else parse_sdf(text, stem, file, name_property)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ("raw", "fallback", "ord", "charge", "atoms", "bonds", "rings", "source")])

    read = files.mapInPandas(run, SCHEMA)
    heavy = F.size(F.filter("atoms", lambda a: a["elem"] != 1))
    place = F.row_number().over(_order()) - 1
    out = read.select(F.lit(campaign).alias(KEY), sanitize_name("raw", "fallback").alias("name"), "source", "ord", "charge", F.size("atoms").alias("n_atoms"), heavy.alias("n_heavy"), "atoms", "bonds", "rings")
    out = out.withColumn("ord", place)
    check_names(out)
    return out


def invented(spark: SparkSession, made: list[tuple], like: DataFrame) -> DataFrame:
    """(campaign, name, atoms, bonds) of invented structures as vertices with the columns of
    ``like``, marked as synthetic; what a structure doesn't tell is null."""
    from loomgraph.operators.alignment import path_fingerprint

    rows = []
    for i, (campaign, name, atoms, bonds) in enumerate(made):
        row = _row(name, name, [dict(a) for a in atoms], [dict(b) for b in bonds], "invented", i)
        mol = Molecule.of(row["atoms"], row["bonds"])
        row |= {KEY: campaign, "name": name, "n_atoms": mol.n, "n_heavy": mol.heavy.bit_count(), "synthetic": True, "ord": (1 << 30) + i, "fp": path_fingerprint(mol)}
        rows.append(tuple(row.get(c) for c in like.columns))
    return spark.createDataFrame(rows, like.schema)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy(KEY).orderBy("source", "ord")


def to_v2000(name: str, atoms: list[dict], bonds: list[dict]) -> str:
    """One SDF record."""
    head = f"{name}\n  loomgraph\n\n{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000\n"
    body = "".join(f"{a['x']:10.4f}{a['y']:10.4f}{a['z']:10.4f} {SYMBOLS[a['elem'] - 1]:<3}{0:2d}{0:3d}\n" for a in atoms)
    ties = "".join(f"{b['a'] + 1:3d}{b['b'] + 1:3d}{4 if b['order'] == 1.5 else int(b['order']):3d}  0\n" for b in bonds)
    charged = [(a["idx"] + 1, a["charge"]) for a in atoms if a["charge"]]
    lines = "".join(f"M  CHG{len(part):3d}" + "".join(f"{i:4d}{q:4d}" for i, q in part) + "\n" for part in (charged[k : k + 8] for k in range(0, len(charged), 8)))
    return f"{head}{body}{ties}{lines}M  END\n$$$$\n"


def sdf_records(vertices: DataFrame) -> DataFrame:
    """(campaign, name, value): a record per vertex, to be written as text by Spark."""
    kind = vertices.schema[KEY].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(getattr(r, KEY), r.name, to_v2000(r.name, _dicts(r.atoms), _dicts(r.bonds))) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[KEY, "name", "value"])

    return vertices.select(KEY, "name", "atoms", "bonds").mapInPandas(run, f"{KEY} {kind}, name string, value string")


def _dicts(xs) -> list[dict]:
    return [x if isinstance(x, dict) else x.asDict() for x in xs]

"""Simulation inputs: edge lists and one mapping file per edge, written by the tasks that hold
the edges. Counterpoised edges have no mapping; if there are any, the two kinds get folders of
their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY

RESIDUES = ("SRC", "DST")


def payloads(edges: DataFrame, residues: tuple[str, str] = RESIDUES) -> DataFrame:
    """edges (source, target, cc1, cc2, sc1, sc2, names_1, names_2, n_atoms_1, n_atoms_2, method,
    repaired) with ``payload``: the mapping file's text. An empty core, a name in core and
    changed region, or sides that scale by different numbers of atoms is an error."""

    def named(side: int, which: str):
        return F.transform(f"{which}{side}", lambda i: F.get(F.col(f"names_{side}"), i))

    bad = F.when(F.size("cc1") == 0, F.lit("empty core"))
    masks = {}
    for side in (1, 2):
        clash = F.array_intersect(named(side, "cc"), named(side, "sc"))
        bad = bad.when(F.size(clash) > 0, F.concat(F.lit("names both in core and changed region: "), F.array_join(clash, ",")))
        soft = F.array_sort(F.array_distinct(named(side, "sc")))
        masks[f"timask{side}"] = F.lit(f":{residues[side - 1]}")
        masks[f"scmask{side}"] = F.when(F.size(soft) > 0, F.concat(F.lit(f":{residues[side - 1]}&@"), F.array_join(soft, ","))).otherwise("")
    bad = bad.when(F.col("n_atoms_1") - F.size("sc1") != F.col("n_atoms_2") - F.size("sc2"), F.lit("the sides keep different numbers of atoms"))
    pairs = F.transform(F.arrays_zip("cc1", "cc2"), lambda p: F.array(p["cc1"], p["cc2"]))
    names = F.transform(F.arrays_zip("cc1", "cc2"), lambda p: F.array(F.get("names_1", p["cc1"]), F.get("names_2", p["cc2"])))
    body = F.struct(pairs.alias("atommapindices"), names.alias("atommapnames"), *[v.alias(k) for k, v in masks.items()], named(1, "sc").alias("softcore1"), named(2, "sc").alias("softcore2"), F.col("method").alias("mapping_method"), F.col("repaired").alias("softcore_repaired"))
    key = F.concat_ws("~", "source", "target")
    return edges.withColumn("payload", F.when(bad.isNull(), F.to_json(body)).otherwise(F.raise_error(F.concat(key, F.lit(": "), bad)).cast("string")))


def problems(edges: DataFrame) -> list[str]:
    """All edges that can't be written, with the reasons: the check before an export."""
    out = []
    for r in edges.select("source", "target", "cc1", "sc1", "sc2", "n_atoms_1", "n_atoms_2").where((F.size("cc1") == 0) | (F.col("n_atoms_1") - F.size("sc1") != F.col("n_atoms_2") - F.size("sc2"))).collect():
        out.append(f"{r.source}~{r.target}: {'empty core' if not r.cc1 else 'the sides keep different numbers of atoms'}")
    return sorted(out)


def write_runfiles(edges: DataFrame, path: str, residues: tuple[str, str] = RESIDUES) -> None:
    """edges.txt, edges.dat, atommap_<edge>.runconfig and atommaps.runconfig per campaign (JSON,
    which YAML readers read too), in rbfe and cbfe if there are counterpoised edges."""
    spark: SparkSession = edges.sparkSession
    split = not edges.where("kind = 'cbfe'").isEmpty()
    mapped = payloads(edges.where("kind <> 'cbfe'"), residues)
    for kind, df in (("rbfe", mapped), ("cbfe", edges.where("kind = 'cbfe'"))):
        if kind == "cbfe" and not split:
            continue
        base = f"{path}/{kind}" if split else path
        order = df.select(KEY, "source", "target").orderBy(KEY, "source", "target")
        for file, glue in (("edges.txt", "~"), ("edges.dat", " ")):
            order.groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(glue, "source", "target"))), "\n").alias("text")).select(F.concat(F.lit(f"{base}/"), F.col(KEY).cast("string"), F.lit(f"/{file}")).alias("file"), F.concat("text", F.lit("\n")).alias("text")).foreachPartition(_writer(spark))
    whole = mapped.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("~", "source", "target"), "payload")))).alias("m"))
    base = f"{path}/rbfe" if split else path
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))
    at = F.concat(F.lit(f"{base}/"), F.col(KEY).cast("string"))
    whole.select(F.concat(at, F.lit("/atommaps.runconfig")).alias("file"), text.alias("text")).foreachPartition(_writer(spark))
    mapped.select(F.concat(at, F.lit("/atommap_"), F.concat_ws("~", "source", "target"), F.lit(".runconfig")).alias("file"), F.col("payload").alias("text")).foreachPartition(_writer(spark))


def _writer(spark: SparkSession):
    """Writes (file, text) rows of a partition to a mounted folder: such inputs are read by
    programs that know no other store."""

    def write(rows) -> None:
        import os

        for r in rows:
            os.makedirs(os.path.dirname(r.file), exist_ok=True)
            with open(f"{r.file}.part", "w") as f:
                f.write(r.text)
            os.replace(f"{r.file}.part", r.file)  # a task that runs twice leaves whole files

    return write


def read_runfile(path: str) -> dict:
    with open(path) as f:
        return json.load(f)

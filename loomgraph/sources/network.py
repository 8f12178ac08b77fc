"""A network as tables on disk, with everything that planned it: a superset of one document.

``save`` writes vertices, candidates, selected and unmet as Parquet beside the options as
JSON, so that edits and replans after a load know bans and forced edges. ``load_json`` reads
documents of ``schema_version`` 1 into the same tables.
"""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY
from loomgraph.plans.options import CorePruning, IntermediateOptions, NetworkOptions, SoftcorePolicy

TABLES = ("vertices", "candidates", "selected", "unmet")
SCHEMA_VERSION = 1


def options_dict(options: NetworkOptions) -> dict[str, Any]:
    return dataclasses.asdict(options)


def options_of(data: dict[str, Any]) -> NetworkOptions:
    """Options from a dict; what is absent has its default, what is unknown is an error."""
    data = dict(data)
    if soft := data.get("softcore"):
        pruning = soft.get("core_pruning")
        data["softcore"] = SoftcorePolicy(**{**soft, **({"core_pruning": CorePruning(**pruning)} if pruning else {})})
    if data.get("intermediates"):
        data["intermediates"] = IntermediateOptions(**data["intermediates"])
    for k in ("explicit_pairs", "forced_edges", "banned_edges"):
        data[k] = tuple(data.get(k) or ())
    return NetworkOptions(**data)


def save(path: str, options: NetworkOptions, **tables: DataFrame) -> None:
    if set(tables) != set(TABLES):
        raise ValueError(f"a network is {TABLES}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = tables["vertices"].sparkSession
    text = json.dumps({"schema_version": SCHEMA_VERSION, "options": options_dict(options)})
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/options")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], NetworkOptions]:
    head = json.loads(spark.read.text(f"{path}/options").first().value)
    _check(head.get("schema_version"))
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, options_of(head["options"])


def _check(version: Any) -> None:
    if version != SCHEMA_VERSION:
        raise ValueError(f"schema_version {version!r} is not {SCHEMA_VERSION}")


LIGAND = "struct<name: string, ord: long, charge: long, n_heavy: long>"
EDGE = "struct<source: string, target: string, u: string, v: string, kind: string, total: double, feasible: boolean, cand_ord: long>"
DOCUMENT = f"schema_version int, ligands array<{LIGAND}>, edges array<{EDGE}>, candidates array<{EDGE}>, unmet_constraints array<struct<seq: int, message: string>>"


def load_json(spark: SparkSession, path: str, campaign: str = "default") -> dict[str, DataFrame]:
    """Tables of the documents at a path, with an explicit schema: fields that are absent are null."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    bad = docs.where(F.coalesce("schema_version", F.lit(-1)) != SCHEMA_VERSION).limit(1).collect()
    if bad:
        _check(bad[0].schema_version)

    def table(column: str) -> DataFrame:
        return docs.select(F.lit(campaign).alias(KEY), F.explode(column).alias("x")).select(KEY, "x.*")

    return {"vertices": table("ligands"), "selected": table("edges"), "candidates": table("candidates"), "unmet": table("unmet_constraints")}

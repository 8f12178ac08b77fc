"""Planned networks as lines and files. Line forms are expressions over the edge table, so
large networks are written in parallel; single documents are aggregated per campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY


def edge_list_lines(edges: DataFrame) -> DataFrame:
    """(campaign, value): ``source target cost n_sc1 n_sc2 kind`` with six decimals."""
    return edges.select(KEY, F.concat_ws(" ", "source", "target", F.format_string("%.6f", "total"), F.col("n_sc_1").cast("string"), F.col("n_sc_2").cast("string"), "kind").alias("value"))


def write_edge_list(edges: DataFrame, path: str) -> None:
    edge_list_lines(edges).orderBy(KEY, "value").write.partitionBy(KEY).text(path)


def _xml(c):
    out = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(campaign, value): one GraphML document per campaign, vertices in name order."""

    def data(df: DataFrame, columns: list[str]):
        return F.concat(*[F.concat(F.lit(f'<data key="{c}">'), F.coalesce(_xml(F.col(c)), F.lit("")), F.lit("</data>")) for c in columns])

    kinds = {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}
    nodes_of = [c for c in ("charge", "n_heavy") if c in vertices.columns]
    edges_of = [c for c in ("total", "kind", "n_sc_1", "n_sc_2") if c in edges.columns]
    keys = "".join(f'<key id="{c}" for="{what}" attr.name="{c}" attr.type="{kinds.get(dict(df.dtypes)[c], "string")}"/>' for what, df, cs in (("node", vertices, nodes_of), ("edge", edges, edges_of)) for c in cs)
    n = vertices.select(KEY, F.col("name").alias("k"), F.concat(F.lit('<node id="'), _xml(F.col("name")), F.lit('">'), data(vertices, nodes_of), F.lit("</node>")).alias("x"))
    e = edges.select(KEY, F.concat_ws("~", "source", "target").alias("k"), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data(edges, edges_of), F.lit("</edge>")).alias("x"))
    body = lambda df, name: df.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "").alias(name))
    both = body(n, "_n").join(body(e, "_e"), KEY, "left")
    head = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    return both.select(KEY, F.concat(F.lit(head), "_n", F.coalesce("_e", F.lit("")), F.lit("</graph></graphml>")).alias("value"))


def network_json(vertices: DataFrame, candidates: DataFrame, selected: DataFrame, unmet: DataFrame) -> DataFrame:
    """(campaign, value): a document with vertices, edges, all candidates (a rejected one has a
    null total) and unmet targets. ``schema_version`` is 1."""

    def rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        cols = [c for c in df.columns if c != KEY]
        return df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name))

    out = rows(vertices, "ligands", ["ord"])
    for df, name, order in ((selected, "edges", ["u", "v"]), (candidates, "candidates", ["cand_ord"]), (unmet, "unmet_constraints", ["seq"])):
        out = out.join(rows(df, name, order), KEY, "left")
    return out.select(KEY, F.to_json(F.struct(F.lit(1).alias("schema_version"), *[c for c in out.columns if c != KEY])).alias("value"))


def masks(edges: DataFrame) -> DataFrame:
    """edges with source_mask and target_mask from core_names_1/2 and soft_names_1/2 (arrays). An
    empty core, or a name both in core and changed region, is an error."""

    def mask(side: int, prefix: str):
        core, soft = F.col(f"core_names_{side}"), F.col(f"soft_names_{side}")
        clash = F.array_intersect(core, soft)
        bad = F.when(F.size(core) == 0, F.lit("empty core")).when(F.size(clash) > 0, F.concat(F.lit("names on both sides of the core: "), F.array_join(clash, ",")))
        text = F.when(F.size(soft) > 0, F.concat(F.lit(f":{prefix}&@"), F.array_join(F.array_sort(soft), ","))).otherwise(F.lit(""))
        return F.when(bad.isNull(), text).otherwise(F.raise_error(bad).cast("string"))

    return edges.withColumns({"source_mask": mask(1, "SRC"), "target_mask": mask(2, "TGT")})

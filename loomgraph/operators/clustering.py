"""Clusters of vertices: by a key, or by average linkage of dissimilarities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY, fresh, tanimoto_matrix

CUT = 0.6
#: Rows of a campaign's matrix that are made at once.
ROWS = 512


def by_key(vertices: DataFrame, key: Column | str) -> DataFrame:
    """vertices with ``cluster``: groups of equal key, numbered by their first names."""
    k = F.col(key) if isinstance(key, str) else key
    first = F.min("name").over(Window.partitionBy(KEY, k))
    named = vertices.withColumn("_first", first)
    return named.withColumn("cluster", F.dense_rank().over(Window.partitionBy(KEY).orderBy("_first")) - 1).drop("_first")


def group_numbers(labels: list, names: list[str]) -> np.ndarray:
    first: dict = {}
    for name, x in sorted(zip(names, labels, strict=True), key=lambda p: p[0]):
        first.setdefault(x, len(first))
    return np.array([first[x] for x in labels], int)


def average_linkage(similarity: np.ndarray, cut: float = CUT, clusters: int | None = None) -> np.ndarray:
    """Labels from merging the closest two clusters by mean dissimilarity (1 - similarity)
    until the closest are farther apart than ``cut``, or so many clusters are left."""
    return _linked(1.0 - np.asarray(similarity, float), cut, clusters)


def _linked(d: np.ndarray, cut: float, clusters: int | None) -> np.ndarray:
    """``average_linkage`` of dissimilarities, in place. Every row knows its closest cluster, the
    first on ties, so a merge looks again only at the rows that were closest to one of the two."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    near = d.argmin(axis=1) if n else np.zeros(0, int)
    far = d[np.arange(n), near]
    left = n
    while left > 1:
        i = int(far.argmin())
        j = int(near[i])
        if (clusters is None and far[i] > cut) or (clusters is not None and left <= clusters):
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])  # mean over all pairs
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        left -= 1
        again = (near == i) | (near == j)
        again[i], far[j] = True, np.inf
        closer = ~again & ((d[i] < far) | ((d[i] == far) & (i < near)))
        near[closer], far[closer] = i, d[i][closer]
        again[j] = False
        for k in np.flatnonzero(again & (size > 0) & np.isfinite(far)).tolist():
            near[k] = d[k].argmin()
            far[k] = d[k, near[k]]
    return label


def by_similarity(vertices: DataFrame, sims: DataFrame, cut: float = CUT, clusters: int | None = None) -> DataFrame:
    """(campaign, name, cluster) by average linkage of sims (campaign, u, v, sim); pairs that
    are not listed have similarity 0."""
    import pandas as pd

    kind = vertices.schema[KEY].dataType.simpleString()

    def one(key: tuple, v: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        names = sorted(v.name)
        number = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for u, w, x in zip(s.u, s.v, s.sim, strict=True):
            m[number[u], number[w]] = m[number[w], number[u]] = x
        return pd.DataFrame({KEY: key[0], "name": names, "cluster": group_numbers(average_linkage(m, cut, clusters).tolist(), names)})

    return vertices.select(KEY, "name").groupBy(KEY).cogroup(fresh(sims.select(KEY, "u", "v", "sim")).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, name string, cluster int")


def by_fingerprint(vertices: DataFrame, cut: float = CUT, clusters: int | None = None) -> DataFrame:
    """(campaign, name, cluster) by average linkage of the fingerprints' similarities. They are
    made where a campaign is clustered, so no table holds its pairs; what its task holds is their
    matrix, 8 bytes a cell."""
    kind = vertices.schema[KEY].dataType.simpleString()

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        n = len(table)
        d = np.empty((n, n))
        for at in np.array_split(np.arange(n), -(-n // ROWS)):
            d[at] = 1.0 - tanimoto_matrix(table["fp"], at, np.arange(n))
        names = table["name"].to_pylist()
        found = group_numbers(_linked(d, cut, clusters).tolist(), names)
        return pa.table({KEY: pa.repeat(key[0], n), "name": table["name"].combine_chunks(), "cluster": pa.array(found, pa.int32())})

    return vertices.select(KEY, "name", "fp").groupBy(KEY).applyInArrow(one, f"{KEY} {kind}, name string, cluster int")


def sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy(KEY, "cluster").agg(F.count("*").alias("n"))


def edge_budget(clustered: DataFrame) -> DataFrame:
    """(campaign, unclustered, clustered, saving): n ln n over all, and summed per cluster."""

    def floor(n: Column) -> Column:
        return F.when(n > 1, n * F.ln(n)).otherwise(0.0)

    s = sizes(clustered).groupBy(KEY).agg(F.sum("n").alias("n"), F.sum(floor(F.col("n"))).alias("clustered"))
    whole = floor(F.col("n"))
    return s.select(KEY, whole.alias("unclustered"), "clustered", F.when(whole > 0, 1 - F.col("clustered") / whole).otherwise(0.0).alias("saving"))

"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def headroom(n_edges: Column, n_vertices: Column) -> Column:
    """Edges left for invented vertices once all are spanned; null without a cap."""
    return F.when(n_edges.isNotNull(), F.greatest(n_edges - (n_vertices - 1), F.lit(0)))


def link_score(heavy_delta: Column, beta: float = 0.1) -> Column:
    """Merit of a step between two states by how many heavy atoms it changes."""
    return F.exp(-beta * heavy_delta)


def geometry_hint(rejected_for_geometry: Column, rejected: Column, selected: Column) -> Column:
    """Whether a failed plan looks like a problem of poses: nothing was selected and over half
    of the rejections are for geometry."""
    return (selected == 0) & (rejected > 0) & (2 * rejected_for_geometry > rejected)

"""Edge diagnostics from a stream: an extension for campaigns whose results come in one by one.

``edge_values`` is a watermarked, windowed aggregation (state is bounded by the watermark and
the number of edges), and ``replan_on`` applies a batch's edges above the cut to a planned
network each time one completes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.pairs import KEY


def edge_values(results: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """results (campaign, ts, source, target, value) to (window, campaign, u, v, lmi, n): the mean
    per edge and window; results later than ``late`` are left out."""
    named = results.withColumns({"ts": F.col("ts").cast("timestamp"), "u": F.least("source", "target"), "v": F.greatest("source", "target")})
    return named.withWatermark("ts", late).groupBy(F.window("ts", window), KEY, "u", "v").agg(F.avg("value").alias("lmi"), F.count("*").alias("n"))


def replan_on(values: DataFrame, cut: float, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``apply`` with each batch's edges strictly above the cut, once per batch and edge.
    The checkpoint belongs in a shared folder."""

    def batch(df: DataFrame, number: int) -> None:
        high = df.where(F.col("lmi") > cut).select(KEY, "u", "v", "lmi")
        if not high.isEmpty():
            apply(high, number)

    return values.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()

"""Edge list readers: ``A >>> B`` and ``A >> B`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY


def parse_edge_lines(lines: DataFrame, arrow: str = ">>>", order: str | None = None) -> DataFrame:
    """Lines (campaign, value) to (campaign, a, b, line): comments (#) and blank lines are
    skipped, a prefix up to the last colon is dropped, a pair that came before in either
    direction is left out. The arrow must be the whole run of ``>``, so that one format can't
    be taken for the other; a line without two names is an error."""
    run = "(?<!>)" + ">" * len(arrow) + "(?!>)"
    body = F.trim(F.regexp_replace(F.split("value", "#")[0], "^.*:", ""))
    at = F.monotonically_increasing_id() if order is None else F.col(order)
    x = lines.withColumns({"_line": at, "_body": body}).where("_body <> ''")
    parts = F.split("_body", run)
    good = (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != "")
    x = x.withColumn("_p", F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("not an edge line: "), "value")).cast("array<string>")))
    x = x.withColumns({"a": F.trim(F.col("_p")[0]), "b": F.trim(F.col("_p")[1])})
    row = Window.partitionBy(KEY, F.least("a", "b"), F.greatest("a", "b")).orderBy("_line")
    return x.withColumn("_r", F.row_number().over(row)).where("_r = 1").select(KEY, "a", "b", F.col("_line").alias("line"))


def read_edge_list(spark: SparkSession, path: str, arrow: str = ">>>", campaign: str = "default") -> DataFrame:
    return parse_edge_lines(spark.read.text(path).withColumn(KEY, F.lit(campaign)), arrow)

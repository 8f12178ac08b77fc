from pyspark.sql import functions as F

from loomgraph.streaming.diagnostics import edge_values, replan_on


def test_edges_above_the_cut_arrive(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    rows = events.select(F.lit("c").alias("campaign"), "ts", F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("source"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("target"), "value")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = []
    q = replan_on(edge_values(stream, "365 days", "3650 days"), 0.0, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"))
    q.awaitTermination(120)
    want = rows.groupBy("source", "target", F.window("ts", "365 days")).agg(F.avg("value").alias("m")).where("m > 0").collect()
    last = {(r.u, r.v, round(r.lmi, 6)) for r in seen}
    assert {(r.source, r.target, round(r.m, 6)) for r in want} <= last

"""Mixing sources to target weights (operator 4), in DataFrame functions only.

Every document gets a hash-random key, the MD5 of a seed and its id. The key's first hex
digits are its range of the key space, so the ranges of a source are even whatever its
size: a source with a third of all rows is spread over all tasks. Words are summed per
(source, range), offsets are prefix sums over those few sums, and a window inside each
range places every document in its source's order. The mix takes whole epochs of a source
and then its first ``rest`` words in that order, the last document in part, so that each
source's taken words equal its target rounded down.

There are about sqrt(rows) ranges, so that neither a range nor the list of ranges of a
source grows faster than sqrt(rows).

Edge cases: a null text has size 0 and takes 0; null sources are one source, ordered last;
repeated rows are rows of their own (equal keys follow doc_id and size); an empty table
gives an empty result; other columns pass through, also with clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a document may be used.
TOTAL_SHARE, MAX_EPOCHS = 1.5, 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def range_digits(rows: int) -> int:
    """Hex digits of a key that number its range: 16 ** digits is near sqrt(rows)."""
    digits = 1
    while 16 ** (2 * digits + 1) < rows:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size) to (src, source_size, target): the level at which weight times
    level, cut at ``most`` times the size, adds up to ``share`` of all words.

    Sources in order of cap per weight reach their caps first; with the first k at their
    caps the level is what is left over the weights left, and it is right for the first k
    whose next source stays below its cap. One row per source goes through the windows.
    """
    listed = F.lit(list(weights))
    order = Window.orderBy(F.col("src").isNull(), "src")
    w = sizes.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * most).cast("double"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src")
    all_rows = Window.partitionBy()
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"_all": F.sum("source_size").over(all_rows), "_weights": F.sum("weight").over(all_rows)})
    w = w.withColumn("_level", (F.col("_all") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src", F.col("_level").alias("l")))).over(all_rows)
    return w.withColumn("_l", fits["l"]).select("src", "source_size", F.when(F.col("_l").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_l") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (columns of those names are replaced)."""
    digits = range_digits(docs.count())
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.col("doc_id").alias("_id"),
        n_words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_src"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"),
    ).withColumn("_range", F.substring("_key", 1, digits))
    ranges = keyed.groupBy("_src", "_range").agg(F.sum("size").alias("_n"))
    targets = source_targets(ranges.groupBy(F.when(F.col("_src") != "", F.substr("_src", F.lit(2))).alias("src")).agg(F.sum("_n").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    targets = targets.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("src")), F.lit(""))).drop("src")
    offsets = offsets.join(targets, "_src")
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, ["_src", "_range"]).withColumn("_start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = F.expr("""CASE WHEN source_size = 0 THEN 0L ELSE
      size * CAST(floor(target / source_size) AS BIGINT)
      + least(size, greatest(0L, CAST(floor(target - floor(target / source_size) * source_size) AS BIGINT) - _start)) END""")
    return placed.select("_row.*", "size", "source_size", "target", taken.alias("taken"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CAST([3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s
), c AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS rn FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(x.cap) FROM c x WHERE x.rn < c.rn), 0)) / ((SELECT sum(weight) FROM c) - coalesce((SELECT sum(x.weight) FROM c x WHERE x.rn < c.rn), 0)) AS level FROM c
), f AS (
  SELECT arg_min(level, rn) AS level FROM l WHERE level * weight <= cap
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM c
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  size * floor(target / source_size) + least(size, greatest(0, floor(target - floor(target / source_size) * source_size)
    - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

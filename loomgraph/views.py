"""Network views of the driver's tables: vertices and edges for the registered queries.

* parts: a campaign per brand; sizes stand for heavy atoms, and descriptors of a pair are
  whole-number functions of both keys.
* trade: a campaign per year; nations are vertices, and an edge's lines are the order lines
  between customers of one and suppliers of the other. ``sparse`` keeps pairs with at least
  1.25 times the mean.
* vectors: a campaign per label; a vector's set of positive dimensions is its fingerprint.

Each view has an SQL twin for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY


#: Partners of a part in its brand, for the queries over pairs of parts.
PARTNERS = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_brand").alias(KEY), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("n_heavy"), (F.col("p_size") % 3 - 1).cast("long").alias("charge"), (F.col("p_size") % 4).cast("long").alias("rings"), F.col("p_type").alias("scaffold"))


PARTS = """parts AS (
  SELECT p_brand AS campaign, 'p' || p_partkey AS name, p_partkey AS ord, CAST(p_size AS BIGINT) AS n_heavy, CAST(p_size % 3 - 1 AS BIGINT) AS charge, CAST(p_size % 4 AS BIGINT) AS rings, p_type AS scaffold FROM part
)"""


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each part with the next PARTNERS parts of its brand (as an index would offer them, so
    rows grow with the parts), with descriptors of a made-up mapping."""
    ranked = parts(spark, d).withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy("ord")))
    a, b = (ranked.select(KEY, "place", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "ord", "n_heavy", "charge", "rings")]) for s in (1, 2))
    p = a.withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + PARTNERS))).join(b, [KEY, "place"]).drop("place")
    core = F.floor(F.least("n_heavy_1", "n_heavy_2") * (50 + (F.col("ord_1") * 7 + F.col("ord_2") * 13) % 51) / 100).cast("long")
    p = p.withColumn("core", core).withColumns({"s1": F.col("n_heavy_1") - F.col("core"), "s2": F.col("n_heavy_2") - F.col("core"), "core_rmsd": ((F.col("ord_1") * 31 + F.col("ord_2") * 17) % 300) / 100})
    return p.withColumnRenamed("name_1", "source").withColumnRenamed("name_2", "target")


PART_PAIRS = PARTS + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY ord) AS place FROM parts
), pp0 AS (
  SELECT a.campaign, a.name AS source, b.name AS target, a.ord AS ord_1, b.ord AS ord_2, a.n_heavy AS n_heavy_1, b.n_heavy AS n_heavy_2, a.charge AS charge_1, b.charge AS charge_2, a.rings AS rings_1, b.rings AS rings_2,
    CAST(floor(least(a.n_heavy, b.n_heavy) * (50 + (a.ord * 7 + b.ord * 13) % 51) / 100) AS BIGINT) AS core, ((a.ord * 31 + b.ord * 17) % 300) / 100 AS core_rmsd
  FROM (SELECT *, unnest(range(place + 1, place + 1 + {PARTNERS})) AS next FROM ranked) a JOIN ranked b ON a.campaign = b.campaign AND a.next = b.place
), pp AS (
  SELECT *, n_heavy_1 - core AS s1, n_heavy_2 - core AS s2 FROM pp0
)"""


def pair_descriptors() -> dict:
    c = F.col
    return {
        "n_softcore_max_heavy": F.greatest("s1", "s2"), "softcore_asymmetry": F.abs(c("s1") - c("s2")), "heavy_atom_delta": F.abs(c("n_heavy_1") - c("n_heavy_2")), "charge_delta": F.abs(c("charge_1") - c("charge_2")),
        "ring_delta": F.abs(c("rings_1") - c("rings_2")), "n_ring_atoms_in_softcore": F.least(c("rings_1"), c("s1")), "mcs_fraction": c("core") / F.least("n_heavy_1", "n_heavy_2"), "core_rmsd": c("core_rmsd"), "n_heavy_1": c("n_heavy_1"), "n_heavy_2": c("n_heavy_2"),
    }


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(campaign, u, v, lines, weight): lines per pair of nations and year."""
    nation = read(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"))
    buyer = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias(KEY), "c_nationkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    # lines are summed per order and nation before the large join, names come last
    both = lines.groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n")).join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(KEY, "c_nationkey", "s_nationkey").agg(F.sum("n").alias("n"))
    a, b = nation.withColumnRenamed("n", "x"), nation.withColumnRenamed("n", "y")
    named = both.join(F.broadcast(a), F.col("c_nationkey") == a["n_nationkey"]).drop("n_nationkey").join(F.broadcast(b), F.col("s_nationkey") == b["n_nationkey"]).where("x <> y")
    out = named.groupBy(KEY, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.sum("n").alias("lines"))
    return out.withColumn("weight", F.lit(1000.0) / F.col("lines"))


TRADE = """trade AS (
  SELECT campaign, least(x, y) AS u, greatest(x, y) AS v, count(*) AS lines, 1000.0::DOUBLE / count(*) AS weight FROM (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS campaign, replace(a.n_name, ' ', '_') AS x, replace(b.n_name, ' ', '_') AS y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey)
  WHERE x <> y GROUP BY campaign, least(x, y), greatest(x, y)
)"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the trade campaigns; charge is the region, size the length of the name."""
    n = read(spark, d, "nation")
    years = trade(spark, d).select(KEY).distinct()
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    return years.crossJoin(n.select(name.alias("name"), F.col("n_nationkey").cast("long").alias("ord"), F.char_length("n_name").cast("long").alias("n_heavy"), F.col("n_regionkey").cast("long").alias("charge")))


NATIONS = TRADE + """, nations AS (
  SELECT campaign, replace(n_name, ' ', '_') AS name, CAST(n_nationkey AS BIGINT) AS ord, CAST(length(n_name) AS BIGINT) AS n_heavy, CAST(n_regionkey AS BIGINT) AS charge FROM nation, (SELECT DISTINCT campaign FROM trade)
)"""


def sparse(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(KEY)
    t = trade(spark, d).withColumns({"_s": F.sum("lines").over(w), "_c": F.count("*").over(w)})
    return t.where("lines * _c * 4 >= _s * 5").drop("_s", "_c")


SPARSE = NATIONS + """, sparse AS (
  SELECT campaign, u, v, lines, weight FROM (SELECT *, sum(lines) OVER (PARTITION BY campaign) AS s, count(*) OVER (PARTITION BY campaign) AS c FROM trade) WHERE lines * c * 4 >= s * 5
)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Trade pairs in both directions; the way back costs more where names are long, and pairs
    that aren't in ``sparse`` are rejected."""
    w = Window.partitionBy(KEY)
    t = trade(spark, d).withColumns({"_s": F.sum("lines").over(w), "_c": F.count("*").over(w)})
    ways = F.array(F.struct(F.col("u").alias("source"), F.col("v").alias("target"), F.col("weight").alias("total"), F.lit(0).alias("way")), F.struct(F.col("v").alias("source"), F.col("u").alias("target"), (F.col("weight") + F.char_length("v") % 2).alias("total"), F.lit(1).alias("way")))
    rows = t.select(KEY, "u", "v", (F.col("lines") * F.col("_c") * 4 >= F.col("_s") * 5).alias("feasible"), F.explode(ways).alias("x"))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("u", "v", "way")) - 1
    rows = rows.select(KEY, "x.*", "feasible", "u", "v").withColumn("cand_ord", order.cast("long"))
    return rows.select(KEY, "cand_ord", "source", "target", F.when(F.col("feasible"), F.col("total")).alias("total"), "feasible", F.char_length("source").cast("long").alias("n_sc_1"), F.char_length("target").cast("long").alias("n_sc_2"))


CANDIDATES = NATIONS + """, cand0 AS (
  SELECT *, lines * c * 4 >= s * 5 AS feasible FROM (SELECT *, sum(lines) OVER (PARTITION BY campaign) AS s, count(*) OVER (PARTITION BY campaign) AS c FROM trade)
), cand1 AS (
  SELECT campaign, u AS source, v AS target, weight AS total, 0 AS way, feasible, u, v FROM cand0 UNION ALL SELECT campaign, v, u, weight + length(v) % 2, 1, feasible, u, v FROM cand0
), cand AS (
  SELECT campaign, row_number() OVER (PARTITION BY campaign ORDER BY u, v, way) - 1 AS cand_ord, source, target, CASE WHEN feasible THEN total END AS total, feasible, CAST(length(source) AS BIGINT) AS n_sc_1, CAST(length(target) AS BIGINT) AS n_sc_2, u, v FROM cand1
), best AS (
  SELECT * FROM cand WHERE feasible QUALIFY row_number() OVER (PARTITION BY campaign, u, v ORDER BY total, cand_ord) = 1
)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return e.select(F.col("label").alias(KEY), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("name"), F.col("vec_id").cast("long").alias("ord"), bits.alias("fp"))


VECTORS = """vectors AS (
  SELECT label AS campaign, 'v' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS name, CAST(vec_id AS BIGINT) AS ord, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS fp FROM embeddings
), sims AS (
  SELECT a.campaign, a.name AS source, b.name AS target, CASE WHEN len(a.fp) + len(b.fp) = 0 THEN 0 ELSE len(list_intersect(a.fp, b.fp)) / (len(a.fp) + len(b.fp) - len(list_intersect(a.fp, b.fp))) END AS sim
  FROM vectors a JOIN vectors b ON a.campaign = b.campaign AND a.ord < b.ord
)"""

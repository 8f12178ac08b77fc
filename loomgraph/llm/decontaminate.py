"""Benchmark decontamination by winnowing (operator 7), in DataFrame functions only.

Texts and items are read as words; every K words have a hash, and of each SPAN - K + 1
neighbouring hashes the smallest (the first of equal ones) is a fingerprint. Two texts that
share SPAN words share the fingerprint chosen inside them, so joining fingerprints finds
every shared span. A hit compares the words themselves on both sides, as far as a window
of SPAN words around it can reach, and yields the run of equal words if it is SPAN long.

Items of fewer than SPAN words are one window; texts that may hold one are probed with all
their runs of such lengths. The items' table is broadcast only up to MAX_BROADCAST rows
and MAX_BROADCAST_BYTES of words, and otherwise joined by a shuffle.

Edge cases: null and empty texts have no words and no hits; null item texts and null
item ids are no items; equal items all count; texts may be as long as Spark takes them; rows of
one doc_id and text are compared once and come out as often as they came in; ties cannot
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import plain_words, table

SPAN, K = 10, 5
MAX_BROADCAST = 50_000
MAX_BROADCAST_BYTES = 32 << 20
#: A fingerprint holds the upper 33 bits of the hash and the place in the lower 31: an array
#: has fewer than 2^31 words, so no place is too large. Hits compare the words themselves.
_PLACE = (1 << 31) - 1
_REACH = SPAN - K
#: Key of a document itself: with lower bits, unlike any fingerprint's.
_OWN = 1


def _fingerprints(words: str) -> str:
    """SQL for the distinct fingerprints of an array of words."""
    grams = ", ".join(f"get({words}, i + {o})" for o in range(K))
    after = ", ".join(f"get(v, i + {o})" for o in range(1, _REACH + 1))  # the last windows are shorter
    return f"""CASE WHEN size({words}) >= {SPAN} THEN element_at(transform(
      array(transform(sequence(0, size({words}) - {K}), i -> (xxhash64({grams}) & {~_PLACE}L) | i)),
      v -> array_distinct(transform(v, (x, i) -> least(x, {after})))), 1) END"""


def _around(words: str, at: str) -> str:
    """The words from _REACH before place ``at`` to _REACH after its K words."""
    return f"slice({words}, greatest({at} - {_REACH}, 0) + 1, K_OR_LESS)".replace("K_OR_LESS", f"{at} + {K + _REACH} - greatest({at} - {_REACH}, 0)")


def _small(rows: DataFrame, words: str) -> bool:
    """Whether rows with an array of words may be broadcast, by their number and bytes."""
    n, size = rows.limit(MAX_BROADCAST + 1).agg(F.count("*"), F.sum(F.octet_length(F.array_join(words, " ")))).first()
    return n <= MAX_BROADCAST and (size or 0) <= MAX_BROADCAST_BYTES


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (with columns doc_id, text) to rows doc_id, _text (a hash), n_words, item_id, first,
    end (word places in the document) and own: one per shared run, and one for every document
    that stands for itself (own; item_id, first and end are null)."""
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", plain_words(F.col("text")).alias("iw")).distinct()
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"), plain_words(F.col("text")).alias("w"))
    words = words.withColumn("n_words", F.size("w").cast("long"))

    index = items.withColumn("prints", F.expr(_fingerprints("iw"))).select("item_id", "iw", F.explode_outer("prints").alias("v")).where("v IS NOT NULL")
    index = index.select("item_id", F.col("v").bitwiseAND(~_PLACE).alias("key"), F.col("v").bitwiseAND(_PLACE).cast("int").alias("q"), "iw")
    index = index.select("item_id", "key", F.least("q", F.lit(_REACH)).alias("io"), F.expr(_around("iw", "q")).alias("ic"))
    # A column of their own, as exploding an expression of lambdas would copy the words for
    # every row; and outer, as a plain explode gets a filter that computes them again.
    probes = words.withColumn("prints", F.array_append(F.coalesce(F.expr(_fingerprints("w")), F.array().cast("array<bigint>")), F.lit(None)))
    probes = probes.select("doc_id", "_text", "n_words", "w", F.explode_outer("prints").alias("v"))
    # the last element, null, stands for the document itself; no fingerprint has its key
    probes = probes.select("doc_id", "_text", "n_words", "w", F.coalesce(F.col("v").bitwiseAND(~_PLACE), F.lit(_OWN).cast("long")).alias("key"), F.col("v").bitwiseAND(_PLACE).cast("int").alias("p"))
    context = [F.least("p", F.lit(_REACH)).alias("do"), F.expr(_around("w", "p")).alias("dc")]
    if _small(index, "ic"):
        # An inner join, by which only hits leave the generated code that explodes: no row but
        # theirs carries the words, and only there are the words around the place cut out.
        own = docs.sparkSession.range(1).select(F.lit(None).cast(index.schema["item_id"].dataType).alias("item_id"), F.lit(_OWN).cast("long").alias("key"), F.lit(None).cast("int").alias("io"), F.lit(None).cast("array<string>").alias("ic"))
        found = probes.join(F.broadcast(index.unionByName(own)), "key").select("doc_id", "_text", "n_words", "item_id", "p", "io", "ic", *context)
    else:
        found = probes.where("p IS NOT NULL").select("doc_id", "_text", "n_words", "key", "p", *context).join(index, "key").drop("key")
        found = found.unionByName(words.select("doc_id", "_text", "n_words"), allowMissingColumns=True)
    # Steps to the left and to the right over which both sides have the same words. The words
    # are bound by a lambda: a plain column would be cut out again at each mention.
    side = "aggregate(sequence(1, {reach}), 0, (a, o) -> CASE WHEN a = o - 1 AND get(x.d, x.o {op} o{k}) = get(ic, io {op} o{k}) THEN o ELSE a END)"
    same = " AND ".join(f"get(x.d, x.o + {o}) = get(ic, io + {o})" for o in range(K))
    left, right = side.format(reach=_REACH, op="-", k=""), side.format(reach=_REACH, op="+", k=f" + {K - 1}")
    # (two mentions of dc keep its projection in the generated code of the join)
    run = f"""CASE WHEN size(dc) >= {K} THEN element_at(transform(array(named_struct('d', dc, 'o', do)), x -> CASE WHEN {same} THEN element_at(transform(array(named_struct('l', {left}, 'r', {right})),
      y -> CASE WHEN y.l + y.r >= {_REACH} THEN named_struct('first', p - y.l, 'end', p + {K} + y.r) END), 1) END), 1) END"""
    # no filter on runs: it would move into the join and take that out of generated code
    found = found.withColumn("run", F.expr(run))
    out = found.select("doc_id", "_text", "n_words", F.when(F.col("run").isNotNull(), F.col("item_id")).alias("item_id"), "run.first", "run.end", F.col("p").isNull().alias("own"))

    short = items.where(f"size(iw) BETWEEN 1 AND {SPAN - 1}").withColumn("m", F.size("iw"))
    lengths = sorted(r.m for r in short.select("m").distinct().collect())  # SPAN - 1 at most
    for m in lengths:
        runs = words.where(F.size("w") >= m).select("doc_id", "_text", "n_words", "w", F.explode_outer(F.sequence(F.lit(0), F.size("w") - m)).alias("p"))
        key = F.array_join(F.slice("w", F.col("p") + 1, F.lit(m)), " ")
        mine = short.where(F.col("m") == m)
        one = mine.select("item_id", F.array_join("iw", " ").alias("key"))
        one = F.broadcast(one) if _small(mine, "iw") else one
        out = out.unionByName(runs.select("doc_id", "_text", "n_words", "p", key.alias("key")).join(one, "key").select("doc_id", "_text", "n_words", "item_id", F.col("p").alias("first"), (F.col("p") + m).alias("end"), F.lit(False).alias("own")))
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document: doc_id, _text, n_words, n_hit (words in the union of the shared runs),
    item_ids (distinct, sorted as strings) and contaminated."""
    runs = hits(docs, items).groupBy("doc_id", "_text", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("first", "end")))).alias("_runs"),
        F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("item_ids"),
        F.count_if("own").cast("int").alias("_rows"),
    )
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), "_rows")))
    n_hit = F.expr("aggregate(_runs, struct(0L AS n, 0 AS upto), (a, r) -> struct(a.n + greatest(0, r.end - greatest(r.first, a.upto)) AS n, greatest(a.upto, r.end) AS upto)).n")
    return runs.select("doc_id", "_text", "n_words", n_hit.alias("n_hit"), "item_ids").withColumn("contaminated", F.col("n_hit") > 0)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), h AS (
  SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

"""From raw documents to a training mix: each stage works on all that the one before kept.

1. language: texts that the language models reject (no letters, or unlike any language) go.
2. near_duplicates: of every group of linked SimHash fingerprints one document stays.
3. benchmark: documents that share a window of words with a benchmark item go.
4. secrets: secrets inside texts are replaced by a mark, n_chars follows; no document goes.
5. mix: documents that the mix takes, with their size, source_size, target and taken words.

Stages are cut from each other by Parquet tables in the shared folder, so a lost executor
costs a part of one stage.

Edge cases: null and empty texts have no letters and go with the first stage; very long
texts are read whole by every stage; rows that occur twice are near duplicates, so one stays
(of ties the smallest text hash under the smallest doc_id); rows without a doc_id link to
nothing that goes for them, so they stay unless the language or the benchmark stage drops
them; an empty table of documents gives no rows, and an empty benchmark contaminates
nothing; other columns of the documents pass through all stages whatever their names, but
for size, source_size, target and taken, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, mixing, secrets, simhash
from loomgraph.llm.common import settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, limits = langid.train(docs.where(~F.coalesce(langid.held_out(), F.lit(False))).select("lang", "text"))
    own = {c: f"{c} of the document" for c in docs.columns if c in ("lang_pred", "score", "entropy", "rejected")}
    kept = langid.identify(docs.withColumnsRenamed(own), model, limits).where(~F.col("rejected"))
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = settle(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("_text").alias("bad_text")), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_text"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, path="source" if "source" in docs.columns else None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", redact_secrets),
    ("mix", mix),
]
#: Hash-random order, models and fingerprints are not SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Helpers that the corpus operators share: tables, scratch storage, tokenisers."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, as Java patterns of what stands between them.
BLANKS = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def blank_words(c: Column) -> Column:
    """Runs of anything but ASCII white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BLANKS), "")


def plain_words(c: Column) -> Column:
    """Runs of digits, letters and non-ASCII, with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NON_WORD), "")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session, or
    one of our own where that is unset and there is one machine only (tests, benches)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return base.rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, so
    that what follows survives lost executors without computing it again. The folder is
    removed when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a settled table that nothing will read again, as loops do with older rounds."""
    _remove(df.sparkSession, df.settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

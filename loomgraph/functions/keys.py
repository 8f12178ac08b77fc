"""Names and edge keys as column expressions.

An edge key is ``a~b``; names match ``NAME_PATTERN``. Every function here is a projection
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "~"
NAME_PATTERN = r"^[A-Za-z0-9_.+-]+$"


def edge_key(source: Column | str, target: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, source, target)


def low(a: Column | str, b: Column | str) -> Column:
    return F.least(a, b)


def high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(a, b)


def parse_edge_key(key: Column | str, strict: bool = True) -> Column:
    """Struct (source, target); exactly one separator and two names, else an error (or null)."""
    parts = F.split(key, SEPARATOR)
    good = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    bad = F.raise_error(F.concat(F.lit("not an edge key: "), F.coalesce(key, F.lit("null")))) if strict else F.lit(None)
    pair = F.struct(parts[0].alias("source"), parts[1].alias("target"))
    return F.when(good, pair).otherwise(bad.cast("struct<source: string, target: string>"))


def sanitize_name(raw: Column | str, fallback: Column | str) -> Column:
    """Runs of characters that a name can't hold become one ``_``; outer ones go."""
    c = F.col(raw) if isinstance(raw, str) else raw
    f = F.col(fallback) if isinstance(fallback, str) else fallback
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_.+-]+", "_"), "^_+|_+$", "")
    return F.when(clean != "", clean).otherwise(f)


def intermediate_name(a: Column, b: Column, smiles: Column) -> Column:
    """Name of a vertex invented between two others, from a digest of its structure."""
    return F.concat(F.lit("int_"), a, F.lit("_"), b, F.lit("_"), F.substring(F.sha1(smiles), 1, 6))

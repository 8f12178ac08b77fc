"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def text(v) -> str:
    if v is None or str(v) in ("<NA>", "NaT") or v != v:
        return "null"
    if isinstance(v, float) or type(v).__name__.startswith(("float", "Decimal")):
        return f"{float(v):.9g}"
    return str(v)


def rows(pdf, columns) -> list:
    return sorted(tuple(text(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False))


def compare(spark, sf_dir, query, sql) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for a, b in zip(rows(got, columns), rows(want, columns), strict=True):
        same = all(x == y or (x not in ("null", "True", "False") and y not in ("null", "True", "False") and _close(x, y)) for x, y in zip(a, b, strict=True))
        assert same, (a, b)


def _close(x: str, y: str) -> bool:
    try:
        return abs(float(x) - float(y)) <= 1e-9 * max(1.0, abs(float(x)))
    except ValueError:
        return False

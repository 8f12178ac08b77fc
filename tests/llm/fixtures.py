"""Small tables with the awkward cases that every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega Äther Öl ÇA naïve İx".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def texts(seed: int = 1) -> list:
    """(doc_id, text): unique texts, shared passages, exact and near copies, and edge cases."""
    r = random.Random(seed)
    passage = prose(r, 70)
    out = [(i, prose(r, r.randint(1, 220))) for i in range(1, 30)]
    out += [(i, prose(r, 30) + "\n" + passage + " " + prose(r, 20)) for i in range(30, 36)]
    out += [(36, passage), (37, passage), (38, passage.upper()), (39, out[5][1]), (40, out[5][1] + " extra")]
    out += [(41, None), (42, ""), (43, " \t\n\x0b "), (44, "x"), (45, "a b c a b c a b c"), (46, " é z 12 " * 40), (47, "long " + prose(r, 9000)), (48, "a" * 5000)]
    out += [(45, "a b c a b c a b c"), (None, passage), (-3, "neg " + passage)]
    return out


def documents(spark, rows=None, extra: bool = False):
    rows = texts() if rows is None else rows
    full = [(i, t, "en" if i is None or i % 2 else None, None if i is not None and i % 7 == 0 else f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:  # names that operators use themselves
        for c in ("w", "b", "p", "key", "hits", "fp", "node", "_text", "size", "score", "kept", "n_words", "findings"):
            df = df.withColumn(c, df["doc_id"])
    return df


def write(df, path, name):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")

"""The pipeline, stage by stage, against plain Python on a small corpus."""

import random
import re

import corpus_pipeline as P
from loomgraph.llm import decontaminate
from loomgraph.llm.common import settle
from tests.llm.fixtures import documents, prose, texts, write
from tests.llm.test_operators import slow_components, slow_print


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def test_awkward_tables(spark, tmp_path):
    """Null ids, repeated rows, one id with two texts, clashing columns; and empty tables."""
    r = random.Random(31)
    twice, other = prose(r, 60), prose(r, 60)
    rows = [*texts(), (70, twice), (70, twice), (71, other), (71, prose(r, 60)), (None, twice), (None, prose(r, 50))]
    docs = documents(spark, rows, extra=True)
    for c in ("row", "found", "cut", "clean", "bad_id", "rejected", "text_hash", "_keep_id", "_row", "_src", "a b"):
        docs = docs.withColumn(c, docs["doc_id"])
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame([(1, dict(rows)[36])], "item_id long, text string"), tmp_path, "benchmark")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in P.STAGES:
        before, now = now, settle(stage(spark, now, str(tmp_path)), name)
        got = [(x.doc_id, x.text) for x in now.select("doc_id", "text").collect()]
        if name == "mix":
            assert set(columns) - {"size"} <= set(now.columns)
            break
        assert now.columns == columns
        if name == "near_duplicates":
            assert got.count((70, twice)) == 1 and (None, twice) in got and len([x for x in got if x[0] == 71]) == 2
            assert len([x for x in got if x[0] is None]) == before.where("doc_id IS NULL").count()
        if name == "benchmark":
            w = words(dict(rows)[36])
            grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
            clean = lambda t: not any(tuple(words(t)[i : i + 10]) in grams for i in range(len(words(t))))
            assert sorted(got, key=str) == sorted(((x.doc_id, x.text) for x in before.collect() if clean(x.text)), key=str)
    write(documents(spark, [], extra=True), tmp_path / "empty", "documents")
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path / "empty", "benchmark")
    assert P.run(spark, str(tmp_path / "empty")).count() == 0
    write(documents(spark, rows[:12]), tmp_path / "empty", "documents")
    assert P.run(spark, str(tmp_path / "empty")).count() > 0


def test_stages(spark, tmp_path):
    rows = [x for x in texts() if x[0] is not None and x[0] != 45]
    key = "0123456789abcdef0123456789abcdef01234567"
    rows += [(60, f'alpha beta token = "{key}" gamma delta epsilon'), (61, "12345 67890")]
    write(documents(spark, rows), tmp_path, "documents")
    item = dict(rows)[36]
    write(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "near_duplicates", "benchmark", "secrets", "mix"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == columns
    assert {41, 42, 43, 61} & set(seen["language"]) == set() and {1, 2, 3, 47} <= set(seen["language"])
    prints = {i: slow_print(r.text) for i, r in seen["language"].items()}
    assert set(seen["near_duplicates"]) == set(slow_components(prints).values())
    w = words(item)
    grams = {tuple(w[i : i + decontaminate.SPAN]) for i in range(len(w) - decontaminate.SPAN + 1)}

    def clean(t):
        x = words(t)
        return not any(tuple(x[i : i + decontaminate.SPAN]) in grams for i in range(len(x)))

    assert set(seen["benchmark"]) == {i for i, r in seen["near_duplicates"].items() if clean(r.text)}
    assert set(seen["secrets"]) == set(seen["benchmark"])
    assert key not in seen["secrets"][60].text and seen["secrets"][60].n_chars == len(seen["secrets"][60].text)
    assert all(seen["secrets"][i].text == r.text for i, r in seen["benchmark"].items() if i != 60)
    assert all(r.taken > 0 for r in seen["mix"].values()) and set(seen["mix"]) <= set(seen["secrets"])
    whole = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.taken for r in whole} == {i: r.taken for i, r in seen["mix"].items()}

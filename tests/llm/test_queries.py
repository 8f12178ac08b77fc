"""The corpus queries against DuckDB, on generated tables and on ones full of edge cases."""

import pytest

from loomgraph.llm import queries as Q
from tests.llm.fixtures import documents, write
from tests.oracle import compare

DOCUMENT_SQL = [n for n in Q.SQL if n != "op8_chat_format"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    # rows that occur twice and rows without an id are compared by the tests of the operators
    from tests.llm.fixtures import texts

    rows = list({i: (i, t) for i, t in texts() if i is not None}.values())
    write(documents(spark, rows), path, "documents")
    passage = dict(rows)[36]
    items = [(1, passage), (2, passage + " more words follow here"), (3, "alpha beta"), (4, None), (5, ""), (6, "!!!"), (7, "kappa"), (11, "cc by general public license"), (12, "alpha beta")]
    write(spark.createDataFrame(items, "item_id long, text string"), path, "benchmark")
    turns = [(1, 0, "user", "hi <|turn|> \\ <"), (1, 1, "assistant", "\\<|text|>a\\"), (1, 2, "user", None), (2, 0, "system", ""), (3, 1, "assistant", "b"), (3, 0, "user", "c<|end|>"), (3, 2, "assistant", "é🙂"), (3, 2, "assistant", "é🙂"), (4, 0, None, "r"), (5, 0, "user", "x" * 50000)]
    write(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), path, "conversations")
    return path


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_generated(spark, data, name):
    compare(spark, data, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_awkward(spark, awkward, name):
    compare(spark, awkward, Q.QUERIES[name], Q.SQL[name])


def test_empty_tables(spark, tmp_path):
    write(documents(spark, []), tmp_path, "documents")
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    write(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    for name, q in Q.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name == "op8_chat_format" else 0), name

"""Substring dedup with fixed-block anchors (operator 1).

A window is WINDOW consecutive words. Every aligned block of BLOCK words (places 0, BLOCK,
2 BLOCK ...) is indexed, and every place is probed with the hash of the BLOCK words there.
As WINDOW = 2 BLOCK, each window holds a whole block, so where a window occurs in two
documents, each of them probes a block of the other. Three passes:

A. Blocks and probes meet by hash. A probe hits if a document with a smaller id has the
   block; a block is an owner if a document with a larger id probes it.
B. Hits are extended: each document hashes the windows that reach over its hits (and, as
   owner, over its hit blocks) and these meet by hash. A window goes if it also starts in a
   document with a smaller id: so the runs of windows that go are the maximal exact repeats.
C. Each document drops the words that those windows cover.

Nothing is compared pair by pair: a passage in n documents costs n hashes. What a chunk of
documents can settle by itself never reaches an exchange: of a probe or block that SHARED
documents of a chunk have, only the largest document's probe and the smallest one's block
travel, the others go to pass B at once; and of a window that many documents of a chunk
have, only the smallest document's travels, as the others are gone anyway. So a passage in
a third of all documents costs a part of the hash space a few entries a chunk.

Hashes travel packed: one row holds what a chunk of documents has for one part of the hash
space, 4 bytes a probe (chance hits among those are undone by pass B) and 16 bytes a
window. Passes B and C need the texts by document; one exchange serves both. The number of
parts follows the input, so a part stays at PART_BYTES of text; beyond about a terabyte a
packed row holds few entries and a probe costs tens of bytes.

Words have 128-bit XXH3 hashes, and those of a run are combined by halves in two lanes with
full mixing (no polynomial, so no constructed words collide). Equal windows are windows of
equal 128-bit hashes: among 10^13 of them a wrong pair has a chance of about 10^-13.

Edge cases: null and empty texts have no words; very long texts are read in pieces; a
document without an id neither loses words nor makes others lose them; rows of one doc_id
(repeated or not) don't shorten each other; ties cannot occur, as the smallest id decides;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import settle, table

WINDOW, BLOCK = 50, 25
PART_BYTES, CHUNK_BYTES = 24 << 20, 2 << 20
#: Documents of a chunk that share a probe or block from which on it is settled there.
SHARED = 3

_U = np.uint64
_BLANK = re.compile(rb"[ \t-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _joined(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs (a, b) followed by runs (c, d)."""
    x = _mix(a * _U(0x9E3779B97F4A7C15) + c * _U(0xD1342543DE82EF95))
    return x, _mix((b ^ x) * _U(0xA0761D6478BD642F) + d * _U(0xE7037ED1A0B428DB))


def _pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text cut at white space, so that long ones need little memory."""
    at = 0
    while len(text) - at > most and (m := _BLANK.search(text, at + most)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


class Words:
    """The words of a chunk of documents: their documents, places and hashes (two lanes)."""

    def __init__(self, texts: list[bytes | None]) -> None:
        counts, digests, digest = [], [], xxhash.xxh3_128_digest
        for t in texts:
            n = 0
            for piece in _pieces(t or b""):
                w = piece.split()  # of bytes: ASCII white space
                n += len(w)
                digests.append(b"".join(map(digest, w)))
            counts.append(n)
        lanes = np.frombuffer(b"".join(digests), _U).reshape(-1, 2)
        self.a, self.b = np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1])
        self.count = np.array(counts, np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))
        self.doc = np.repeat(np.arange(len(counts)), self.count)
        self.place = np.arange(len(self.a)) - self.begin[self.doc]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, hash in two lanes) of every run of so many words within a document."""
        at = np.flatnonzero(self.place + length <= self.count[self.doc])
        n, done, size, out = len(self.a) - length + 1, 0, 1, None
        if n <= 0:
            return at, self.a[:0], self.b[:0]
        x, y = self.a, self.b  # of runs of ``size`` words
        while size <= length:
            if length & size:
                part = x[done : done + n], y[done : done + n]
                out = part if out is None else _joined(*out, *part)
                done += size
            if 2 * size <= length:
                x, y = _joined(x[:-size], y[:-size], x[size:], y[size:])
            size *= 2
        return at, out[0][at], out[1][at]


def _chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(from, to, texts) of runs of rows with about so many bytes."""
    column = column.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else []
    s = size = 0
    for i, n in enumerate(sizes):
        size += int(n)
        if size >= most or i + 1 == len(column):
            yield s, i + 1, column.slice(s, i + 1 - s).to_pylist()
            s, size = i + 1, 0


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(hashes ^ _U(0x5851F42D4C957F2D)) % _U(parts)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(0xFFFFFFFF)).astype(np.uint32)


def _settled(a: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of probes with hashes a in documents ids, some of them of blocks: which travel as
    probes, and which as blocks, as the chunk can't settle them."""
    order = np.lexsort((ids, a))
    key, who = a[order], ids[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    other = new | np.concatenate(([True], who[1:] != who[:-1])) if len(key) else new
    few = np.bincount(group, other)[group] < SHARED if len(key) else new
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(key)])) - 1
    probes = few | (who == who[last[group]]) if len(key) else new
    # the smallest document that has it as a block
    owner = np.where(block[order], who, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(owner, first)[group] if len(key) else owner
    blocks = block[order] & (few | (who == least))
    as_probe, as_block = np.empty(len(a), bool), np.empty(len(a), bool)
    as_probe[order], as_block[order] = probes, blocks
    return as_probe, as_block


def _packed(part: np.ndarray, doc: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray]) -> Iterator[list]:
    """Rows [part, ids of the documents ..., entries of each, values ...] of entries sorted
    by part and document."""
    if not len(part):
        return
    cuts = np.flatnonzero((part[1:] != part[:-1]) | (doc[1:] != doc[:-1])) + 1
    firsts, counts = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(part)])))
    own, who = part[firsts], doc[firsts]
    groups = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
    ends = np.concatenate((firsts, [len(part)]))
    for s, e in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
        v = slice(ends[s], ends[e])
        yield [int(own[s]), *(x[who[s:e]].tobytes() for x in ids), counts[s:e].astype(np.uint32).tobytes(), *(x[v].tobytes() for x in values)]


def _batches(rows: Iterator[list], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


_B, _I, _L = pa.binary(), pa.int32(), pa.int64()
_BLOCKS_AND_PROBES = _schema(("part", _I), ("kind", _I), ("ids", _B), ("prints", _B), ("counts", _B), ("values", _B))
_HITS = _schema(("bucket", _I), ("ids", _B), ("prints", _B), ("counts", _B), ("values", _B))
_DOC_HITS = _schema(("doc_id", _L), ("_text", _L), ("hits", _B))
_WINDOWS = _schema(("part", _I), ("kind", _I), ("ids", _B), ("prints", _B), ("counts", _B), ("values", _B), ("a", _B), ("b", _B))
_GONE = _HITS
_DOC_GONE = _schema(("doc_id", _L), ("_text", _L), ("runs", _B))
_DDL = {"int32": "int", "int64": "long", "binary": "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_document(parts: int, ids: np.ndarray, prints: np.ndarray, values: np.ndarray) -> Iterator[list]:
    """Rows [bucket, ids, prints, counts, values] of entries packed by a hash of the document:
    a row per part of the documents, however many documents and entries there are. Entries
    that occur twice are one."""
    if not len(ids):
        return
    bucket = _part(ids.view(_U), parts)
    order = np.lexsort((values, prints, ids, bucket))
    bucket, ids, prints, values = bucket[order], ids[order], prints[order], values[order]
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])))
    kept = new | np.concatenate(([True], values[1:] != values[:-1]))
    doc = np.cumsum(new) - 1
    yield from _packed(bucket[kept], doc[kept], [x[new] for x in (ids, prints)], [values[kept]])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, text hash, distinct values) of each document."""
    columns: list[list[np.ndarray]] = [[], [], []]
    for b in batches:
        for r in b.to_pylist():
            counts = np.frombuffer(r["counts"], np.uint32)
            columns[0].append(np.repeat(np.frombuffer(r["ids"], np.int64), counts))
            columns[1].append(np.repeat(np.frombuffer(r["prints"], np.int64), counts))
            columns[2].append(np.frombuffer(r["values"], np.uint32))
    if not columns[0]:
        return
    ids, prints, values = (np.concatenate(c) for c in columns)
    order = np.lexsort((values, prints, ids))
    ids, prints, values = ids[order], prints[order], values[order]
    cuts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])) + 1, [len(ids)]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ids[s]), int(prints[s]), np.unique(values[s:e])


def _index(parts: int):
    """Pass A, over documents, packed: blocks (kind 0) and probes (1) by part of the hash
    space, and hits that the chunk knows of (2) by part of the documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            every_id, every_print = _numbers(b, "doc_id"), _numbers(b, "_text")
            for s, e, texts in _chunks(b.column("text")):
                words, ids, prints = Words(texts), every_id[s:e], every_print[s:e]
                at, a, other = words.windows(BLOCK)
                doc, block = words.doc[at], words.place[at] % BLOCK == 0
                probe, block_goes = _settled(a, ids[doc], block)
                part, short = _part(other, parts), _short(a)
                for kind, mine in ((1, probe), (0, block_goes)):
                    sel = np.flatnonzero(mine)
                    sel = sel[np.argsort(part[sel], kind="stable")]
                    for r in _packed(part[sel], doc[sel], [ids, prints], [short[sel]]):
                        yield [r[0], kind, *r[1:]]
                known = ~probe | (block & ~block_goes)
                for r in _by_document(parts, ids[doc[known]], prints[doc[known]], short[known]):
                    yield [r[0], 2, *r[1:]]

    return lambda batches: _batches(rows(batches), _BLOCKS_AND_PROBES)


def _by_part(batches: Iterator[pa.RecordBatch], settled: int, schema: pa.Schema, parts: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """Hands on the rows of the kind that is settled, and gathers the others by part."""
    for b in batches:
        known = []
        for r in b.to_pylist():
            if r["kind"] == settled:
                known.append([r["part"], *(r[x] for x in ("ids", "prints", "counts", "values"))])
            else:
                parts.setdefault(r["part"], []).append(r)
        yield from _batches(iter(known), schema)


def _columns(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, prints) of the documents of all rows, and for each entry its document."""
    ids, prints, counts = (np.frombuffer(b"".join(r[x] for r in rows), t) for x, t in (("ids", np.int64), ("prints", np.int64), ("counts", np.uint32)))
    return ids, prints, np.repeat(np.arange(len(ids), dtype=np.int32), counts)


def _meet(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pass A, over the parts: the hashes by which documents have hits."""
    held: dict[int, list[dict]] = {}
    yield from _by_part(batches, 2, _HITS, held)
    while held:
        _, rows = held.popitem()
        sides = [[r for r in rows if r["kind"] == kind] for kind in (0, 1)]
        del rows
        if not sides[0] or not sides[1]:
            continue
        block, probe = (np.frombuffer(b"".join(r["values"] for r in x), np.uint32) for x in sides)
        (own_ids, own_prints, own_doc), (ids, prints, doc) = map(_columns, sides)
        del sides
        known, number = np.unique(block, return_inverse=True)
        smallest, largest = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(smallest, number, own_ids[own_doc])
        i = np.minimum(np.searchsorted(known, probe), len(known) - 1)
        there = np.flatnonzero(known[i] == probe)
        i, who, probe = i[there], doc[there], probe[there]
        np.maximum.at(largest, i, ids[who])
        hit, owns = smallest[i] < ids[who], own_ids[own_doc] < largest[number]
        who, own_doc = who[hit], own_doc[owns]
        out = [np.concatenate(x) for x in ((ids[who], own_ids[own_doc]), (prints[who], own_prints[own_doc]), (probe[hit], block[owns]))]
        yield from _batches(_by_document(parts, *out), _HITS)


def _hits_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(([doc, text, hits.tobytes()] for doc, text, hits in _gathered(batches)), _DOC_HITS)


def _extend(parts: int):
    """Pass B, over documents with hits: hashes of the windows over the hits, packed (kind
    0), and by document the windows that a smaller document of the chunk has too (1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            every_id, every_print = _numbers(b, "doc_id"), _numbers(b, "_text")
            every_hit = [np.frombuffer(x, np.uint32) for x in b.column("hits").to_pylist()]
            for s, e, texts in _chunks(b.column("text")):
                words, ids, prints = Words(texts), every_id[s:e], every_print[s:e]
                at, a, _ = words.windows(BLOCK)
                # places whose hash is among the hits of their document
                hits = np.concatenate([h.astype(_U) | _U(i << 32) for i, h in enumerate(every_hit[s:e])])
                mine = _short(a).astype(_U) | (words.doc[at].astype(_U) << _U(32))
                m = at[hits[np.minimum(np.searchsorted(hits, mine), len(hits) - 1)] == mine]
                # windows that hold a hit's BLOCK words start up to WINDOW - BLOCK before it
                cover = np.zeros(len(words.doc) + 1, np.int64)
                np.add.at(cover, np.maximum(m - (WINDOW - BLOCK), words.begin[words.doc[m]]), 1)
                np.add.at(cover, m + 1, -1)
                start, x, y = words.windows(WINDOW)
                chosen = np.cumsum(cover)[start] > 0
                start, x, y = start[chosen], x[chosen], y[chosen]
                doc, place = words.doc[start], words.place[start].astype(np.uint32)
                gone = _smaller(x, y, ids[doc])
                for r in _by_document(parts, ids[doc[gone]], prints[doc[gone]], place[gone]):
                    yield [r[0], 1, *r[1:], None, None]
                sel = np.flatnonzero(~gone)
                to = _part(x[sel], parts)
                order = np.argsort(to, kind="stable")
                sel = sel[order]
                for r in _packed(to[order], doc[sel], [ids, prints], [place[sel], x[sel], y[sel]]):
                    yield [r[0], 0, *r[1:]]

    return lambda batches: _batches(rows(batches), _WINDOWS)


def _smaller(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows, with hashes (x, y) in documents ids, a smaller document has too."""
    if not len(x):
        return np.empty(0, bool)
    order = np.lexsort((y, x))
    a, b, who = x[order], y[order], ids[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    gone = np.empty(len(x), bool)
    gone[order] = np.minimum.reduceat(who, np.flatnonzero(new))[np.cumsum(new) - 1] < who
    return gone


def _settle_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pass B, over the parts: the windows that start in a smaller document too."""
    held: dict[int, list[dict]] = {}
    yield from _by_part(batches, 1, _GONE, held)
    while held:
        _, rows = held.popitem()
        ids, prints, doc = _columns(rows)
        places, x, y = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("values", np.uint32), ("a", _U), ("b", _U)))
        del rows
        gone = _smaller(x, y, ids[doc])
        doc = doc[gone]
        yield from _batches(_by_document(parts, ids[doc], prints[doc], places[gone]), _GONE)


def _runs_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word runs that a document's windows cover: first, end, first, end ..."""

    def rows() -> Iterator[list]:
        for doc, text, places in _gathered(batches):
            starts = places.astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + WINDOW)))
            ends = np.concatenate((starts[new[1:] - 1], starts[-1:])) + WINDOW
            yield [doc, text, np.stack([starts[new], ends], axis=1).astype(np.uint32).tobytes()]

    yield from _batches(rows(), _DOC_GONE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass C, over documents: the words that stay."""
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text").cast(pa.binary())
        total, removed, spans, kept = [], [], [], []
        for text, runs in zip(texts, b.column("runs").to_pylist(), strict=True):
            words = (text.as_py() or b"").split()
            total.append(len(words))
            cut = np.frombuffer(runs or b"", np.uint32).reshape(-1, 2).tolist()
            for first, end in reversed(cut):
                del words[first:end]
            removed.append(total[-1] - len(words))
            spans.append([{"first": first, "end": end} for first, end in cut])
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row each: doc_id, n_words, n_removed, removed (runs of
    word places, end exclusive) and kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL").withColumn("_text", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    met = named.mapInArrow(_index(parts), _ddl(_BLOCKS_AND_PROBES)).repartition(parts, "part").mapInArrow(functools.partial(_meet, parts=parts), _ddl(_HITS))
    hits = settle(met.repartition(parts, "bucket").mapInArrow(_hits_of_documents, _ddl(_DOC_HITS)), "anchors")
    windows = named.join(hits, ["doc_id", "_text"]).select("doc_id", "_text", "text", "hits").mapInArrow(_extend(parts), _ddl(_WINDOWS))
    gone = windows.repartition(parts, "part").mapInArrow(functools.partial(_settle_windows, parts=parts), _ddl(_GONE))
    gone = gone.repartition(parts, "bucket").mapInArrow(_runs_of_documents, _ddl(_DOC_GONE))
    every = named.join(gone, ["doc_id", "_text"], "left").select("doc_id", "text", "runs")
    every = every.unionByName(docs.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast("binary")))
    return every.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, removed array<struct<first: long, end: long>>, kept string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (
  SELECT k, min(doc_id) AS least_doc FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN m USING (k) WHERE least_doc < doc_id
), g AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS e ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

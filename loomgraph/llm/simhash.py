"""SimHash near-dedup with bit-sliced comparison (operator 6).

1. Every text gets a 64-bit fingerprint from its 3-word shingles (Arrow batches).
2. Equal fingerprints are one node; components are named by their smallest doc_id at last.
3. Two fingerprints that differ in at most 3 bits are equal in one of 4 blocks of 16 bits,
   so nodes meet by (block, value). A bucket of more than SPLIT nodes is dealt again by
   the same rule over its other 48 bits, and then over the 36 left: 16 and 64 finer tables
   that still hold every pair. What is large even then is cut into chunks, and every pair
   of chunks is a bucket of its own. No pair of nodes is skipped at any size.
4. Inside a bucket, fingerprints are stored by bit plane, 64 to a machine word. A probe
   meets all at once: each plane that differs is added to bitwise counters (ones, twos,
   over three) with carry-save steps, and a block is abandoned once all are over. Links
   are joined at once in a union-find, so a bucket of m nodes reports m - 1 at most.
5. Components of the links by large-star and small-star rounds over DataFrames.

Edge cases: null, empty and blank texts have fingerprint 0 and link like any other; fewer
than 3 words are one shingle; very long texts are counted in pieces; rows of one doc_id keep
a row each (same component if their fingerprints link); rows without a doc_id link, but name
no component; ties in a bit (set in exactly half) are 0; an empty table gives no rows; other
columns are ignored, also with clashing names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, settle, table

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Nodes of a bucket beyond which it is dealt anew, and of a chunk of those that stay large.
SPLIT = 2_000


def fingerprint(text: bytes | str | None) -> int:
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def _blocks(level: int, prefix: str = "") -> list[tuple[str, int]]:
    """(name, mask) of the tables of a level: each block of the level before leaves bits
    that are cut into four blocks again."""
    out = [("", 0)]
    for _ in range(level):
        finer = []
        for name, mask in out:
            left = [b for b in range(64) if not mask >> b & 1]
            n = len(left) // 4
            finer += [(f"{name}{k}", mask | sum(1 << b for b in left[k * n : (k + 1) * n])) for k in range(4)]
        out = finer
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(nodes: DataFrame, level: int) -> DataFrame:
    """(table, part, node, fp): a row for every table of this level."""
    tables = _blocks(level)
    rows = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("part")) for i, (_, mask) in enumerate(tables)])
    return nodes.select("node", "fp", F.explode(rows).alias("x")).select(F.lit(level).alias("level"), "x.table", "x.part", "node", "fp")


def _buckets(nodes: DataFrame, split: int) -> DataFrame:
    """(level, table, part, a, b, chunk, node, fp): the rows of a group by all but the last
    three are compared, those of chunk a with those of chunk b."""
    keys = ["level", "table", "part"]
    ready, todo = [], nodes
    for level in (1, 2, 3):
        dealt = _dealt(todo, level)
        sizes = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        dealt = dealt.join(sizes, keys)
        if level < 3:
            ready.append(dealt.where(F.col("n") <= split))
            large = dealt.where(F.col("n") > split)
            # dealt anew whole: a node of a large bucket meets the nodes of all large buckets
            todo = settle(large.select("node", "fp").distinct(), "simhash-large")
            if todo.isEmpty():
                break
        else:
            ready.append(dealt)
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    chunks = F.ceil(F.col("n") / F.lit(split)).cast("int")
    out = out.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("a"), F.greatest("chunk", o).alias("b")))
    return out.select(*keys, F.explode(pairs).alias("x"), "chunk", "node", "fp").select(*keys, "x.a", "x.b", "chunk", "node", "fp")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of all fingerprints, 64 to a word."""
    pad = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros(pad, np.uint64)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near(probes: np.ndarray, sliced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, lane) of all fingerprints in the planes within RADIUS (3) bits of a probe.

    One element per probe and block of 64 lanes; after every 8 planes only the blocks in
    which a lane is still within the radius go on.
    """
    full, words = np.uint64(0xFFFFFFFFFFFFFFFF), sliced.shape[1]
    probe, block = np.repeat(np.arange(len(probes)), words), np.tile(np.arange(words), len(probes))
    ones, twos, over = (np.zeros(len(probe), np.uint64) for _ in range(3))
    for k in range(64):
        flip = np.where(probes >> np.uint64(k) & np.uint64(1), full, np.uint64(0))
        differs = sliced[k][block] ^ flip[probe]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7 and not (live := over != full).all():
            probe, block, ones, twos, over = (x[live] for x in (probe, block, ones, twos, over))
    lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(lanes)
    return probe[at], block[at] * 64 + bit


def link(nodes: np.ndarray, fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(node, root) links of all pairs, one of ``left`` and one of ``right`` (masks), within
    the radius: a star around the smallest node per component."""
    order = np.argsort(nodes, kind="stable")
    nodes, fps, left, right = nodes[order], fps[order], left[order], right[order]
    label = np.arange(len(nodes))
    lanes, todo = np.flatnonzero(right), np.flatnonzero(left)
    sliced = planes(fps[lanes])
    for s in range(0, len(todo), PROBES):
        own = todo[s : s + PROBES]
        i, j = near(fps[own], sliced)
        i, j = i[j < len(lanes)], j[j < len(lanes)]
        pairs = np.unique(np.sort(np.stack([label[own[i]], label[lanes[j]]], axis=1), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].tolist()
        if not pairs:
            continue
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        new = np.arange(len(nodes))
        for x in list(parent):
            new[x] = root(x)
        label = new[label]
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[linked], nodes[label[linked]]], axis=1)


#: Probes that are compared at once, and rows of small buckets that are compared together
#: (a link between two buckets is a link all the same).
PROBES, TOGETHER = 256, 512


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come as sorted runs of rows; what is not complete waits for the next batch.
    Neighbouring buckets of one chunk are gathered up to TOGETHER rows."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])
    whole: list[np.ndarray] = []  # complete buckets of one chunk
    held: list[np.ndarray] = []  # the bucket that may go on
    key: tuple[int, ...] | None = None
    out: list[np.ndarray] = []

    def run(parts: list[np.ndarray]) -> None:
        rows = np.concatenate(parts)
        every = np.ones(len(rows), bool)
        out.append(link(rows[:, 1], rows[:, 2].view(np.uint64), every, every))

    def close() -> None:
        """The held bucket is complete."""
        nonlocal whole, held
        if held and key[3] == key[4] == 0 and sum(map(len, held)) < TOGETHER:
            whole += held
        elif held:
            rows = np.concatenate(held)
            out.append(link(rows[:, 1], rows[:, 2].view(np.uint64), rows[:, 0] == key[3], rows[:, 0] == key[4]))
        held = []
        if sum(map(len, whole)) >= TOGETHER:
            run(whole)
            whole = []

    def emit() -> Iterator[pa.RecordBatch]:
        if out:
            x = np.concatenate(out)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], axis=1)
        v = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (5, 6, 7)], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(k[s].tolist())
            if now != key:
                close()
                key = now
            held.append(v[s:e])
        yield from emit()
    close()
    if whole:
        run(whole)
    yield from emit()


def links(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """nodes (node, fp), fp distinct, to links (node, root) whose components are those of
    all pairs within the radius."""
    keys = ["level", "table", "part", "a", "b"]
    buckets = _buckets(nodes, split).repartition(*keys).sortWithinPartitions(*keys)
    return buckets.select(*keys, "chunk", "node", "fp").mapInArrow(_compare, "node long, root long").distinct()


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (node, root) reaches.

    Rounds of large-star and small-star (every node hands its larger, then its smaller
    neighbours to its smallest neighbour) until a round changes nothing: a number of rounds
    that grows with the logarithm of the longest chain.
    """
    flat = settle(edges.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        older, flat = flat, settle(small, "links")
        forget(older)
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return flat.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def _found(docs: DataFrame, split: int) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row of docs; component is
    the smallest fingerprint, component_id the smallest doc_id of a group."""
    prints = settle(fingerprints(docs), "simhash")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    comp = components(links(nodes.select(F.col("fp").alias("node"), "fp"), split))
    # only linked fingerprints are joined, the smallest of each group among them
    roots = comp.select(F.col("component").alias("node"), "component").distinct()
    linked = nodes.join(comp.unionByName(roots), F.col("fp") == F.col("node")).select("fp", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.drop("least").join(smallest, "component")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    named = settle(named, "simhash-names")  # so that Spark can split the join of a fingerprint with many rows
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    return _found(docs, split).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs with one row of every group of linked fingerprints: the one with the smallest
    doc_id (of several texts under that id, the one with the smallest hash), once. Rows
    without a doc_id stay."""
    found = settle(_found(docs, split).where("doc_id IS NOT NULL"), "simhash-found")
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    keep = settle(least.select(F.col("x.doc_id").alias("_keep_id"), F.col("x.text_hash").alias("_keep_text")), "simhash-keep")
    named = docs.where(docs["doc_id"].isNotNull())
    same = (docs["doc_id"].cast("long") == keep["_keep_id"]) & (F.xxhash64(docs["text"]) == keep["_keep_text"])
    # merge: the ids grow with the documents, so no size of them is a bound to broadcast by
    out = named.join(keep.hint("merge"), same, "left_semi")
    repeated = settle(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice_id"), F.col("text_hash").alias("_twice_text")), "simhash-repeated")
    if not repeated.isEmpty():
        out = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text")).dropDuplicates(["id", "text"]).select("row.*")
    return out.unionByName(docs.where(docs["doc_id"].isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")



"""Candidate pairs as joins: strategies, similarity, prefilter, reconnection.

Vertices are rows (campaign, name, ord, fp: array<int> ...); ``ord`` is the input order
within the campaign. All operators work on many campaigns at once and never compare across
them: every join has the campaign as an equality key.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.unionfind import Forest
from loomgraph.plans.options import NetworkOptions, PlanError

KEY = "campaign"
#: Vertices of a block: pairs of two blocks are compared in one task, as one matrix.
BLOCK = 1024
#: Members whose columns are multiplied at once.
MEMBERS = 4096


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that a table can meet one it derives from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _sides(vertices: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    cols = ["name", "ord", *columns]
    return tuple(vertices.select(KEY, *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in (1, 2))


def expand(vertices: DataFrame, strategy: str = "all_unordered_pairs", hub: str | None = None, explicit: Iterable[str] = ()) -> DataFrame:
    """(campaign, source, target, ord_1, ord_2) by strategy; ordered by (ord_1, ord_2)."""
    a, b = _sides(vertices)
    if strategy == "linear":
        row = Window.partitionBy(KEY).orderBy("ord")
        out = vertices.select(KEY, F.col("name").alias("source"), F.lead("name").over(row).alias("target"), F.col("ord").alias("ord_1"), F.lead("ord").over(row).alias("ord_2"))
        return out.where("target IS NOT NULL")
    if strategy == "explicit":
        spark = vertices.sparkSession
        listed = spark.createDataFrame([(i, *s.split("~")) for i, s in enumerate(explicit)], "i int, name_1 string, name_2 string")
        pairs = a.join(listed, "name_1").join(b, [KEY, "name_2"])
        row = Window.partitionBy(KEY, F.least("name_1", "name_2"), F.greatest("name_1", "name_2")).orderBy("i")
        pairs = pairs.withColumn("_r", F.row_number().over(row)).where("_r = 1")
    else:
        pairs = a.join(b, KEY)
        if strategy == "all_unordered_pairs":
            pairs = pairs.where("ord_1 < ord_2")
        elif strategy == "all_pairs":
            pairs = pairs.where("ord_1 <> ord_2")
        elif strategy == "star":
            pairs = pairs.where((F.col("name_1") == hub) & (F.col("name_2") != hub))
        else:
            raise ValueError(f"no pair strategy {strategy!r}")
    return pairs.select(KEY, F.col("name_1").alias("source"), F.col("name_2").alias("target"), "ord_1", "ord_2")


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; of two empty sets 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similarities(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """pairs (campaign, source, target ...) with ``sim``."""
    fp = vertices.select(KEY, "name", "fp")
    one, two = (fp.select(KEY, F.col("name").alias(n), F.col("fp").alias(f"_{n}")) for n in ("source", "target"))
    return pairs.join(one, [KEY, "source"]).join(two, [KEY, "target"]).withColumn("sim", tanimoto(F.col("_source"), F.col("_target"))).drop("_source", "_target")


def tanimoto_matrix(fp: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``tanimoto`` of the sets at places a, in rows, and those at b: shared members are counted
    by a product of incidence columns."""
    fp = fp.combine_chunks()
    size = fp.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(len(size)), size)
    member = np.asarray(fp.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), np.int64)  # null is a member of its own
    last = int(member.max(initial=-1)) + 1
    shared, total = np.zeros((len(a), len(b)), np.float32), np.zeros(len(size))
    for first in range(0, last, MEMBERS):
        part = (member >= first) & (member < first + MEMBERS)
        has = np.zeros((len(size), min(MEMBERS, last - first)), np.float32)
        has[owner[part], member[part] - first] = 1
        total += has.sum(axis=1)
        shared += has[a] @ has[b].T
    union = total[a][:, None] + total[b][None, :] - shared
    return np.divide(shared, union, out=np.zeros(shared.shape), where=union > 0)


class Cell:
    """All pairs of two blocks of a campaign's vertices, or of one block with itself.

    ``sim`` is the matrix of similarities, ``valid`` marks what is a pair, and ``rank_a`` and
    ``rank_b`` order the names of both blocks.
    """

    def __init__(self, table: pa.Table, alone: bool) -> None:
        one = np.asarray(table["_one"].to_numpy(), bool)
        self.table, self.alone = table, alone
        names, order = table["name"].to_pylist(), table["ord"].to_numpy()
        place = {x: k for k, x in enumerate(sorted(set(names)))}
        self.place, rank = place, np.array([place[x] for x in names], np.int64)
        self.at_a = np.flatnonzero(one)
        self.at_b = self.at_a if alone else np.flatnonzero(~one)
        self.rank_a, self.rank_b = rank[self.at_a], rank[self.at_b]
        self.ord_a, self.ord_b = order[self.at_a], order[self.at_b]
        self.valid = self.ord_a[:, None] != self.ord_b[None, :]
        self.sim = tanimoto_matrix(table["fp"], self.at_a, self.at_b)

    def cut(self, i: np.ndarray, j: np.ndarray, value: np.ndarray, group: np.ndarray, most: int, by_pair: bool) -> np.ndarray:
        """Which of the pairs (i, j) are among the first ``most`` of their group: the most similar
        first, ties by the names of source and target (or, if not by pair, by that of j)."""
        if by_pair:
            swap = self.ord_a[i] > self.ord_b[j]
            ties = (np.where(swap, self.rank_a[i], self.rank_b[j]), np.where(swap, self.rank_b[j], self.rank_a[i]))
        else:
            ties = (self.rank_b[j],)
        order = np.lexsort((*ties, -value, group))
        in_order = group[order]
        out = np.zeros(len(i), bool)
        out[order] = np.arange(len(i)) - np.searchsorted(in_order, in_order) < most
        return out

    def turned(self) -> Cell:
        """The same pairs with both blocks in each other's place."""
        out = object.__new__(Cell)
        out.table, out.alone, out.place = self.table, self.alone, self.place
        for x in ("at", "rank", "ord"):
            setattr(out, f"{x}_a", getattr(self, f"{x}_b"))
            setattr(out, f"{x}_b", getattr(self, f"{x}_a"))
        out.sim, out.valid = self.sim.T, self.valid.T
        return out

    def nearest(self, most: int, by_pair: bool) -> np.ndarray:
        """Mask of the first ``most`` pairs of every row."""
        out = np.zeros(self.sim.shape, bool)
        if not out.size:
            return out
        value = np.where(self.valid, self.sim, -1.0)
        least = np.full(len(value), 0.0) if value.shape[1] <= most else np.maximum(-np.partition(-value, most - 1, axis=1)[:, most - 1], 0.0)
        i, j = np.nonzero(value >= least[:, None])
        kept = self.cut(i, j, value[i, j], i, most, by_pair)
        out[i[kept], j[kept]] = True
        return out

    def forest(self) -> np.ndarray:
        """Mask of a spanning forest of the most similar pairs, ties by the lesser and the greater
        name: from one vertex on, the best pair that leads out of what is joined."""
        na, nb = self.sim.shape
        out = np.zeros((na, nb), bool)
        if not out.size:
            return out
        value = np.where(self.valid, self.sim, -1.0)
        n = na if self.alone else na + nb
        rank = self.rank_a if self.alone else np.concatenate([self.rank_a, self.rank_b])
        wide = int(rank.max()) + 1
        best, tie, by, left = np.full(n, -2.0), np.zeros(n, np.int64), np.full(n, -1), np.ones(n, bool)
        for _ in range(n):
            open_best = np.where(left, best, -3.0)
            top = open_best.max()
            x = int((ties := np.flatnonzero(open_best == top))[tie[ties].argmin()])
            left[x] = False
            if top >= 0:
                p, q = (by[x], x) if self.alone or x >= na else (x, by[x])
                out[(p, q) if self.alone else (p, q - na)] = True
            row = np.full(n, -2.0)
            if self.alone:
                row = value[x]
            elif x < na:
                row[na:] = value[x]
            else:
                row[:na] = value[:, x - na]
            key = np.minimum(rank, rank[x]) * wide + np.maximum(rank, rank[x])
            better = left & (row >= 0) & ((row > best) | ((row == best) & (key < tie)))
            best[better], tie[better], by[better] = row[better], key[better], x
        return out | out.T if self.alone else out

    def rows(self, mask: np.ndarray, key: pa.Scalar) -> pa.Table:
        """(campaign, source, target, ord_1, ord_2, sim) of the marked pairs, each once."""
        mask = mask & self.valid
        if self.alone:
            mask = (mask | mask.T) & (self.ord_a[:, None] < self.ord_b[None, :])
        i, j = np.nonzero(mask)
        swap = self.ord_a[i] > self.ord_b[j]
        a, b = self.at_a[i], self.at_b[j]
        first, second = pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b))
        name, order = self.table["name"].combine_chunks(), self.table["ord"].combine_chunks()
        return pa.table({KEY: pa.repeat(key, len(i)), "source": name.take(first), "target": name.take(second), "ord_1": order.take(first), "ord_2": order.take(second), "sim": pa.array(self.sim[i, j])})


def compared(vertices: DataFrame, pick, *extra: str) -> DataFrame:
    """(campaign, source, target, ord_1, ord_2, sim) of the unordered pairs that ``pick`` marks,
    source before target by ``ord``. Every pair of a campaign is compared, block against block:
    only what is marked leaves the task that compares it.

    ``pick`` takes a Cell and returns a mask; ``extra`` names columns that its table needs.
    """
    spark = vertices.sparkSession
    v = vertices.select(KEY, "name", F.col("ord").cast("long").alias("ord"), "fp", *extra).where(f"{KEY} IS NOT NULL AND ord IS NOT NULL AND name IS NOT NULL")
    large = [(r[0], -(-r[1] // BLOCK)) for r in v.groupBy(KEY).count().where(F.col("count") > BLOCK).collect()]
    kind = vertices.schema[KEY].dataType.simpleString()
    blocks = spark.createDataFrame(large, f"{KEY} {kind}, _n long")
    v = v.join(F.broadcast(blocks), KEY, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    v = v.withColumn("_i", F.pmod(F.xxhash64("name", "ord"), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_j")
    v = v.select(KEY, "name", "ord", "fp", *extra, "_i", other).select(KEY, "name", "ord", "fp", *extra, (F.col("_i") <= F.col("_j")).alias("_one"), F.least("_i", "_j").alias("_p"), F.greatest("_i", "_j").alias("_q"))
    cells = sum(n * (n + 1) // 2 for _, n in large)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, cells // 8)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        cell = Cell(table, key[1] == key[2])
        return cell.rows(pick(cell), key[0])

    # as many tasks as asked for: rows are few, what is done with them is not
    return v.repartition(tasks, KEY, "_p", "_q").groupBy(KEY, "_p", "_q").applyInArrow(one, f"{KEY} {kind}, source string, target string, ord_1 long, ord_2 long, sim double")


def all_similarities(vertices: DataFrame) -> DataFrame:
    """``compared`` for all unordered pairs."""
    return compared(vertices, lambda cell: cell.valid)


def nearest(vertices: DataFrame, top_k: int, floor: float | None = None, by_pair: bool = False) -> DataFrame:
    """Pairs among which are the ``top_k`` most similar of every vertex and all that reach the
    floor. Ties go by the other's name, or by source and target. Of a block, only the first of
    each of its vertices and what reaches the floor leave it, so the ranking over all that is
    still to come sees rows by the vertices, not by the pairs."""

    def pick(cell: Cell) -> np.ndarray:
        out = cell.nearest(top_k, by_pair)
        out = out | (out.T if cell.alone else cell.turned().nearest(top_k, by_pair).T)
        return out if floor is None else out | (cell.sim >= floor)

    return compared(vertices, pick)


def forests(vertices: DataFrame) -> DataFrame:
    """Spanning forests of the blocks' pairs, the most similar first: they hold a spanning forest
    of all pairs, whatever pairs go before, as an edge that closes a cycle of better ones is in
    none. For ``reconnect``."""
    return compared(vertices, Cell.forest)



def set_similarities(vertices: DataFrame) -> DataFrame:
    """(campaign, u, v, sim) of all unordered pairs that share a member, by an inverted index.

    Where members are rare, pairs meet by member, so those that share nothing are never formed.
    Where the index would make more hits than the campaign has pairs, it is met block by block:
    a pair's hits are added up in the task that finds them, and only pairs leave it.
    """
    member = vertices.select(KEY, "name", F.size("fp").alias("n"), F.explode("fp").alias("bit"))
    hits = member.groupBy(KEY, "bit").agg(F.count("*").cast("double").alias("n")).groupBy(KEY).agg(F.sum(F.col("n") * F.col("n")).alias("hits"))
    dense = vertices.groupBy(KEY).agg(F.count("*").cast("double").alias("n")).join(hits, KEY).where("hits >= n * n").select(KEY)
    rare = member.join(fresh(dense), KEY, "left_anti")
    a, b = (rare.select(KEY, "bit", F.col("name").alias(x), F.col("n").alias(f"n_{x}")) for x in ("u", "v"))
    shared = a.join(b, [KEY, "bit"]).where("u < v").groupBy(KEY, "u", "v", "n_u", "n_v").agg(F.count("*").alias("c"))
    by_member = shared.select(KEY, "u", "v", (F.col("c") / (F.col("n_u") + F.col("n_v") - F.col("c"))).alias("sim"))
    by_block = compared(vertices.join(fresh(dense), KEY, "left_semi"), lambda cell: cell.sim > 0)
    return by_member.union(by_block.select(KEY, F.least("source", "target"), F.greatest("source", "target"), "sim"))


def prefilter(pairs: DataFrame, sims: DataFrame, top_k: int, min_similarity: float) -> DataFrame:
    """The pairs that are among the ``top_k`` of either end (ties by name) or reach the floor.
    ``sims`` (campaign, source, target, sim) covers all unordered pairs, not just the given, or
    what ``nearest`` leaves of them."""
    ends = sims.select(KEY, "source", "target", "sim", F.explode(F.array(F.struct(F.col("source").alias("own"), F.col("target").alias("other")), F.struct(F.col("target").alias("own"), F.col("source").alias("other")))).alias("x")).select(KEY, "source", "target", "sim", "x.*")
    row = Window.partitionBy(KEY, "own").orderBy(F.desc("sim"), "other")
    kept = ends.withColumn("_r", F.row_number().over(row)).where((F.col("_r") <= top_k) | (F.col("sim") >= min_similarity))
    kept = kept.select(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    named = pairs.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    return named.join(kept, [KEY, "u", "v"], "left_semi").drop("u", "v")


def reconnect(kept: DataFrame, sims: DataFrame, vertices: DataFrame) -> DataFrame:
    """(campaign, u, v): the pairs that join the components of ``kept`` again, the most
    similar first (ties by name): a spanning forest over the components.

    ``sims`` are those of all unordered pairs, or what ``forests`` leaves of them.
    """
    edges = kept.select(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.lit(2.0).alias("sim"))
    rest = sims.select(KEY, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "sim").join(edges.drop("sim"), [KEY, "u", "v"], "left_anti")

    def span(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(pd.unique(pdf[["u", "v"]].to_numpy().ravel()))
        pdf = pdf.sort_values(["sim", "u", "v"], ascending=[False, True, True])
        out = [(key[0], u, v) for u, v, s in zip(pdf.u, pdf.v, pdf.sim, strict=True) if forest.join(u, v) and s < 2.0]
        return pd.DataFrame(out, columns=[KEY, "u", "v"])

    kind = vertices.schema[KEY].dataType.simpleString()
    return edges.unionByName(rest).groupBy(KEY).applyInPandas(span, f"{KEY} {kind}, u string, v string")


def candidates(vertices: DataFrame, options: NetworkOptions) -> DataFrame:
    """The pairs to evaluate: strategy, then prefilter with reconnection, then forced pairs,
    without banned ones: (campaign, source, target, pair_ord, restored)."""
    pairs = expand(vertices, options.pair_strategy, options.hub, options.explicit_pairs).withColumn("restored", F.lit(False))
    if options.prefilter == "fingerprint":
        near = nearest(vertices, options.prefilter_k, options.prefilter_min_tanimoto)
        kept = prefilter(pairs, near, options.prefilter_k, options.prefilter_min_tanimoto)
        back = reconnect(kept, forests(vertices), vertices)
        pairs = kept.unionByName(_ordered(back, vertices).withColumn("restored", F.lit(True)))
    if options.forced_edges:
        forced = expand(vertices, "explicit", explicit=["~".join(p) for p in sorted(options.forced_pairs)])
        pairs = pairs.unionByName(forced.withColumn("restored", F.lit(False)))
    pairs = pairs.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")})
    pairs = pairs.join(banned(vertices, options), ["u", "v"], "left_anti")
    row = Window.partitionBy(KEY, "source", "target").orderBy("restored")
    pairs = pairs.withColumn("_r", F.row_number().over(row)).where("_r = 1")
    order = F.row_number().over(Window.partitionBy(KEY).orderBy("restored", "ord_1", "ord_2")) - 1
    return pairs.select(KEY, "source", "target", order.alias("pair_ord"), "restored")


def _ordered(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(campaign, u, v) as source and target in input order."""
    a, b = _sides(vertices)
    both = pairs.join(a.withColumnRenamed("name_1", "u"), [KEY, "u"]).join(b.withColumnRenamed("name_2", "v"), [KEY, "v"])
    first = F.col("ord_1") < F.col("ord_2")
    return both.select(KEY, F.when(first, F.col("u")).otherwise(F.col("v")).alias("source"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("target"), F.least("ord_1", "ord_2").alias("ord_1"), F.greatest("ord_1", "ord_2").alias("ord_2"))


def banned(vertices: DataFrame, options: NetworkOptions) -> DataFrame:
    rows = sorted(options.banned_pairs)
    return vertices.sparkSession.createDataFrame(rows or [], "u string, v string")


def check_names(vertices: DataFrame) -> None:
    """Raises if a campaign has a name twice."""
    twice = vertices.groupBy(KEY, "name").count().where("count > 1").limit(5).collect()
    if twice:
        raise PlanError(f"names that occur twice: {[(r[0], r[1]) for r in twice]}")

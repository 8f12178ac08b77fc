"""Language ID by interpolated Kneser-Ney character models (operator 10).

One model of order ORDER per language, over texts in which case is folded, letters and marks
(Unicode categories L and M, in composed form) stay, and any run of other characters is one
space. The counts of all training texts
are summed by Spark (per task first, then by n-gram), and Spark makes the model of all of
them: continuation counts, context totals, discounts and probabilities are joins and
windows. The model is written to the shared folder as sorted arrays, in shards by key that
hold about SHARD_ROWS rows each; tasks map the files into memory and look up by binary
search. Nothing of it is gathered by the driver but the names of the files. An n-gram that
a language lacks backs off to the next lower order of that language.

The language with the lowest cross-entropy per character wins. The score is its posterior
against the others, with the evidence of a long text limited so that scores stay
calibrated. A text is rejected if its cross-entropy is far above that of the language's own
training texts (mean plus REJECT_SDS standard deviations, over all of them, and
REJECT_MARGIN), or if it has no letter.

Edge cases: null, empty and letterless texts (digits, fractions and marks alone are no
letters) are ``und`` with score 0 and rejected; very long texts are read in pieces, cut at a
space; ties go to the first language in code point order; repeated rows are judged one by
one; with no labelled text at all everything is ``und``; an empty table gives no rows; other
columns pass through (columns of the result's names are replaced).
"""

from __future__ import annotations

import atexit
import functools
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import _remove, scratch_dir, settle, table

ORDER, DISCOUNT = 4, 0.75
#: N-grams of a language that a task sums up before it hands them on, and rows of a shard of
#: the model, about. Neither leaves anything out.
HELD_GRAMS, SHARD_ROWS = 600_000, 1_000_000
#: Characters of evidence that a score takes into account at most.
EVIDENCE = 40.0
REJECT_SDS, REJECT_MARGIN = 6.0, 1.5
CHUNK_CHARS = 1 << 19
_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _kinds(codes: np.ndarray) -> np.ndarray:
    """2 for letters, 1 for marks, else 0."""
    if "kinds" not in _tables:
        _tables["kinds"] = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(1 << 16)], np.uint8)
    out = _tables["kinds"][np.minimum(codes, 0xFFFF)]  # U+FFFF is no character
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        distinct, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in distinct.tolist()], np.uint8)[back]
    return out


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the texts, each folded and between spaces, and where each begins.
    Those beyond 16 bits take the codes between that no letter has, by remainder."""
    folded = [f" {unicodedata.normalize('NFC', t).lower()} " if t else "" for t in texts]
    raw = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in folded], np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    kinds = _kinds(raw)
    word = kinds > 0
    # of a run of other characters the first one stays, as a space
    keep = word | np.concatenate(([True], word[:-1] | (doc[1:] != doc[:-1])))[: len(raw)]
    keep &= (np.bincount(doc, kinds == 2, len(texts)) > 0)[doc]
    codes = np.where(word, raw, 32)[keep]
    codes = np.where(codes > 0xFFFF, 0xD800 + codes % (0xF900 - 0xD800), codes)
    return codes.astype(_U), np.concatenate(([0], np.cumsum(np.bincount(doc, keep, len(texts)).astype(np.int64))))


def _pieces(texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """The texts with those of over CHUNK_CHARS cut at spaces, and the text of each piece."""
    out, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while t and len(t) - at > CHUNK_CHARS and (cut := t.find(" ", at + CHUNK_CHARS)) >= 0:
            out.append(t[at:cut])
            owner.append(i)
            at = cut
        out.append(t[at:] if t and at else t)
        owner.append(i)
    return out, np.array(owner, np.int64)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each character from the nth on: 16 bits a character."""
    out = np.zeros(max(len(codes) - n + 1, 0), _U)
    for k in range(n):
        out = (out << _U(16)) | codes[k : k + len(out)]
    return out


def _inside(begins: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which n-grams lie within one text."""
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    m = max(total - n + 1, 0)
    return doc[:m] == doc[n - 1 : n - 1 + m]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    s = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= CHUNK_CHARS:
            yield s, i + 1
            s, size = i + 1, 0
    if s < len(texts):
        yield s, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-grams of order ORDER by language, for a task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def out(lang: str) -> Iterator[pa.RecordBatch]:
        keys, counts = merged(lang)
        held[lang] = []
        for s in range(0, len(keys), 50_000):
            k = keys[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(counts[s : s + 50_000])], ["lang", "gram", "n"])

    for b in batches:
        langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
        for lang in sorted(set(langs.tolist())):
            mine = [texts[i] for i in np.flatnonzero(langs == lang).tolist()]
            for s, e in _runs(mine):
                codes, begins = _codes(mine[s:e])
                g = _grams(codes, ORDER)[_inside(begins, ORDER, len(codes))]
                if len(g):
                    held.setdefault(lang, []).append(tuple(np.unique(g, return_counts=True)))
                    if len(held[lang]) > 8:
                        held[lang] = [merged(lang)]
                        if len(held[lang][0][0]) > HELD_GRAMS:
                            yield from out(lang)
    for lang in sorted(held):
        if held[lang]:
            yield from out(lang)


class Model:
    """Log-probabilities of n-grams, ``tables[n]``, and log weights of contexts that n-grams
    begin with, ``tables[-n]``: lists of shards (keys, languages, values) with a row for each
    language that has the key, sorted by key. A model that Spark made has ``files`` of those,
    (table, path), that are opened where it is restored."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """In memory, of sorted n-grams and their counts for each language."""
        self.languages, self.files = languages, []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        per_lang = [self._orders(k, c) for k, c in counts]
        alphabet = max(2, len(np.unique(np.concatenate([o[1][0] for o in per_lang]))) + 1)
        self.floor = np.zeros(len(languages))
        for j, o in enumerate(per_lang):
            lower = None
            for n in range(1, ORDER + 1):
                k, c = o[n]
                contexts, at = np.unique(k >> _U(16) if n > 1 else np.zeros(len(k), _U), return_inverse=True)
                total, types = np.bincount(at, c), np.bincount(at)
                back = DISCOUNT * types / total
                if n == 1:
                    below = 1.0 / alphabet
                    self.floor[j] = np.log(back[0] / alphabet)
                else:
                    below = lower[np.searchsorted(o[n - 1][0], k & _U((1 << (16 * (n - 1))) - 1))]
                lower = np.maximum(c - DISCOUNT, 0) / total[at] + back[at] * below
                for t, x, v in ((n, k, lower), (-n, contexts, back)):
                    found.setdefault(t, []).append((x, np.full(len(x), j, np.int32), np.log(v).astype(np.float32)))
        self.tables = {}
        for t, parts in found.items():
            keys, lang, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            self.tables[t] = [(keys[order], lang[order], values[order])]

    @classmethod
    def restored(cls, state: dict) -> Model:
        """From ``__dict__``: plain values, which executors can read without this module."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        if out.files:
            out.tables = {}
            for t, path in out.files:
                out.tables.setdefault(t, []).append(_open(path))
        return out

    def on(self, files: list[tuple[int, str]]) -> Model:
        """This model with its tables in files, not opened yet."""
        self.files = files
        return self

    @staticmethod
    def _orders(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order and, below it, continuation counts: in how many
        n-grams of the next order an n-gram is the end."""
        out = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            k, c = np.unique(out[n + 1][0] & _U((1 << (16 * n)) - 1), return_counts=True)
            out[n] = (k, c.astype(np.float64))
        return out

    def _fill(self, t: int, keys: np.ndarray, out: np.ndarray) -> None:
        """Puts what table t has of the keys (sorted, distinct) into rows of ``out``."""
        for have, lang, value in self.tables.get(t, ()):
            s, e = int(np.searchsorted(keys, have[0])), int(np.searchsorted(keys, have[-1], "right"))
            if s == e:
                continue
            lo = np.searchsorted(have, keys[s:e])
            n = np.searchsorted(have, keys[s:e], "right") - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            out[np.repeat(np.arange(s, e), n), lang[at]] = value[at]

    def _look(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Rows of log-probabilities for sorted, distinct n-grams; where a language lacks one
        it backs off."""
        if n == 0:
            return np.tile(self.floor, (len(keys), 1))
        out = np.full((len(keys), len(self.languages)), np.nan)
        self._fill(n, keys, out)
        gaps = np.isnan(out)
        rows = np.flatnonzero(gaps.any(axis=1))
        if len(rows):
            lower, at = np.unique(keys[rows] & _U((1 << (16 * (n - 1))) - 1), return_inverse=True)
            below = self._look(lower, n - 1)[at]
            if n > 1:
                contexts, at = np.unique(keys[rows] >> _U(16), return_inverse=True)
                weight = np.zeros((len(contexts), len(self.languages)))
                self._fill(-n, contexts, weight)
                below += weight[at]
            out[rows] = np.where(gaps[rows], below, out[rows])
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropies in nats a character, and characters scored."""
        parts, owner = _pieces(texts)
        if len(parts) > len(texts):
            sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
            for s, e in _runs(parts):
                h, c = self.entropies(parts[s:e])
                np.add.at(sums, owner[s:e], np.where(c[:, None] > 0, h * c[:, None], 0.0))
                np.add.at(counts, owner[s:e], c)
            with np.errstate(invalid="ignore"):
                return sums / counts[:, None], counts
        codes, begins = _codes(texts)
        n_docs = len(begins) - 1
        sums, counts = np.zeros((n_docs, len(self.languages))), np.zeros(n_docs)
        doc = np.repeat(np.arange(n_docs), np.diff(begins))
        g, ok = _grams(codes, ORDER), _inside(begins, ORDER, len(codes))
        g, owner = g[ok], doc[ORDER - 1 :][ok] if len(codes) >= ORDER else doc[:0]
        if len(g):
            distinct, back = np.unique(g, return_inverse=True)
            logp = self._look(distinct, ORDER)
            for j in range(len(self.languages)):
                sums[:, j] = np.bincount(owner, logp[back, j], n_docs)
            counts = np.bincount(owner, minlength=n_docs).astype(float)
        # texts too short for one n-gram of the highest order: their longest n-gram
        for i in np.flatnonzero((counts == 0) & (np.diff(begins) > 0)).tolist():
            x = codes[begins[i] : begins[i + 1]]
            sums[i], counts[i] = self._look(_grams(x, len(x)), len(x))[0], 1
        with np.errstate(invalid="ignore"):
            return -sums / counts[:, None], counts


def _local(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _open(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard, mapped into memory where the shared folder is a file system."""
    store, at = _local(path)
    rows = pa.ipc.open_file(pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)).get_batch(0)
    return tuple(rows.column(i).to_numpy() for i in range(3))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes sorted rows (t, key, lang, value) as a shard for each table t; a task that is
    run again writes files of other names. Keys come with the first bit turned, which sorts
    signed numbers as unsigned ones."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    t, key, lang, value = (rows.column(i).to_numpy() for i in range(4))
    key = key.view(_U) ^ _U(1 << 63)
    cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
    store, at = _local(folder)
    store.create_dir(at, recursive=True)
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        name = f"{uuid.uuid4().hex}.arrow"
        part = pa.RecordBatch.from_arrays([pa.array(key[s:e]), pa.array(lang[s:e]), pa.array(value[s:e])], ["key", "lang", "value"])
        with store.open_output_stream(f"{at}/{name}") as out, pa.ipc.new_file(out, part.schema) as file:
            file.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([int(t[s])], pa.int32()), pa.array([name])], ["t", "name"])


def fit(labelled: DataFrame) -> Model | None:
    """The model of all labelled (text, lang); none if there is no n-gram. Rows of null lang
    are left out."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    spark = labelled.sparkSession
    counts = settle(labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid")
    names = sorted((r.lang for r in counts.select("lang").distinct().collect()), key=lambda x: x.encode())
    if not names:
        return None
    lang = (F.array_position(F.lit(names), F.col("lang")) - 1).cast("int")
    orders = {ORDER: counts.select(lang.alias("lang"), "gram", F.col("n").cast("double").alias("n"))}
    for n in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (16 * n)) - 1)).alias("gram")
        orders[n] = settle(orders[n + 1].groupBy("lang", short).agg(F.count("*").cast("double").alias("n")), "langid-order")
    alphabet = float(max(2, orders[1].select("gram").distinct().count() + 1))
    lower, tables, floor = None, [], {}
    for n in range(1, ORDER + 1):
        around = Window.partitionBy("lang", "context")
        rows = orders[n].withColumn("context", F.shiftrightunsigned("gram", 16))
        rows = rows.withColumn("total", F.sum("n").over(around)).withColumn("back", DISCOUNT * F.count("*").over(around) / F.col("total"))
        if n == 1:
            rows = rows.withColumn("below", F.lit(1.0 / alphabet))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))).join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("below")), ["lang", "short"])
        rows = settle(rows.select("lang", "gram", "context", "back", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below")).alias("p")), "langid-p")
        lower = rows
        if n == 1:
            floor = {r.lang: r.back / alphabet for r in rows.groupBy("lang").agg(F.first("back").alias("back")).collect()}
        for t, key, value in ((n, "gram", "p"), (-n, "context", "back")):
            part = rows.select(F.lit(t).alias("t"), F.col(key).bitwiseXOR(F.lit(-(1 << 63))).alias("key"), "lang", F.log(value).cast("float").alias("value"))
            tables.append(part if t > 0 else part.distinct())
    every = functools.reduce(DataFrame.unionByName, tables)
    shards = -(-2 * counts.count() // SHARD_ROWS)
    folder = f"{scratch_dir(spark)}/langid-model-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    files = every.repartitionByRange(shards, "t", "key").sortWithinPartitions("t", "key", "lang").mapInArrow(lambda b: _write(b, folder), "t int, name string").collect()
    return Model.restored({"languages": names, "floor": np.log([floor[j] for j in range(len(names))]), "files": [], "tables": {}}).on([(r.t, f"{folder}/{r.name}") for r in files])


def train(labelled: DataFrame) -> tuple[Model | None, dict[str, float]]:
    """The model of labelled (text, lang), and per language the cross-entropy beyond which
    a text is rejected. Rows of null lang are left out."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    model = fit(labelled)
    if model is None:
        return None, {}
    bound = labelled.sparkSession.sparkContext.broadcast(model.__dict__)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.restored(bound.value)
        for b in batches:
            texts, lang = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for s, e in _runs(texts):
                h, c = m.entropies(texts[s:e])
                j = np.array([m.languages.index(x) for x in lang[s:e]])
                h = h[np.arange(len(j)), j]
                ok = (c >= 20) & np.isfinite(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(lang[s:e], object)[ok], pa.string()), pa.array(h[ok])], ["lang", "h"])

    stats = labelled.mapInArrow(own, "lang string, h double").groupBy("lang").agg(F.count("h").alias("n"), F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect()
    return model, _limits(model.languages, {r.lang: (r.n, r.m, r.s) for r in stats})


def _limits(languages: list[str], stats: dict[str, tuple[int, float, float]]) -> dict[str, float]:
    """Thresholds by (number, mean, deviation) of the entropies of each language's texts. One
    text has no deviation and a language without a scored text has no mean: they take those
    of all texts, each about the mean of its own language and of all languages."""
    out: dict[str, float] = {}
    if not stats:
        return out
    total = sum(n for n, _, _ in stats.values())
    within = (sum(n * s * s for n, _, s in stats.values()) / total) ** 0.5
    mean = sum(n * m for n, m, _ in stats.values()) / total
    spread = (within**2 + sum(n * (m - mean) ** 2 for n, m, _ in stats.values()) / total) ** 0.5
    for x in languages:
        n, m, s = stats.get(x, (0, mean, spread))
        out[x] = m + REJECT_SDS * (within if n == 1 else s) + REJECT_MARGIN
    return out


def identify(docs: DataFrame, model: Model | None, limits: dict[str, float], returned: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score, entropy and rejected. Of the columns of docs, ``returned``
    come back from Python (all by default): texts that nothing needs any more need not."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "entropy", "rejected")]
    back = [c for c in keep if returned is None or c in returned]
    docs = docs.select(*keep)
    if model is None:
        return docs.select(*back).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    bound = docs.sparkSession.sparkContext.broadcast((model.__dict__, limits))
    schema = T.StructType([*(docs.schema[c] for c in back), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, most = bound.value
        m = Model.restored(state)
        worst = np.array([most.get(x, np.inf) for x in m.languages])
        for b in batches:
            texts = b.column(keep.index("text")).to_pylist()
            for s, e in _runs(texts):
                h, c = m.entropies(texts[s:e])
                none = c == 0
                h[none] = 0.0
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                score = 1.0 / np.exp(-(h - low[:, None]) * np.minimum(c, EVIDENCE)[:, None]).sum(axis=1)
                score[none] = 0.0
                lang = np.array(m.languages, object)[best]
                lang[none] = "und"
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(s, e - s).select(back).columns, pa.array(lang, pa.string()), pa.array(score), pa.array(low, mask=none), pa.array(none | (low > worst[best]))],
                    [*back, "lang_pred", "score", "entropy", "rejected"],
                )

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))).select("lang", "text"))
    out = identify(docs.select("doc_id", "text"), model, {}, ["doc_id"])  # no column tells of rejections
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

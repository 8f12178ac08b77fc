"""License scans by diagonal voting (operator 3), in DataFrame functions only.

The hashes of all rolling K-word windows of all texts are joined to the places of the
templates' windows (a constant table). A hit votes for its diagonal, the word place in the
text less that in the template. Votes are gathered per (document, template, diagonal) as the
set of template places; neighbouring diagonals are merged, so a word put in or left out
doesn't split a match; and a span is verified if the template words covered by equal
words of the text are at least MIN_COVER of the template. Templates are notices of a line
and whole licenses alike, of any length.

Beside the templates, three fixed phrases are found word for word (``base``).

Edge cases: null and empty texts have no words; texts may be as long as Spark takes them;
rows of one doc_id and text are scanned once and come out as often as they came in; ties
cannot occur, as all results are counts, sets and extremes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import plain_words, table

K, NEAR, MIN_COVER = 3, 2, 0.8
#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording; a label may have many wordings.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "This project is licensed under the MIT License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
        "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
        "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)


def _split(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _template_rows() -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, words in it, place, the K words there)."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        w = _split(text)
        rows += [(t, label, len(w), i, w[i : i + K]) for i in range(len(w) - K + 1)]
    return rows


def template_index(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({t}, '{label}', {m}, {i}, " + ", ".join(f"'{x}'" for x in w) + ")" for t, label, m, i, w in _template_rows())
    names = ", ".join(f"t{o}" for o in range(K))
    return spark.sql(f"SELECT t, label, m, tp, {names}, xxhash64({names}) AS key FROM VALUES {values} AS v(t, label, m, tp, {names})")


def _base_places() -> str:
    """SQL: (place, label) of all phrases in the words w; looked for only where a word of
    each phrase occurs at all."""
    tests = []
    for phrase, label in PHRASES.items():
        tests.append("WHEN " + " AND ".join(f"get(w, i + {o}) = '{x}'" for o, x in enumerate(phrase.split())) + f" THEN '{label}'")
    some = " OR ".join(f"array_contains(w, '{p.split()[-1]}')" for p in PHRASES)
    return f"CASE WHEN {some} THEN filter(transform(sequence(0, size(w) - 1), i -> struct(i AS i, CASE {' '.join(tests)} END AS l)), x -> x.l IS NOT NULL) ELSE array() END"


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base phrase, else the best verified cover, else 0) and spans
    (label, first and end word, cover)."""
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"), plain_words(F.col("text")).alias("w"))
    words = words.select("doc_id", "_text", "w", F.expr(_base_places()).alias("b"))
    words = words.select("doc_id", "_text", "w", F.size("b").cast("long").alias("n_base"), F.get("b", F.lit(0))["i"].cast("long").alias("first_word"), F.get("b", F.size("b") - 1)["i"].cast("long").alias("last_word"), F.array_distinct(F.col("b.l")).alias("base"))
    # place -1 stands for the document itself and finds nothing
    probes = words.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - K, F.lit(-1)))).alias("p"))
    probes = probes.withColumn("key", F.when(F.col("p") >= 0, F.xxhash64(*[F.get("w", F.col("p") + o) for o in range(K)])))
    same = F.col("t").isNotNull()
    for o in range(K):
        same = same & (F.get("w", F.col("p") + o) == F.col(f"t{o}"))
    own = F.col("p") < 0
    hit = probes.join(F.broadcast(template_index(docs.sparkSession)), "key", "left").where(own | same)
    doc = ["doc_id", "_text"]
    facts = ["n_words", "n_base", "first_word", "last_word", "base"]
    hit = hit.select(*doc, F.when(own, F.struct(F.size("w").cast("long").alias("n_words"), *facts[1:])).alias("facts"), "t", "label", "m", "p", (F.col("p") - F.col("tp")).alias("diagonal"), "tp", own.alias("own"))
    # one exchange by document; all that follows groups within it
    hit = hit.repartition(*doc)
    kept = F.first("facts", ignorenulls=True).alias("facts")
    votes = hit.groupBy(*doc, "t", "label", "m", "diagonal").agg(F.collect_set("tp").alias("tps"), F.min("p").alias("p"), (F.max("p") + K).alias("end"), F.count_if("own").alias("rows"), kept)
    row = Window.partitionBy(*doc, "t").orderBy("diagonal")
    votes = votes.withColumn("_new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(row), F.lit(-(1 << 31)).cast("long")) > NEAR).cast("int"))
    spans = votes.withColumn("_run", F.sum("_new").over(row)).groupBy(*doc, "t", "label", "m", "_run").agg(F.flatten(F.collect_list("tps")).alias("tps"), F.min("p").alias("first"), F.max("end").alias("end"), F.sum("rows").alias("rows"), kept)
    covered = f"size(array_distinct(flatten(transform(tps, i -> sequence(i, i + {K - 1})))))"
    spans = spans.withColumn("cover", F.expr(f"{covered} / m")).where(F.col("t").isNull() | (F.col("cover") >= MIN_COVER))
    found = F.collect_list(F.when(F.col("t").isNotNull(), F.struct("first", "end", "label", "cover")))
    out = spans.groupBy(*doc).agg(kept, F.array_sort(found).alias("spans"), F.max("cover").alias("_best"), F.sum("rows").cast("int").alias("rows"))
    out = out.select("doc_id", "facts.*", "spans", "_best", F.explode(F.sequence(F.lit(1), "rows")))
    base = F.coalesce("base", F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce(F.col("spans.label"), F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"), "spans",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    grams = ", ".join(f"({t}, '{label}', {m}, {i}, '{' '.join(w)}')" for t, label, m, i, w in _template_rows())
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), ph(p, n, l) AS (VALUES {phrases}
), base AS (
  SELECT doc_id, i - 1 AS i, l FROM g JOIN ph ON array_to_string(w[i:i + n - 1], ' ') = p
), b AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY doc_id
), tg(t, label, m, tp, k) AS (VALUES {grams}
), v AS (
  SELECT DISTINCT doc_id, t, label, m, i - 1 - tp AS dg, tp FROM (SELECT doc_id, i, array_to_string(w[i:i + {K - 1}], ' ') AS k FROM g WHERE i + {K - 1} <= len(w)) JOIN tg USING (k)
), r AS (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id, t ORDER BY dg) AS run FROM (
    SELECT doc_id, t, label, m, dg, CASE WHEN dg - lag(dg) OVER (PARTITION BY doc_id, t ORDER BY dg) <= {NEAR} THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT doc_id, t, label, m, dg FROM v))
), s AS (
  SELECT v.doc_id, v.label, count(DISTINCT tp + o) / any_value(v.m) AS cover FROM v JOIN r ON v.doc_id = r.doc_id AND v.t = r.t AND v.dg = r.dg, (SELECT unnest(range({K})) AS o) GROUP BY v.doc_id, v.t, v.label, r.run
), ok AS (
  SELECT * FROM s WHERE cover >= {MIN_COVER}
), best AS (
  SELECT doc_id, max(cover) AS c FROM ok GROUP BY doc_id
), bl AS (
  SELECT doc_id, string_agg(l, ',' ORDER BY l) AS l FROM (SELECT DISTINCT doc_id, l FROM base) GROUP BY doc_id
), al AS (
  SELECT doc_id, string_agg(l, ',' ORDER BY l) AS l FROM (SELECT doc_id, l FROM base UNION SELECT doc_id, label FROM ok) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN bl ON d.doc_id = bl.doc_id LEFT JOIN al ON d.doc_id = al.doc_id LEFT JOIN best ON d.doc_id = best.doc_id
"""


OP3_SQL = _sql()

"""Quality rules as a short-circuit cascade (operator 5), in DataFrame functions only.

Every rule is a reject predicate over statistics of one document. The cascade estimates on a
sample what each rule costs and how much it rejects, puts the rules with the most rejections
per cost first, and compiles them into one ``CASE``: a document that an early rule rejects
never pays for the later ones. The order changes the cost and which rule is named, never the
verdict. Nothing is shuffled but the sums of the sample.

The sample is random by a hash of the text, about SAMPLE_ROWS rows of all; Spark adds up
the rejections and the work, and only these sums reach the driver. Work is counted by the
cost model of each statistic (nanoseconds by bytes and words), not by the clock, so that
reruns agree.

Edge cases: a null or empty text has no words and is rejected by ``few_words``; very long
texts are judged whole; ties in the order keep the order of the rules; repeated rows are
judged one by one; an empty table gives an empty result; other columns pass through, also
with clashing names (statistics replace columns of the same name).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import blank_words, table


@dataclass(frozen=True)
class Rule:
    """``reject`` is SQL over the statistics; ``needs`` are the ones it reads."""

    name: str
    reject: str
    needs: tuple[str, ...]


#: All but the first two reject nothing that reads like prose: word lengths of natural
#: languages, a symbol in every fourth word at most, few repeated lines, letters in half of
#: the words at least, and lines that neither break off nor are all items of lists.
RULES = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words")),
    Rule("short_words", "word_chars < 2 * n_words", ("word_chars", "n_words")),
    Rule("long_words", "word_chars > 20 * n_words", ("word_chars", "n_words")),
    Rule("symbols", "4 * n_symbols > n_words", ("n_symbols", "n_words")),
    Rule("repeated_lines", "n_dup_lines > 10 AND 2 * n_dup_lines > n_lines", ("n_dup_lines", "n_lines")),
    Rule("few_letters", "2 * n_letter_words < n_words", ("n_letter_words", "n_words")),
    Rule("broken_lines", "n_broken_lines > 3 AND 10 * n_broken_lines > 3 * n_lines", ("n_broken_lines", "n_lines")),
    Rule("list_lines", "n_list_lines > 10 AND 10 * n_list_lines > 9 * n_lines", ("n_list_lines", "n_lines")),
)
BASE = ("few_words", "repeated_windows")
SAMPLE_ROWS = 2_000

_LINES = "filter(split(_text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
#: Words inside 3-word windows that occur twice: hash the windows; only where two hashes
#: are equal, sort them with their places, keep those equal to a neighbour, and add up the
#: words that the kept places cover.
_REPEATS = """
CASE WHEN size(_words) < 4 THEN 0L ELSE
 element_at(transform(array(transform(sequence(0, size(_words) - 3),
     i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
   element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    element_at(transform(array(array_sort(filter(transform(s, (e, j) ->
        CASE WHEN e.x = get(s, j - 1).x OR e.x = get(s, j + 1).x THEN e.i END), v -> v IS NOT NULL))), d ->
     aggregate(transform(d, (p, j) -> least(3, coalesce(get(d, j + 1), p + 3) - p)), 0L, (a, b) -> a + b)
    ), 1)), 1) END), 1) END"""
STATS = {
    "n_words": "CAST(size(_words) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join(_words, '')) AS BIGINT)",
    "n_symbols": "CAST(octet_length(_text) - octet_length(regexp_replace(_text, '[#*$%&|<>]+', '')) AS BIGINT)",
    "n_lines": f"CAST(size({_LINES}) AS BIGINT)",
    "n_dup_lines": f"element_at(transform(array({_LINES}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT)), 1)",
    "n_repeat_words": _REPEATS,
    "n_letter_words": "CAST(size(filter(_words, w -> w rlike '\\\\p{L}')) AS BIGINT)",
    "n_broken_lines": f"CAST(size(filter({_LINES}, l -> l rlike '([.]{{3}}|…)[\\\\x20\\\\x09-\\\\x0D]*\\\\z')) AS BIGINT)",
    "n_list_lines": f"CAST(size(filter({_LINES}, l -> l rlike '^[\\\\x20\\\\x09-\\\\x0D]*[-*•]')) AS BIGINT)",
}
#: Nanoseconds that a statistic takes, about: by bytes of the text and by words. Only their
#: proportions matter.
COSTS = {
    "n_words": "1", "word_chars": "octet_length(_text) + 10 * size(_words)", "n_symbols": "6 * octet_length(_text)", "n_lines": "4 * octet_length(_text)", "n_dup_lines": "5 * octet_length(_text)",
    "n_repeat_words": "180 * size(_words)", "n_letter_words": "90 * size(_words)", "n_broken_lines": "6 * octet_length(_text)", "n_list_lines": "5 * octet_length(_text)",
}


def _prepared(docs: DataFrame, text: str, known: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a struct, the text, its words, and the statistics that are known anyway."""
    c = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), c.alias("_text"), blank_words(c).alias("_words"))
    return out.withColumns({k: F.expr(STATS[k]) for k in known})


def _predicate(rule: Rule, known: tuple[str, ...] = ()) -> str:
    """The rule with the statistics that aren't known written out."""
    sql = rule.reject
    for name in sorted(set(rule.needs) - set(known), key=len, reverse=True):
        sql = re.sub(rf"\b{name}\b", lambda _, name=name: f"({STATS[name]})", sql)
    return sql


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, mean cost, rejected share) on a random sample of about ``rows`` rows, the rules
    with the highest rejected share per cost first; equal ones keep their order."""
    every = max(1, docs.count() // rows)
    sample = _prepared(docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), "text", known)
    sums = []
    for i, rule in enumerate(rules):
        cost = " + ".join(["1", *(f"({COSTS[s]})" for s in rule.needs if s not in known)])
        sums += [F.avg(F.expr(cost).cast("double")).alias(f"c{i}"), F.avg(F.coalesce(F.expr(_predicate(rule, known)), F.lit(False)).cast("double")).alias(f"r{i}")]
    got = sample.agg(*sums).first()
    out = [(rule, float(got[f"c{i}"] or 1.0), float(got[f"r{i}"] or 0.0)) for i, rule in enumerate(rules)]
    return sorted(out, key=lambda x: -x[2] / x[1])


def _cascade(rules: list[Rule], known: tuple[str, ...]) -> Column:
    whens = " ".join(f"WHEN {_predicate(r, known)} THEN '{r.name}'" for r in rules)
    return F.expr(f"CASE {whens} END")


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", stats: tuple[str, ...] = (), order: list[Rule] | None = None) -> DataFrame:
    """docs with ``failed_rule`` (the first of the estimated order that rejects, else null)
    and ``kept``. ``stats`` names statistics that become columns; the cascade reads those and
    computes any other only for the documents that get to a rule with it."""
    order = order or [r for r, _, _ in rank_rules(docs, rules, text, known=stats)]
    out = _prepared(docs, text, stats).withColumn("failed_rule", _cascade(order, stats))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (*stats, "failed_rule", "kept")]
    return out.select(*own, *stats, "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), stats=asked)
    base = F.expr(" OR ".join(f"({r.reject})" for r in RULES if r.name in BASE))
    return out.select("doc_id", *asked, base.alias("base_failed"), "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), s AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words, len(list_filter(ls, lambda x: regexp_matches(x, '([.]{3}|…)[\x20\x09-\x0D]*\z'))) AS n_broken_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_list_lines
  FROM l LEFT JOIN rep ON l.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 4 * n_symbols > n_words OR (n_dup_lines > 10 AND 2 * n_dup_lines > n_lines) OR 2 * n_letter_words < n_words
    OR (n_broken_lines > 3 AND 10 * n_broken_lines > 3 * n_lines) OR (n_list_lines > 10 AND 10 * n_list_lines > 9 * n_lines)) AS kept
FROM s
"""

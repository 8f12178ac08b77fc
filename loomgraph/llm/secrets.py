"""Secret scans with a random forest against false positives (operator 2), in DataFrame
and SQL functions only.

Candidates are found by pattern: runs of 16 or more key characters, dots between them
included, that hold a digit or begin as keys of known services do; whatever is assigned to
a name with a secret word, of any length; and quoted values that are assigned to something. A
forest, trained on labelled findings, judges each one by its length, character transitions
and mix, dictionary coverage, path, and the words before and after it. The trained trees are
compiled into SQL, so scoring is a projection: no join, no exchange, no Python.

No table of labelled findings comes with the corpus. The findings to train on by default are
made by rule (``labelled_findings``), so what the forest scores on those tells little; the
tests measure precision and recall on documents. ``train_forest`` takes other findings.

Edge cases: null and empty texts have no candidates; candidates and texts may have any
length; equal candidates in a text are findings of their own; ties (a score of just
THRESHOLD) are secrets; rows of one doc_id are scanned one by one; an empty table gives no
findings; other columns pass through, also with clashing names (``findings`` is replaced).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

NEAR_WORDS = "token|secret|passw|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|bearer|authorization|auth"
#: What keys of known services begin with.
PREFIXES = "AKIA|ASIA|gh[opsur]_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ"
#: A candidate, as a Java pattern of three branches. Lookarounds keep it whole, and those
#: that look back are bounded. A name and its = or : are never part of a value. Of each
#: branch the first tests are implied by the later ones: they cost little and end most tries.
CANDIDATE = "|".join((
    # what is assigned to a name with a secret word, or follows bearer: of any length
    rf"""(?<=[=:> "'])(?<![^=:>rRcC][ ])(?=[^\s"'<>,;])(?<=[=:>][ ]?["']?|(?i:bearer|basic)[ ])(?<=(?i:{NEAR_WORDS})[A-Za-z0-9_-]{{0,24}}["']?[ ]?(?:=>|:=|[:=])[ ]?["']?|(?i:bearer|basic)[ ])"""
    r"""(?!(?i:bearer|basic)[ ])(?:(?<=["'])[^"'\s]+(?=["'])|(?:(?!&[A-Za-z_]+=)[^\s"'<>,;])*(?!&[A-Za-z_]+=)[^\s"'<>,;.:)\]}])""",
    # key characters, or runs of them joined by dots, with a digit or a known beginning
    rf"""(?<![A-Za-z0-9_+/-])(?<![A-Za-z0-9_+/-]\.)(?=[A-Za-z0-9_+/.-]{{14}})(?:(?=[A-Za-z_+/.-]*+[0-9])|(?={PREFIXES}))(?=[A-Za-z0-9_+/.-]{{16}}|[A-Za-z0-9_+/.-]{{14,15}}=)"""
    r"""[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+(?:={1,2}+(?![=A-Za-z0-9_+/"'.-]))?+""",
    # a quoted value that is assigned to something
    r"""(?<=["'])(?<=[=:][ ]?["'])[^"'\s]{8,}(?=["'])""",
))
#: Common words and word parts that keys made by chance seldom hold.
DICTIONARY = (
    "the and ing ion ent tion for with that this from have test user name data file path page index main config value item list "
    "string number date time version release update image photo video report module class function method type model table "
    "column field example sample demo default local remote server client host port http https www com org net html css java "
    "python node build source target final draft copy backup temp cache log error debug info warn home work team project"
).split()
HASH_WORDS = "commit|sha-?1|sha-?256|sha512|md5|digest|checksum|hash|etag|revision|uuid|guid|isbn|issn|doi|version|card|phone|tel|order|invoice"
#: Labelled findings to train on at most, trees, their depth, and the score from which a
#: finding is a secret.
MAX_TRAINING_ROWS, TREES, DEPTH, THRESHOLD = 20_000, 15, 6, 0.5
LEFT, RIGHT = 40, 16
FEATURES = ("length", "transitions", "digits", "uppers", "distinct", "covered", "secret_near", "hash_near", "assigned", "secret_path", "test_path", "known_prefix", "hex", "filler", "closed", "called")


def features(c: str = "c") -> str:
    """SQL for the struct of FEATURES of a candidate struct (value, before, after, path)."""
    v = f"{c}.value"
    n = f"greatest(char_length({v}), 1)"
    kinds = f"regexp_replace(regexp_replace(regexp_replace({v}, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '9')"
    parts = {
        "length": f"CAST(char_length({v}) AS DOUBLE)",
        "transitions": f"1 - (char_length({kinds}) - char_length(regexp_replace({kinds}, '(.)\\\\1+', '$1'))) / {n}",
        "digits": f"1 - char_length(regexp_replace({v}, '[0-9]', '')) / {n}",
        "uppers": f"1 - char_length(regexp_replace({v}, '[A-Z]', '')) / {n}",
        "distinct": f"size(array_distinct(split({v}, ''))) / least({n}, 64)",
        "covered": f"1 - char_length(regexp_replace(lower({v}), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / {n}",
        "secret_near": f"CAST({c}.before rlike '(?i)({NEAR_WORDS})' AS DOUBLE)",
        "hash_near": f"CAST({c}.before rlike '(?i)\\\\b({HASH_WORDS})' AS DOUBLE)",
        "assigned": f"CAST({c}.before rlike '[=:][ ]?[\"\\']?$' AS DOUBLE)",
        "secret_path": f"CAST(coalesce({c}.path, '') rlike '(?i)(env|config|conf|cfg|ini|ya?ml|properties|secret|credential|pem|key)' AS DOUBLE)",
        "test_path": f"CAST(coalesce({c}.path, '') rlike '(?i)(test|example|sample|doc|mock|fixture)' AS DOUBLE)",
        "known_prefix": f"CAST({v} rlike '^({PREFIXES})' AS DOUBLE)",
        "hex": f"CAST({v} rlike '^([0-9a-f]+|[0-9A-F]+)$' AND {v} rlike '[A-Fa-f]' AS DOUBLE)",
        "filler": f"CAST({v} rlike '(?i)(x{{4,}}|example|your|changeme|placeholder|dummy|0{{6,}}|123456)' AS DOUBLE)",
        "closed": f"CAST({c}.before rlike '[\"\\']$' AND left({c}.after, 1) = right({c}.before, 1) AS DOUBLE)",
        "called": f"CAST({c}.after rlike '^[(\\\\[.]' OR {v} rlike '[(]' AS DOUBLE)",
    }
    assert tuple(parts) == FEATURES
    return "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in parts.items()) + ")"


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made by rule from hashes of
    the row number: keys, tokens and passwords where such things stand, and the look-alikes
    that make false positives (digests, card and phone numbers, ids, names, fillers)."""
    pick = "element_at({0}, 1 + CAST(pmod(xxhash64(id, {1}), size({0})) AS INT))"

    def one(values: list[str], salt: int) -> str:
        return pick.format("array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")", salt)

    sha, b64 = "sha1(concat('s', id))", "replace(base64(unhex(sha2(concat('b', id), 256))), '=', '')"
    alnum = f"regexp_replace({b64}, '[+/]', 'q')"
    word = lambda salt: one(DICTIONARY, salt)
    digits = "lpad(CAST(pmod(xxhash64(id, 5), 9999999999999999) AS STRING), 16, '4')"
    mixed = f"regexp_replace({alnum}, '[0-9]', '')"  # letters alone, of both cases
    said = "translate(substr(sha1(concat('w', id)), 1, 4 + CAST(pmod(xxhash64(id, 31), 9) AS INT)), '0123456789', 'aeioulmnrt')"  # a word
    jwt = f"concat('eyJhbGciOiJIUzI1NiJ9.eyJ', substr({alnum}, 1, 30), '.', substr({alnum}, 5, 38))"
    password = f"concat(initcap(substr({said}, 1, 6)), pmod(id, 10), substr({mixed}, 1, 2), {one(['!', '#', '$', '?', '%', '_', ''], 32)})"
    positive = [
        sha, f"substr({alnum}, 1, 32)", f"concat('AKIA', upper(substr({alnum}, 1, 16)))", f"concat('ghp_', substr({alnum}, 1, 36))", f"concat('sk_live_', substr({alnum}, 1, 24))",
        b64, "sha2(concat('k', id), 256)", f"concat('xoxb-', {digits}, '-', substr({alnum}, 1, 20))", f"substr({alnum}, 1, 20)", f"upper({sha})",
        jwt, password, f"substr({mixed}, 1, 24)", f"concat('ghp_', substr({mixed}, 1, 36))", f"concat(lower({password}), substr({sha}, 1, 6))", f"concat(substr({said}, 1, 2), pmod(id, 9), substr({said}, 2, 3), {word(38)}, pmod(id, 100), substr({sha}, 1, 4))",
        f"concat(lower({mixed}), repeat(translate(substr({sha}, 1, 20), '0123456789', 'ghijklmnop'), CAST(pmod(id, 3) AS INT)), substr({sha}, 21, 18))",  # long, of one case
    ]
    negative = [
        sha, digits, f"concat({word(11)}, '_', {word(12)}, '_', {word(13)}, '_v', pmod(id, 20))", f"concat({word(14)}, '-', {word(15)}, '-', {word(16)}, '-', pmod(id, 3000))",
        "concat_ws('-', substr(sha1(CAST(id AS STRING)), 1, 8), substr(sha1(CAST(id AS STRING)), 9, 4), substr(sha1(CAST(id AS STRING)), 13, 4), substr(sha1(CAST(id AS STRING)), 17, 4), substr(sha1(CAST(id AS STRING)), 21, 12))",
        f"concat('2024-0', 1 + pmod(id, 9), '-1', pmod(id, 9), '/', {word(17)}, {word(18)})", "sha2(concat('n', id), 256)", "concat('xxxxxxxxxxxxxxxx', pmod(id, 100))", f"concat({word(19)}, {word(20)}, {word(21)}, {word(22)}, pmod(id, 100))", "concat('your_api_key_example_', pmod(id, 1000))", "md5(CAST(id AS STRING))", f"concat({word(23)}, '/', {word(24)}, '/', {word(25)}, '/', pmod(id, 10000))",
        said, f"initcap({said})", f"concat('get', initcap({word(26)}), initcap({word(27)}))", f"concat({word(28)}, '.', {word(29)}, '.', {said})", one(["None", "null", "true", "string", "required", "password", "unknown", "process.env.TOKEN", "os.environ"], 33),
        f"concat('www.', {said}, '.com/', {word(34)}, '-', pmod(id, 3000))", f"concat({said}, '.', {word(35)}, pmod(id, 100), '@', {said}, '.org')", f"concat({one(['api_key', 'token', 'db_password', 'secret'], 36)}, '_', {word(37)}, '_v', pmod(id, 20))",
    ]
    #: which negatives stand beside digest words, and which beside anything
    before_positive = ['token = "', 'api_key = "', "secret: ", 'password="', "Authorization: Bearer ", 'access_key = "', "TOKEN = \"", "auth_token=", "credential: ", "db_password=", "passwd: ", "secret="]
    before_near = [*before_positive, "author: ", "the token: ", "Password: ", "authors=", "secret=", "passwd: "]
    before_hash = ["commit ", "sha1: ", "md5 ", "checksum ", "digest: ", "uuid ", "revision ", 'etag = "', "sha256:"]
    before_plain = ["see ", "the ", "in ", "und ", "de ", "call ", "card ", "order ", "la ", "of ", "at ", "page ", ""]
    case = lambda xs, salt: "CASE " + " ".join(f"WHEN pmod(xxhash64(id, {salt}), {len(xs)}) = {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    fillers = f"pmod(xxhash64(id, 2), {len(negative)}) IN (7, 9, 12, 13, 14, 15, 16)"
    made = spark.range(min(rows, MAX_TRAINING_ROWS)).selectExpr(
        "CAST(pmod(id, 2) AS DOUBLE) AS label", f"CASE WHEN pmod(id, 2) = 1 THEN {case(positive, 1)} ELSE {case(negative, 2)} END AS value",
        f"""CASE WHEN pmod(id, 2) = 1 AND pmod(xxhash64(id, 1), {len(positive)}) IN (2, 3, 4, 7, 10, 13) AND pmod(xxhash64(id, 41), 2) = 0 THEN {one(before_plain, 3)}
             WHEN pmod(id, 2) = 1 THEN {one(before_positive, 3)} WHEN {fillers} THEN {one(before_near, 3)}
             WHEN pmod(xxhash64(id, 2), {len(negative)}) IN (0, 4, 6, 10) THEN {one(before_hash, 3)} ELSE {one(before_plain, 3)} END AS before""",
        f"""CASE WHEN pmod(id, 2) = 0 AND {fillers} AND pmod(xxhash64(id, 40), 3) = 0 THEN {one(["()", "(", ".get", "[0]"], 39)} ELSE {one([" ", "", ",", ";", "\\n"], 6)} END AS after""",
        f"CASE WHEN pmod(id, 2) = 1 THEN {one(['app.env', 'config.yml', '', '', ''], 4)} ELSE {one(['tests/test_a.py', 'docs/readme', '', '', ''], 4)} END AS path",
    )
    return made.selectExpr("label", "value", "before", """CASE WHEN before rlike '["\\']$' AND after <> '(' THEN concat(right(before, 1), after) ELSE after END AS after""", "path")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> str:
    """Trains on labelled findings (at most MAX_TRAINING_ROWS) and returns the forest as
    SQL over a struct ``f`` of FEATURES: the share of trees that vote for a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.limit(MAX_TRAINING_ROWS).selectExpr("label", "named_struct('value', value, 'before', before, 'after', after, 'path', path) AS c").selectExpr("label", f"{features()} AS f").select("label", "f.*")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return "(" + " + ".join(_tree_sql(t.toDebugString) for t in model.trees) + f") / {float(len(model.trees))}D"


def _tree_sql(text: str) -> str:
    """A tree's printed form, with an If and an Else per split, as nested CASE."""
    lines = iter(x.strip() for x in text.splitlines()[1:] if x.strip())

    def node() -> str:
        line = next(lines)
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])}D"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = node()
        next(lines)  # its Else
        return f"CASE WHEN f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {low} ELSE {node()} END"

    return node()


@functools.lru_cache(maxsize=4)
def _default_forest(spark: SparkSession) -> str:
    return train_forest(labelled_findings(spark))


def scan(docs: DataFrame, forest: str | None = None, path: str | None = None) -> DataFrame:
    """docs with ``findings``: an array of (value, start, score, is_secret) of all
    candidates in ``text``, by place (code points from 0). ``path`` names a column that says
    where a text comes from."""
    forest = forest or _default_forest(docs.sparkSession)
    own = [c for c in docs.columns if c != "findings"]
    where = F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), where.alias("path"))
    out = out.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    # most texts have no candidate: they are not cut
    out = out.withColumn("cut", F.when(F.size("found") > 0, F.split("text", CANDIDATE, -1)))
    findings = F.expr(f"""
      CASE WHEN size(found) > 0 THEN
      transform(
       transform(
        transform(found, (v, i) -> named_struct('value', v, 'before', right(IF(i > 0, concat(right(found[i - 1], {LEFT}), cut[i]), cut[i]), {LEFT}), 'after', left(cut[i + 1], {RIGHT}), 'path', path,
          'start', aggregate(slice(cut, 1, i + 1), 0L, (a, x) -> a + char_length(x)) + aggregate(slice(found, 1, i), 0L, (a, x) -> a + char_length(x)))),
        c -> named_struct('c', c, 'f', {features('c')})),
       x -> element_at(transform(array(x.f), f -> named_struct('value', x.c.value, 'start', x.c.start, 'score', {forest}, 'is_secret', {forest} >= {THRESHOLD}D)), 1))
      ELSE array() END""")
    return out.select("row.*", findings.alias("findings"))


def redact(docs: DataFrame, mark: str = "[secret]", forest: str | None = None, path: str | None = None) -> DataFrame:
    """docs with every secret in ``text`` replaced by ``mark``, by its place: the same
    characters elsewhere, and all else, are left alone. Null texts stay null."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", (F.col(f"`{path}`") if path else F.lit(None)).cast("string").alias("path"))
    placed = F.expr(f"""
      CASE WHEN exists(findings, x -> x.is_secret) THEN aggregate(filter(findings, x -> x.is_secret), named_struct('at', 0L, 'out', ''),
        (a, x) -> named_struct('at', x.start + char_length(x.value), 'out', concat(a.out, substr(text, CAST(a.at + 1 AS INT), CAST(x.start - a.at AS INT)), '{mark}')),
        a -> concat(a.out, substr(text, CAST(a.at + 1 AS INT)))) ELSE text END""")
    clean = scan(whole, forest, "path").select("row", placed.alias("clean"))
    return clean.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents: doc_id, start, n_chars, sha256 of the value, score,
    is_secret (the values themselves are left out of the report)."""
    # an inner explode would have the texts searched twice: the optimizer filters by the size of the findings below it
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path="source").select("doc_id", F.explode_outer("findings").alias("x")).where("x IS NOT NULL")
    value: Column = F.col("x.value")
    return got.select("doc_id", F.col("x.start").alias("start"), F.char_length(value).cast("long").alias("n_chars"), F.sha2(value, 256).alias("value_sha256"), F.col("x.score").alias("score"), F.col("x.is_secret").alias("is_secret"))

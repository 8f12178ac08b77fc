"""Chat formatting by prefix-target expansion (operator 8), in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and
its text alone under the loss mask. Turns that follow the last assistant turn belong to no
reply; they come as a last example without loss, so that the output holds every turn.

The template is ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``; so no marker can stand inside a text, and
dropping each escaping backslash gives the text back.

Edge cases: null texts and roles are empty; turns are ordered by (turn, role, text), null
turns first, so ties and repeated rows have one order; an empty table gives no examples; a
null conv_id is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (0-based), formatted (the whole example), loss_start and loss_end
    (code points of the reply in it; equal where nothing is trained), is_last."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)))
    convs = convs.withColumns({"heads": head, "texts": F.transform("turns", lambda t: escape(t["text"]))})
    # targets: places of the assistant turns, and one past them if other turns follow
    last = F.size("turns") - 1
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    convs = convs.withColumn("targets", F.when(F.coalesce(F.element_at(F.col("turns"), -1)["role"] != "assistant", F.lit(False)), F.array_append(replies, last)).otherwise(replies))
    each = convs.select("conv_id", "turns", "heads", "texts", F.size("targets").alias("n"), F.posexplode("targets").alias("example", "at"))
    pieces = F.transform(F.slice("heads", F.lit(1), F.col("at") + 1), lambda h, i: F.concat(h, F.get("texts", i), F.lit(END)))
    trained = F.get("turns", F.col("at"))["role"] == "assistant"
    each = each.select("conv_id", "example", (F.col("example") == F.col("n") - 1).alias("is_last"), F.array_join(pieces, "").alias("formatted"), F.when(trained, F.char_length(F.get("texts", F.col("at")))).alias("_loss"))
    end = F.char_length("formatted") - len(END)
    return each.select("conv_id", "example", "formatted", (end - F.coalesce("_loss", F.lit(0))).alias("loss_start"), end.alias("loss_end"), "is_last")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def one(p: Column) -> Column:
        role_text = F.split(F.substring_index(p, END, 1), r"<\|text\|>", 2)
        return F.struct(unescape(role_text[0]).alias("role"), unescape(role_text[1]).alias("text"))

    return F.transform(parts, one)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's columns with conversation -7, whose texts hold markers of other templates."""
    spark = conversations.sparkSession
    kinds = dict(conversations.dtypes)
    rows = spark.range(2).select(F.lit(PROBE_ID).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def digest(ex: DataFrame) -> DataFrame:
    """What the examples hold, read back from them: one row per conversation. Whole
    conversations are read from their last example only, so no text is moved twice."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    # explode() keeps the rows of a conversation together, so this needs no second exchange
    got = ex.select("conv_id", "example", F.when(F.col("is_last"), F.col("formatted")).alias("whole"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("n"))
    got = got.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("n").alias("formatted_chars"))
    got = got.select("conv_id", read_back(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(examples(with_probe(table(spark, sf_dir, "conversations"))))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    22 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 1 AS f,
    role = 'assistant' AS a
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN a THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN a THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN a OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

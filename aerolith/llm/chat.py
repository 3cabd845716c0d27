"""Operator 7, chat formatting: prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable. A
conversation whose last turn is not an assistant's has one example more, with every turn and no trainable span, so that
no turn is lost.

An example is `<s>`, then for each turn `[INST]`, the role, `[/INST]`, the text and `</s>`. Roles and texts are escaped:
a backslash is doubled, and a backslash is put after the first character of any control string. A control string has
`<` or `[` at its start only and no backslash, so none is left whole and none can arise; dropping each backslash and
keeping what follows it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import common

#: The template's control strings, and others that models of this family know.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<(?=/?s>|unk>|pad>|\|)|\[(?=/?INST\]))"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example, target_turn, formatted, loss_start, loss_chars: a row for each example.

    example counts from 1 within a conversation in order of its targets. loss_start counts characters from 0; the
    trainable span is loss_chars long, and null and 0 where nothing is trainable. Turns are ordered by turn, role and
    text, nulls first; repeated rows stay as turns of their own. A null role or text is empty, a null turn comes first, rows
    of null conv_id are one conversation. Extra columns are not read. An empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t.role), F.lit(CLOSE))
    parts = whole.select("conv_id", "turns", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t.text).alias("text"))).alias("parts"))
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i).role == ASSISTANT)
    last = F.array(F.size("turns"))
    ends = parts.withColumn("ends", F.when(F.element_at("turns", -1).role == ASSISTANT, targets).otherwise(F.concat(targets, last)))
    each = ends.select("conv_id", "turns", "parts", F.posexplode("ends").alias("k", "end"))
    shown = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("end")), lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    target = F.element_at("turns", F.col("end"))
    made = each.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        F.when(target.role == ASSISTANT, target.turn).alias("target_turn"),
        F.concat(F.lit(BEGIN), shown).alias("formatted"),
        (target.role == ASSISTANT).alias("_trains"),
        F.length(F.element_at("parts", F.col("end"))["text"]).cast("long").alias("_chars"),
    )
    return made.select(
        "conv_id", "example", "target_turn", "formatted",
        F.when(F.col("_trains"), F.length("formatted") - F.col("_chars") - len(END)).alias("loss_start"),
        F.when(F.col("_trains"), F.col("_chars")).otherwise(F.lit(0)).alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    turns = F.filter(F.split(body, END, -1), lambda x: x.startswith(OPEN))
    return F.transform(
        turns,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substring(x, len(OPEN) + 1, 2**31 - 1), CLOSE, 1)).alias("role"),
            unescaped(F.substring(x, F.instr(x, CLOSE) + len(CLOSE), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """The contract's columns, read back from the examples that expand returned."""
    span = F.when(F.col("loss_start").isNotNull(), F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).otherwise("")
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.sort_array(F.collect_list(F.struct("example", unescaped(span).alias("text")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    read = per.select("conv_id", parsed(F.col("all")).alias("turns"), F.array_join("replies.text", "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its examples; a conversation's turns come together in one row, as its result is one."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{OPEN} ok {CLOSE}"
    extra = spark.range(1, 3).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    return digests(expand(turns.unionByName(extra)))


#: Plain strings and positions instead of the operator's expressions, so that the two do not share a mistake.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(role) + 17
      + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', ''))
      + len(regexp_extract_all(text, '</?s>|<unk>|<pad>|<\||\[/?INST\]'))
      + len(regexp_extract_all(role, '</?s>|<unk>|<pad>|<\||\[/?INST\]')) AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) + 3 AS upto FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

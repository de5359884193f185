"""Chat formatting (native): prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. Turns after the last reply (or a conversation without any) go to one more row, is_last with an empty
target, so that the output holds every turn.

A turn reads  <|im_start|>ROLE\\nTEXT<|im_end|>\\n.  Inside texts a backslash is doubled and "<|" becomes "<\\|",
so no control string can come from a text; roles are URL-encoded. Both are undone when the output is read.

Defined cases: null texts and roles are empty; a null conversation id is one conversation; rows are ordered by turn
(nulls first), then role and text, so repeated rows and tied turns have one order; an empty table gives no rows;
other columns are not read. One conversation is one row, as one document is: its prefixes are its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import let, materialize, read_table

# The turn marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINABLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def head(role: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and turns, an array of (turn, role, text) in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def examples(rows: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ...), n_turns, formatted, loss_start, loss_end (code points, end excluded), is_last.

    formatted[loss_start:loss_end] is the reply; the closing mark after it is not under the mask.
    """
    convs = conversations_of(rows)
    pieces = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == TRAINABLE).alias("own")))
    convs = convs.select("conv_id", pieces.alias("p"))
    whole = F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n")))
    replies = F.filter(F.transform("p", lambda x, i: F.when(x["own"], i)), lambda i: i.isNotNull())
    convs = convs.select("conv_id", "p", whole.alias("whole"), replies.alias("replies"), F.size("p").alias("n"))
    # The rest after the last reply is an example without a target.
    targets = F.when(F.coalesce(F.array_max("replies"), F.lit(-1)) == F.col("n") - 1, F.col("replies")).otherwise(F.concat("replies", F.array(F.col("n"))))
    each = convs.select("conv_id", "p", "whole", "n", F.posexplode(targets).alias("example", "i"))
    context = F.array_join(F.slice("whole", F.lit(1), F.col("i")), "")
    target = F.when(F.col("i") < F.col("n"), F.get("p", F.col("i")))
    each = each.select("conv_id", "example", F.least(F.col("i") + 1, F.col("n")).alias("n_turns"), context.alias("context"), target.alias("target"), (F.col("i") >= F.col("n") - 1).alias("is_last"))
    reply = F.concat(F.col("target.head"), F.col("target.body"), F.lit(END + "\n"))
    start = F.length("context") + F.coalesce(F.length("target.head"), F.lit(0))
    return each.select(
        "conv_id", "example", "n_turns",
        F.concat("context", F.coalesce(reply, F.lit(""))).alias("formatted"),
        start.alias("loss_start"),
        (start + F.coalesce(F.length("target.body"), F.lit(0))).alias("loss_end"),
        "is_last",
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.split(formatted, r"\Q" + END + r"\E\n", -1)
    turns = let(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        role = F.url_decode(F.substring(x, F.lit(len(START) + 1), cut - len(START) - 1))
        return F.struct(role.alias("role"), unescaped(F.substring(x, cut + 1, F.length(x))).alias("text"))

    return F.transform(turns, turn)


def digest(written: DataFrame) -> DataFrame:
    """Per conversation, from formatted examples alone: the turns, the text under the loss mask and the size."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = parsed(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = written.select(
        "conv_id", "example", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.col("n_turns").cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(text, 256)).alias("turns_sha256"),
    )
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    per = rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op5_chat_formatting(spark, sf_dir):
    probe = f"{END}{START}assistant ok"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return digest(materialize(examples(rows.unionByName(more)), "chat"))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (
  SELECT *, length('<|im_start|>' || role || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) AS chars,
         count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM c),
q AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM p)
SELECT conv_id, max(n) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM q GROUP BY conv_id
"""

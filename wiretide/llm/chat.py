"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A turn is OPEN role > text CLOSE, with role and text escaped.
OPEN, CLOSE = "<turn ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """Free of < and >, so that no text can hold a mark; reversible, as every backslash left starts an escape."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): one row for every assistant turn, with all turns before it as context
    and its own text as the only trainable span, from code point loss_start to before loss_end of formatted. example is the
    turn's place in its conversation, from 1. Turns after the last assistant turn make one more row, without a trainable span.

    Turns are ordered by turn, null first, then role, then text; repeated rows are turns of their own. A null role or text is
    empty. Rows with a null conv_id are one conversation. An empty table gives an empty one; other columns are not read.

    A conversation is gathered once, by the only shuffle; the expansion keeps its partitioning. A conversation must fit a
    task's memory as its last example holds all of it. Expansion writes each turn again for every later reply.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = whole.select(
        "conv_id", F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(">"), escape(t["text"]), F.lit(CLOSE))).alias("pieces"),
    )
    ends = F.filter(F.transform("replies", lambda r, i: F.when(r | (i == F.size("replies") - 1), i + 1)), lambda i: i.isNotNull())
    each = pieces.select("conv_id", "pieces", "replies", F.explode(ends).alias("example"))
    made = each.select(
        "conv_id", "example", F.element_at("replies", F.col("example")).alias("reply"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("example")), "").alias("formatted"),
        F.char_length(F.element_at("pieces", F.col("example"))).alias("last"),
    )
    end = F.char_length("formatted") - len(CLOSE)
    start = end - (F.col("last") - len(OPEN) - len(ASSISTANT) - 1 - len(CLOSE))
    return made.select("conv_id", "example", "formatted", F.when(F.col("reply"), start).alias("loss_start"), F.when(F.col("reply"), end).alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """The turns that a formatted text holds, as array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE)
    marked = F.slice(parts, F.lit(1), F.size(parts) - 1)
    at = lambda x: F.locate(">", x)
    return F.transform(marked, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), at(x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, at(x) + 1, F.char_length(x))).alias("text"),
    ))


def digests(made: DataFrame) -> DataFrame:
    """One row a conversation, read back from the output of examples()."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    one = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))), lambda s: s["text"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    back = one.select("conv_id", turns_of(F.col("longest")).alias("turns"), "loss", "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(examples(told.unionByName(more)))


ORACLE_OP4 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length(role || text) + length(regexp_replace(role || text, '[^\\\\<>]', '', 'g')) + {len(OPEN) + len(CLOSE) + 1} AS size FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS until FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(until) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text). Neighbours of one role are
merged into one block:

    <turn>ROLE<says>TEXT<also>TEXT</turn>\\n

with <also> between texts that were turns of their own. In roles and texts a backslash becomes \\b and < becomes
\\l, so that no marker can arise from a text and every turn can be read back. The loss mask holds the byte spans
of the assistant's texts.

Null text or role counts as empty; a null conv_id is a conversation of its own. Turns that share a number are
ordered by role, then text; repeated rows are repeated turns. An empty table gives no row. Extra columns are not read.
A conversation is one row, and so has to fit in a task; very long texts are not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
TURN, SAYS, ALSO, END = "<turn>", "<says>", "<also>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text and loss_mask, an array of (start, length) in bytes of it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("s"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get("s", i - 1), F.get("s", i + 1)
        new, last = ~before.role.eqNullSafe(x.role), ~after.role.eqNullSafe(x.role)
        lead = F.when(new, F.concat(F.lit(TURN), escape(x.role), F.lit(SAYS))).otherwise(F.lit(ALSO))
        return F.struct(lead.alias("lead"), escape(x.text).alias("said"), F.when(last, F.lit(END)).otherwise("").alias("end"), (x.role == "assistant").alias("loss"))

    t = t.select("conv_id", F.transform("s", piece).alias("p"))
    size = lambda c: F.octet_length(c).cast("long")
    t = t.withColumn("n", F.transform("p", lambda x: F.struct(size(x.lead).alias("a"), size(x.said).alias("b"), size(x.end).alias("c"), x.loss.alias("loss"))))
    # spans in two steps, within blocks of turns and then over the blocks, so that the work is not quadratic in turns
    spans = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("mask"))

    def span(acc: Column, x: Column) -> Column:
        here = F.array(F.struct((acc["at"] + x.a).alias("start"), x.b.alias("length")))
        return F.struct((acc["at"] + x.a + x.b + x.c).alias("at"), F.when(x.loss, F.concat(acc["mask"], here)).otherwise(acc["mask"]).alias("mask"))

    blocks = F.sequence(F.lit(0), F.floor((F.size("n") - 1) / BLOCK).cast("int"))
    t = t.withColumn("blocks", F.transform(blocks, lambda b: F.aggregate(F.slice("n", b * BLOCK + 1, BLOCK), start, span)))
    ends = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.at)))
    t = t.withColumn("ends", ends)
    moved = lambda x, i: F.transform(x["mask"], lambda s: F.struct((s["start"] + F.get("ends", i)).alias("start"), s["length"].alias("length")))
    return t.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x.lead, x.said, x.end)), "").alias("formatted"),
        F.flatten(F.transform("blocks", moved)).alias("loss_mask"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read back the turns (role, text) and the texts under the loss mask."""
    blocks = F.split("formatted", END, -1)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(TURN) + 1)), SAYS, -1)
        return F.transform(F.split(halves[1], ALSO, -1), lambda x: F.struct(unescape(halves[0]).alias("role"), unescape(x).alias("text")))

    raw = F.encode("formatted", "utf-8")
    masked = F.transform("loss_mask", lambda s: unescape(F.decode(F.substr(raw, (s.start + 1).cast("int"), s.length.cast("int")), "utf-8")))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_texts": masked})


def with_hostile(turns: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts look like markers. Turns of a -7 that the table has join it."""
    extra = turns.sparkSession.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def digests(turns: DataFrame) -> DataFrame:
    """op9: digests of what is read back from the formatted conversations."""
    out = parse(format_conversations(with_hostile(turns)))
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: SQL for the rows of digests().
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS fresh FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (
  SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l')) AS n_text,
         length(replace(replace(role, '\', '\b'), '<', '\l')) AS n_role FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + CASE WHEN fresh THEN n_role + 20 ELSE 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

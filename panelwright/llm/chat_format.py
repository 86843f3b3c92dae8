r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by (turn, role, text), and
adjacent turns of one role are merged into a block with array functions. A block is

    <|turn|>ROLE<|text|>TEXT<|part|>TEXT...<|end|>

with one part for each row, so that the rows can be read back. Inside roles and texts
the three characters that start control strings are escaped: backslash becomes ``\\``,
``<`` becomes ``\l`` and ``[`` becomes ``\b``; hence neither ``<|``, ``</s>`` nor
``[INST]`` can stand in a text, and unescaping gives back exactly what stood there.

The loss mask is the list ``segments`` of (text, loss): the texts joined are the
formatted conversation, and ``loss`` marks the parts of assistant turns.

Defined results
    null text: empty text; null role: an empty role, never under the loss mask;
    equal turn numbers: ordered by role, then text; repeated rows: each is a turn;
    null conv_id: one conversation of its own; very long texts: formatted whole; further
    columns, whatever their names, are left out; an empty table: no conversations.
A conversation is one output row, so its turns do meet in one task: the result itself,
one text and its digests, has that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, sha256

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
LOSS_ROLE = "assistant"
#: The conversation that carries control strings inside its texts.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: what stands between doubled backslashes is mapped back."""
    back = lambda s: F.replace(F.replace(s, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def with_probe(rows: DataFrame) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to ``conv_id, formatted, segments``."""
    turns, starts, blocks = f"{TMP}turns", f"{TMP}starts", f"{TMP}blocks"
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias(turns))
    first = lambda t, i: F.when((i == 0) | (F.get(F.col(turns), F.greatest(i - 1, F.lit(0)))["role"] != t["role"]), i)
    df = df.select("conv_id", turns, F.array_compact(F.transform(turns, first)).alias(starts))

    def block(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col(starts), k + F.lit(1)), F.size(turns))
        return F.struct(
            F.get(F.col(turns), at)["role"].alias("role"),
            F.transform(F.slice(F.col(turns), at + F.lit(1), end - at), lambda t: escape(t["text"])).alias("parts"),
        )

    df = df.select("conv_id", F.transform(starts, block).alias(blocks))

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT))
        parts = F.flatten(
            F.transform(
                b["parts"],
                lambda p, i: F.array(
                    F.struct(F.when(i == 0, head).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")),
                    F.struct(p.alias("text"), (b["role"] == LOSS_ROLE).alias("loss")),
                ),
            )
        )
        return F.concat(parts, F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))

    df = df.select("conv_id", F.flatten(F.transform(blocks, segments)).alias("segments"))
    return df.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text)."""

    def turns(block: Column) -> Column:
        halves = F.split(block, r"<\|text\|>", -1)
        role = unescape(F.get(halves, F.lit(0)))
        parts = F.split(F.replace(F.get(halves, F.lit(1)), F.lit(END), F.lit("")), r"<\|part\|>", -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split(formatted, r"<\|turn\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, from the formatted text and the mask alone."""
    back, lost = f"{TMP}back", f"{TMP}lost"
    df = formatted.select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias(back))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    df = df.select("conv_id", "formatted", back, masked.alias(lost))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return df.select(
        "conv_id",
        F.size(back).cast("bigint").alias("n_turns"),
        sha256(F.array_join(F.transform(back, line), "")).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        sha256(F.col(lost)).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *,
    coalesce(lag(role) over w = role, false) as joined,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) as text_chars,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) as role_chars
  from rows window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when joined then 8 else 8 + role_chars + 8 + 7 end)::bigint as formatted_chars
from marked group by conv_id
"""

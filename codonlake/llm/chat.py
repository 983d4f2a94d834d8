"""Chat formatting by event-sourced reconstruction; DataFrame operations only.

A log holds events (conv_id, seq, kind, msg_id, role, text). Kinds: `delta` appends to its message, `edit` replaces the
message's text, `regenerate` discards it so that later deltas write it anew, `delete` removes the message. Events are
dealt by conversation and message, put in the order of seq and folded into final messages; the messages of a
conversation, in the order of their first events, are rendered with a template, and the loss mask says which code
points of each turn's rendering are an assistant's text.

Template: <|turn|>role<|text|>text<|end|>. Inside roles and texts a backslash becomes two and `<|` becomes `<\\|`, so no
text can hold a mark, and what was escaped can be read back (see `parsed`).

At one seq an edit, regeneration or deletion comes before deltas; of several the last by name and text counts. A delta
after a deletion begins the message anew, as after a regeneration. seq may be of any type that can be ordered.

Defined results: null roles, texts and kinds count as empty, empty and `delta`; messages whose first events tie are
ordered by role and text; repeated rows are events of their own; a conversation whose messages are all deleted has no
row; an empty log gives an empty result; other columns are not read. A rendered conversation is one value and so
needs one task's memory; what is gathered before that, deltas and messages, is gathered by message first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """A single backslash stands only between `<` and `|`; all others come in pairs."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the final messages; pos is the seq of a message's first event."""
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = events.select("conv_id", "msg_id", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    turned = F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))
    grouped = rows.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("pos"),
        F.min(F.struct("seq", "role")).alias("one"),
        F.max(turned).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text")))).alias("deltas"),
    )
    after = F.filter("deltas", lambda d: F.col("last").isNull() | (d["seq"] >= F.col("last.seq")))
    base = F.when(F.col("last.kind") == "edit", F.col("last.text")).otherwise(F.lit(""))
    whole = F.concat(base, F.array_join(F.transform(after, lambda d: d["text"]), ""))
    gone = F.coalesce((F.col("last.kind") == "delete") & (F.size(after) == 0), F.lit(False))
    return grouped.filter(~gone).select("conv_id", "pos", F.col("one.role").alias("role"), whole.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, mask): mask has (turn, start, end), code points in that turn's rendering after its mark."""
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END)))
    masked = F.transform(
        "turns",
        lambda t, i: F.when(
            t["role"] == ASSISTANT,
            F.struct((i + 1).alias("turn"), (F.length(escaped(t["role"])) + len(TEXT)).alias("start"), (F.length(escaped(t["role"])) + len(TEXT) + F.length(escaped(t["text"]))).alias("end")),
        ),
    )
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("formatted"), F.filter(masked, lambda m: m.isNotNull()).alias("mask"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.element_at(pieces, m["turn"]), m["start"] + 1, m["end"] - m["start"]))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log whose fold is the conversations: each turn is a message of its own, by turn and conversation in one of four
    forms: streamed in two deltas; a draft that is discarded and streamed anew; a draft that an edit replaces; streamed,
    with a message beside it that is deleted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    form = F.pmod(F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4)) * 3 + F.pmod(F.coalesce(F.col("turn"), F.lit(0)), F.lit(4)), F.lit(4))
    none = F.lit(None).cast("string")

    def event(after: int, kind: str, words: Column, beside: bool = False) -> Column:
        return F.struct(F.struct(F.col("turn").alias("turn"), F.lit(after).alias("part")).alias("seq"), F.lit(kind).alias("kind"), F.lit(beside).alias("beside"), words.alias("text"))

    def streamed(after: int) -> list[Column]:
        return [event(after, "delta", F.substring(text, F.lit(1), half)), event(after + 1, "delta", F.substring(text, half + 1, F.length(text)))]

    draft = event(0, "delta", F.concat(F.lit("draft <|end|> "), text))
    parts = (
        F.when(form == 1, F.array(draft, event(1, "regenerate", none), *streamed(2)))
        .when(form == 2, F.array(draft, event(4, "edit", text)))
        .when(form == 3, F.array(*streamed(0), event(5, "delta", F.lit("never said"), True), event(6, "delete", none, True)))
        .otherwise(F.array(*streamed(0)))
    )
    rows = conversations.select("conv_id", F.monotonically_increasing_id().alias("own"), "role", parts.alias("parts")).select("conv_id", "own", "role", F.inline("parts"))
    return rows.select("conv_id", F.when(F.col("beside"), -F.col("own") - 1).otherwise(F.col("own")).alias("msg_id"), "seq", "kind", "role", "text")


def query(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"))
    out = rendered(folded(events_of(own.unionByName(extra))))
    back = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

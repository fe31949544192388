"""Preference formatting: one prompt for two conversations, and two masked completions.

A chosen and a rejected conversation share their first turns. The longest common prefix of
turns is rendered once as the prompt; what follows is rendered for each as a completion, in
pieces that say whether a loss applies to them: what the assistant wrote does, everything
else does not. Everything is DataFrame operations; each pair is gathered once, by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "struct<turn: bigint, role: string, text: string>"
_PIECE = "array<struct<text: string, train: boolean>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def _pieces(turns: Column) -> Column:
    """The head and the body of each turn; only an assistant's body is trained on."""
    each = F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("train")),
        F.struct(_body(t).alias("text"), (t["role"] == "assistant").alias("train"))))
    return F.flatten(each).cast(_PIECE)


def render(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def mask(pieces: Column) -> Column:
    """Lengths in code points of the pieces, each with 1 if it is trained on, else 0."""
    return F.array_join(F.transform(pieces, lambda p: F.concat(
        F.length(p["text"]).cast("string"), F.lit(":"), p["train"].cast("int").cast("string"))), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """Per pair of ``turns`` (pair_id, side, turn, role, text): prompt and completions.

    ``side`` is ``chosen`` or ``rejected``; rows of other sides or without pair_id take no
    part. Columns: pair_id, n_common (turns shared), prompt, chosen and rejected (pieces of
    text with a train flag). Turns are ordered by turn, role and text, nulls first, and are
    equal if role and text are; null roles and texts count as empty. A side without rows has
    no turns. Repeated rows are repeated turns. Other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    known = turns.filter("pair_id is not null and side in ('chosen', 'rejected')")

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, turn).cast(_TURN)))

    pairs = known.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda c, r: c["role"].eqNullSafe(r["role"])
                      & c["text"].eqNullSafe(r["text"]))
    differ = F.array_position(same, False).cast("int")
    # Where one side ends, the other's turn meets a null.
    common = F.when(differ == 0, F.size("c")).otherwise(differ - 1)
    pairs = pairs.withColumn("n_common", common)
    rest = {s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s), F.lit(0)))
            for s in ("c", "r")}
    return pairs.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"),
        render(_pieces(F.slice("c", F.lit(1), F.col("n_common")))).alias("prompt"),
        _pieces(rest["c"]).alias("chosen"), _pieces(rest["r"]).alias("rejected"))


def reply_preferences(conversations: DataFrame) -> DataFrame:
    """Sides of pairs made of conversations (conv_id, turn, role, text) alone.

    Conversation c is the chosen side of pair c. The rejected side has the turns before its
    last assistant turn, followed by the last assistant turn of conversation c + 1, if there
    are such turns.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    last = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"),
                         "turn", "role", "text")
    marked = rows.join(last, "conv_id")
    before = marked.filter("turn < last").select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    reply = marked.filter("turn = last and role = 'assistant'").select(
        (F.col("conv_id") - 1).alias("pair_id"), F.lit("rejected").alias("side"),
        F.lit(1 << 40).alias("turn"), "role", "text")
    reply = reply.join(rows.select(F.col("conv_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    return chosen.unionByName(before).unionByName(reply)

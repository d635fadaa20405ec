"""Preference pairs for training: one prompt, two masked completions.

A pair is a chosen and a rejected conversation.  Their longest common prefix
of turns (same role and text) is rendered once as the prompt; the turns after
it are each side's completion.  Only what the assistant says in a completion,
with its end mark, counts for the loss: its character spans are the mask.

Everything here is Spark column functions on one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.minhash import with_next

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array.

    Order is by turn (null first), then role and text; null roles and texts
    are empty; rows without a conv_id are left out.
    """
    t = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), t.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(ts: Column) -> Column:
    """Turns as text: start mark, role, line break, text, end mark, line break."""
    return F.array_join(F.transform(ts, lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def mask(ts: Column) -> Column:
    """Spans [start, end) in code points of the rendered turns that count for
    the loss: the text and end mark of each assistant turn."""
    head = len(START) + 1

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(ts, zero, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Format pairs: a row has pair_id, chosen and rejected (arrays of role and text).

    Returns pair_id, n_prefix (turns of the common prefix), prompt, and for
    each side its completion and mask.  A side that ends with the prefix has
    an empty completion and no mask; equal conversations have two empty
    completions; a null conversation counts as one without turns.  Repeated
    rows stay, other columns are left out, an empty table gives an empty result.
    """
    kind = "array<struct<role:string,text:string>>"
    side = {k: F.coalesce(F.col(k).cast(kind), F.array().cast(kind)) for k in ("chosen", "rejected")}
    rows = pairs.select("pair_id", *[v.alias(k) for k, v in side.items()])
    same = F.zip_with("chosen", "rejected", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    rows = rows.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size("chosen")))
    rest = {k: F.slice(F.col(k), F.col("n_prefix") + 1, F.greatest(F.size(k) - F.col("n_prefix"), F.lit(0)))
            for k in side}
    rows = rows.select("pair_id", "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("prefix"),
                       *[v.alias(k) for k, v in rest.items()])
    return rows.select("pair_id", "n_prefix", render(F.col("prefix")).alias("prompt"),
                       *[c for k in side for c in (render(F.col(k)).alias(k), mask(F.col(k)).alias(f"{k}_mask"))])


def crossed_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: each whole conversation is chosen; in
    the rejected one the assistant says from some turn on what it says in the
    next conversation (by conv_id; the first follows the last).

    Replies are numbered from 0, and those from number ``conv_id`` modulo
    their count on are replaced by the next conversation's of the same number,
    taken around if it has fewer.  All other turns stay, later ones included.
    Conversations without an assistant turn make no pair.
    """
    rows = turns(conversations).withColumn("places", F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()))
    rows = rows.where(F.size("places") > 0).withColumn("replies", F.transform("places", lambda i: F.get("turns", i)["text"]))
    near = with_next(rows, "conv_id", [], ["replies"])
    start = F.pmod("conv_id", F.size("replies"))

    def other(t: Column, i: Column) -> Column:
        number = F.array_position("places", i) - 1                  # -1: not the assistant's
        text = F.get("next_replies", F.pmod(number, F.size("next_replies")).cast("int"))
        return F.when(number >= start, F.struct(t["role"].alias("role"), text.alias("text"))).otherwise(t)

    return near.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.transform("turns", other).alias("rejected"))


def mask_text(spans: Column) -> Column:
    """Spans as start-end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

"""Chat formatting for preference data: a shared prompt and two completions, with the spans that are trained on.

Only DataFrame functions: conversations become arrays of turns, and the rest is higher-order functions on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.store import stored

#: What stands around a turn's text.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's (role, text) in the order of turn, role and text.

    A null role is "unknown" and a null text empty. Rows without a key are left out; repeated rows stay as turns.
    """
    rows = turns.filter(F.col(key).isNotNull()).select(F.col(key).alias(key), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("_turn"))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    return held.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns at the start are equal in role and text."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def render(turns: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) of the role's texts and their closing marks in render(turns), in code points from 0, end exclusive."""
    frame = len(OPEN) - len("{role}")
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + frame + F.length(t["role"])
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == role, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans")).cast(kind)

    return F.aggregate(turns, zero, step, lambda done: done["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", role: str = "assistant") -> DataFrame:
    """pairs, with its columns chosen and rejected (arrays of (role, text)) replaced by: n_prompt_turns, prompt, and
    chosen, rejected, chosen_spans, rejected_spans.

    The prompt is the longest common prefix of turns, rendered once; chosen and rejected are what follows in each, and
    their spans the parts to train on: the role's turns. Conversations that are equal give empty completions; a null
    conversation counts as one without turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    cut = pairs.select(*others, a.alias("_a"), b.alias("_b"), common_prefix(a, b).alias("n_prompt_turns"))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    out = cut.withColumns({"_prompt": F.slice("_a", F.lit(1), n), "_a": rest(F.col("_a")), "_b": rest(F.col("_b"))})
    return out.select(*others, "n_prompt_turns", render(F.col("_prompt")).alias("prompt"), render(F.col("_a")).alias("chosen"), render(F.col("_b")).alias("rejected"), trained_spans(F.col("_a"), role).alias("chosen_spans"), trained_spans(F.col("_b"), role).alias("rejected_spans"))


def following(keys: DataFrame, key: str) -> DataFrame:
    """(key, next): the least key above each one, null for the greatest. Keys may be sparse; keys has a column _range, by
    which its rows are dealt into ranges of keys, and each key once.

    Within a range by a window, and over its end by the ranges' least keys, of which there are as many as ranges.
    """
    starts = keys.groupBy("_range").agg(F.min(key).alias("_start")).agg(F.sort_array(F.collect_list("_start")).alias("_starts"))
    inside = keys.select(key, F.lead(key).over(Window.partitionBy("_range").orderBy(key)).alias("_inside"))
    beyond = F.array_min(F.filter("_starts", lambda x: x > F.col(key)))
    return inside.crossJoin(F.broadcast(starts)).select(key, F.coalesce("_inside", beyond).alias("next"))


def with_borrowed_replies(held: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """(key, chosen, rejected), a row for each conversation: all its turns, and the same turns with the text of the role's
    last one taken from the last such turn of the next conversation, in the order of the key, that has one.

    Where no later conversation has one, rejected ends before the turn, so that its completion is empty. Without a turn of
    the role both are all turns: all is prompt. Equi-joins on the key, which is unique on both sides.
    """
    is_role = lambda t: t["role"].eqNullSafe(F.lit(role))
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", is_role)), True) + 1
    ends = held.select(key, "turns", F.when(F.exists("turns", is_role), at.cast("int")).alias("_n"))
    replies = ends.filter(F.col("_n").isNotNull()).select(key, F.element_at("turns", F.col("_n")).alias("_reply"))
    ranged = stored(replies.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "replies")
    borrowed = following(ranged.select(key, "_range"), key).join(ranged.select(F.col(key).alias("next"), "_reply"), "next").select(key, "_reply")
    n = F.col("_n")
    before, after = F.slice("turns", F.lit(1), n - 1), F.slice("turns", n + 1, F.size("turns") - n)
    changed = F.when(n.isNull(), F.col("turns")).when(F.col("_reply").isNull(), before).otherwise(F.concat(before, F.array("_reply"), after))
    return ends.join(borrowed, key, "left").select(key, F.col("turns").alias("chosen"), changed.alias("rejected"))

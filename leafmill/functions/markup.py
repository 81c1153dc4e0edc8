"""Narration markup: [pause:seconds] and [voice:name] ... [/voice], as ordered events and as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.segment import sentences
from leafmill.functions.text import clean_text

TAG = r"\[(?:pause:[^\]]*|voice:[^\]]*|/voice)\]"
_EVENT = "struct<kind:string,value:string>"


def _pieces(text: Column) -> Column:
    """Texts and tags in their order, as (kind, value)."""
    texts, tags = F.split(text, TAG, -1), F.regexp_extract_all(text, F.lit(TAG), F.lit(0))

    def of(tag: Column) -> Column:
        kind = F.when(tag == "[/voice]", "close").when(tag.startswith("[voice:"), "open").otherwise("pause")
        return F.struct(kind.alias("kind"), F.trim(F.regexp_replace(tag, r"^\[(?:pause:|voice:|/voice)|\]$", "")).alias("value")).cast(_EVENT)

    plain = F.transform(texts, lambda t: F.struct(F.lit("text").alias("kind"), F.trim(t).alias("value")).cast(_EVENT))
    mixed = F.flatten(F.zip_with(plain, F.transform(tags, of), lambda a, b: F.array(a, b)))
    return F.filter(mixed, lambda e: e.isNotNull() & ~((e["kind"] == "text") & (e["value"] == "")))


def narration_events(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, kind, value, voice, problem): one row for each text or pause; problem is null for valid texts.

    A pause takes more than 0 and at most 30 seconds; voices have a name of at most 80 letters, are closed, and don't
    stand in one another. An invalid text gives one row, with its first problem.
    """
    done = F.struct(F.lit(None).cast("string").alias("voice"), F.lit(None).cast("string").alias("problem"), F.array().alias("events")).cast("struct<voice:string,problem:string,events:array<struct<kind:string,value:string,voice:string>>>")

    def step(d: Column, e: Column) -> Column:
        seconds = e["value"].try_cast("double")
        wrong = (
            F.when((e["kind"] == "pause") & seconds.isNull(), "pause is no number")
            .when((e["kind"] == "pause") & ~((seconds > 0) & (seconds <= 30)), "pause out of range")
            .when((e["kind"] == "open") & d["voice"].isNotNull(), "nested voice")
            .when((e["kind"] == "open") & ((e["value"] == "") | (F.length(e["value"]) > 80)), "voice without a name")
            .when((e["kind"] == "close") & d["voice"].isNull(), "voice closed twice")
            .when((e["kind"] == "text") & e["value"].rlike(r"\[/?(voice|pause)\b"), "malformed tag")
        )
        event = F.struct(e["kind"].alias("kind"), e["value"].alias("value"), F.when(e["kind"] == "text", d["voice"]).alias("voice"))
        return F.struct(
            F.when(e["kind"] == "open", e["value"]).when(e["kind"] != "close", d["voice"]).alias("voice"),
            F.coalesce(d["problem"], wrong).alias("problem"),
            F.when(e["kind"].isin("text", "pause"), F.concat(d["events"], F.array(event))).otherwise(d["events"]).alias("events"),
        )

    run = rows.select(key, F.aggregate(_pieces(F.coalesce(text, F.lit(""))), done, step).alias("d"))
    problem = F.coalesce("d.problem", F.when(F.col("d.voice").isNotNull(), "voice not closed"), F.when(F.size("d.events") == 0, "empty"))
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("kind", "value", "voice")]))
    out = run.select(key, problem.alias("problem"), F.posexplode(F.when(problem.isNull(), F.col("d.events")).otherwise(none)).alias("position", "e"))
    return out.select(key, "position", "e.kind", "e.value", "e.voice", "problem")


def sentence_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, text): sentences of each event, those of a voice with its tags around them again."""
    events = narration_events(rows, key, text).filter("problem is null")
    tagged = F.when(F.col("kind") == "pause", F.array(F.concat(F.lit("[pause:"), F.col("value"), F.lit("]")))).otherwise(
        F.transform(sentences(clean_text(F.col("value"), compose=False)), lambda s: F.when(F.col("voice").isNotNull(), F.concat(F.lit("[voice:"), F.col("voice"), F.lit("]"), s, F.lit("[/voice]"))).otherwise(s))
    )
    flat = events.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", tagged.alias("s")))), lambda x: x["s"])).alias("all"))
    return flat.select(key, F.posexplode("all").alias("position", "text"))

"""What can be drawn from passages word for word: summaries, names, keywords, quotations, repetitions, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import STOPWORDS, clean_name, content_terms, tokens
from leafmill.operators.filters import all_terms

_PLACE = ["section", "sentence"]

#: Runs of one to four capitalised words, small particles between them allowed.
NAME = r"\p{Lu}\p{Ll}+(?: (?:(?:de|del|la) )?\p{Lu}\p{Ll}+){0,3}"


def summaries(passages: DataFrame, key: str = "doc_id", most: int = 3, least_tokens: int = 5) -> DataFrame:
    """(key, section, sentence, text, score): the `most` central sentences of each section, in reading order.

    A term counts (1 + ln f) ln(1 + S / (1 + c)), with f its places in the sentence, S the section's sentences and c
    those that have the term; the sum goes by the root of the sentence's content terms. Of equal texts the first of
    the best counts; sentences of few tokens don't.
    """
    if not 1 <= most <= 5:
        raise ValueError("summaries have 1 to 5 sentences")
    # Sections are dealt once; sentences go along as rows without a term, so nothing is joined and passages are made once.
    words = tokens(F.col("text"))
    base = passages.select(key, *_PLACE, "text").repartition(key, "section")
    base = base.select(key, *_PLACE, F.when(F.size(words) >= least_tokens, F.col("text")).alias("text"), content_terms(words).alias("terms"))
    sentence = F.array(F.struct(F.lit(None).cast("string").alias("term"), "text"))
    rows = base.select(key, *_PLACE, F.inline(F.concat(sentence, F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(None).cast("string").alias("text"))))))
    freq = rows.groupBy(key, *_PLACE, "term", "text").agg(F.count(F.lit(1)).alias("f")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(key, "section", "term")))
    freq = freq.withColumn("S", F.count(F.when(F.col("term").isNull(), 1)).over(Window.partitionBy(key, "section")))
    of_terms = lambda x: F.when(F.col("term").isNotNull(), x)
    part = (1 + F.log("f")) * F.log(1 + F.col("S") / (1 + F.col("c")))
    sums = freq.groupBy(key, *_PLACE).agg(F.sum(of_terms(part)).alias("sum"), F.sum(of_terms(F.col("f"))).alias("n"), F.max("text").alias("text"))
    scored = sums.filter(F.col("text").isNotNull()).withColumn("score", F.round(F.coalesce(F.col("sum") / F.sqrt(F.greatest(F.col("n"), F.lit(1))), F.lit(0.0)), 6))
    same = F.row_number().over(Window.partitionBy(key, "section", "text").orderBy(F.desc("score"), "sentence"))
    best = F.row_number().over(Window.partitionBy(key, "section").orderBy(F.desc("score"), "sentence"))
    return scored.withColumn("_same", same).filter("_same = 1").withColumn("_rank", best).filter(F.col("_rank") <= most).select(key, *_PLACE, "text", "score")


def _packed(rows: DataFrame, most: int, key: str) -> DataFrame:
    """(key, term, count, sections, passages) of rows (key, section, citation, term): the `most` frequent of each document."""
    sections = rows.groupBy(key, "term", "section").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("citation")), 1, 30).alias("cited"))
    sums = sections.groupBy(key, "term").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "n")))).alias("sections"), F.slice(F.sort_array(F.flatten(F.collect_list("cited"))), 1, 30).alias("passages"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "term"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= most)


def entities(passages: DataFrame, key: str = "doc_id", most: int = 100) -> DataFrame:
    """(key, term, count, sections, passages, rank): names, by the number of passages that have them; 30 are cited."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    rows = passages.select(key, "section", "citation", F.explode(found).alias("term")).filter(~F.lower("term").isin(*STOPWORDS) & (F.length("term") > 2))
    return _packed(rows, most, key)


def keywords(passages: DataFrame, key: str = "doc_id", most: int = 100) -> DataFrame:
    """As entities, for content terms of more than three letters."""
    rows = passages.select(key, "section", "citation", F.explode(F.array_distinct(content_terms(tokens(F.col("text")), least=4))).alias("term"))
    return _packed(rows, most, key)


def quotes(passages: DataFrame, key: str = "doc_id", wanted: list[str] | None = None, most: int = 50) -> DataFrame:
    """(key, section, sentence, citation, quote, n): quotations, and sentences led by a dash, with all wanted tokens; the
    first `most` of each document."""
    found = F.regexp_extract_all("text", F.lit("“[^”]+”|«[^»]+»|\"[^\"\\n]+\""), F.lit(0))
    led = F.when(F.col("text").rlike("^[—–]"), F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = passages.select(key, *_PLACE, "citation", F.posexplode(F.concat(found, led)).alias("_at", "quote"))
    if wanted:
        rows = rows.filter(all_terms(tokens(F.col("quote")), wanted))
    order = F.row_number().over(Window.partitionBy(key).orderBy(*_PLACE, "_at"))
    return rows.withColumn("n", order).filter(F.col("n") <= most).drop("_at")


def repetitions(passages: DataFrame, key: str | None = "doc_id", least: int = 8, most: int = 50) -> DataFrame:
    """(key, tokens, count, first, passages, rank): sentences of `least` tokens or more that occur again with the same tokens.

    Within documents, or over all of them for a key of None. Counts are partly made before the shuffle, and of the places
    only the first 30 of each part travel on.
    """
    text = F.array_join(tokens(F.col("text")), " ")
    rows = passages.withColumn("tokens", text).filter(F.size(F.split("tokens", " ")) >= least)
    group = [key] if key else []
    part = F.pmod(F.xxhash64("doc_id", *_PLACE), F.lit(64))
    place = F.struct("doc_id", *_PLACE)
    parts = rows.withColumn("_part", part).groupBy(*group, "tokens", "_part").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(place)), 1, 30).alias("places"))
    sums = parts.groupBy(*group, "tokens").agg(F.sum("n").alias("count"), F.slice(F.sort_array(F.flatten(F.collect_list("places"))), 1, 30).alias("passages")).filter(F.col("count") > 1)
    if not key:
        return sums.withColumn("first", F.col("passages")[0]).orderBy(F.desc("count"), "tokens").limit(most)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "tokens"))
    return sums.withColumns({"first": F.col("passages")[0], "rank": rank}).filter(F.col("rank") <= most)


# Verbs of speech.
VERBS = "said|asked|replied|whispered|shouted|dijo|preguntó|respondió|susurró|gritó"
_PERSON = r"\p{Lu}\p{Ll}+(?:[- ]\p{Lu}\p{Ll}+)?"


def is_dialogue(text: Column) -> Column:
    return text.rlike("[“”«»\"]|^[—–]")


def speaker(text: Column) -> Column:
    """Who speaks: Narrator outside dialogue; else the name after a verb of speech, else the one before it, else Dialogue."""
    after = F.nullif(F.regexp_extract(text, rf"(?:^|[^\p{{L}}\p{{N}}])(?:{VERBS})\s+({_PERSON})", 1), F.lit(""))
    before = F.nullif(F.regexp_extract(text, rf"(?:^|[^\p{{L}}\p{{N}}])({_PERSON})\s+(?:{VERBS})(?:$|[^\p{{L}}\p{{N}}])", 1), F.lit(""))
    return F.when(~is_dialogue(text), "Narrator").otherwise(F.coalesce(after, before, F.lit("Dialogue")))


def dialogue_speakers(passages: DataFrame, text: str = "text") -> DataFrame:
    """passages with speaker, and character: the speaker where it is a name of somebody."""
    who = speaker(F.col(text))
    return passages.withColumn("speaker", who).withColumn("character", F.when(~F.col("speaker").isin("Narrator", "Dialogue"), clean_name(F.col("speaker"))))


def character_counts(rows: DataFrame, group: str, name: Column, place: list[str], most: int = 80) -> DataFrame:
    """(group, name, count, first): the `most` frequent names of each group, with their first place."""
    named = rows.withColumn("name", clean_name(name)).filter("name is not null")
    sums = named.groupBy(group, "name").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*place)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), "name"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= most)

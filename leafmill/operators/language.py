"""Detecting the language of documents by counting function words, with the evidence beside the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common function words by language.
MARKERS = {
    "en": "the and of to in was were with she he they his her their had have has from this that which who would could should been when then there them we you your our into through said but an for on not it is are as at its".split(),
    "es": "el la los las de del al que por para con una unos unas su sus se le les ella ellos ellas él en y es son era eran fue fueron había habían como cuando donde desde hacia entre estaba estaban este esta estos estas dijo pero sin un lo allí también muy más".split(),
    "fr": "le la les des du de et en un une est que qui dans pour pas par sur avec au aux ce cette il elle ils elles nous vous ne se sont était leur mais ou où".split(),
    "de": "der die das und in den dem des ein eine einen einem zu von mit ist sich nicht auf für als auch es an werden aus er hat dass sie nach wird bei war wie im".split(),
}


def even_sample(parts: DataFrame, key: str, position: str, most: int = 24) -> DataFrame:
    """At most `most` rows of each key, evenly spaced from the first to the last, by round half even of i (n - 1) / (most - 1)."""
    order = Window.partitionBy(key).orderBy(position)
    ranked = parts.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (most - 1)).cast("int"))
    return ranked.filter((F.col("_n") <= most) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def sample_text(text: Column, whole: int = 6_000, part: int = 2_000) -> Column:
    """A long text's head, middle and tail."""
    n = F.length(text)
    middle = (F.floor(n / 2) - part // 2 + 1).cast("int")
    return F.when(n <= whole, text).otherwise(F.concat_ws(" ", F.substring(text, 1, part), text.substr(middle, F.lit(part)), text.substr(n - part + 1, F.lit(part))))


def language_scores(parts: DataFrame, key: str = "doc_id", position: str = "line_no", text: str = "line", markers: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, language, score): how often a part has each marker word, at most 20 times, summed over words and parts.

    Words are counted where they stand, in arrays, and only markers become rows.
    """
    markers = markers or MARKERS
    spark = parts.sparkSession
    table = spark.createDataFrame([(w, lang) for lang, words in markers.items() for w in sorted(set(words))], "word string, language string")
    known = F.array(*[F.lit(w) for w in sorted({w for words in markers.values() for w in words})])
    words = F.filter(F.regexp_extract_all(F.lower(sample_text(F.col(text))), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.array_contains(known, w))
    rows = parts.select(key, position, F.explode(words).alias("word")).groupBy(key, position, "word").agg(F.least(F.count(F.lit(1)), F.lit(20)).alias("n"))
    return rows.join(F.broadcast(table), "word").groupBy(key, "language").agg(F.sum("n").alias("score"))


def detect_language(scores: DataFrame, declared: DataFrame, key: str = "doc_id", override: str | None = None, fallback: str = "en", supported: tuple[str, ...] = tuple(MARKERS)) -> DataFrame:
    """(key, language, evidence, confidence, review, mismatch, score, total) for each row of declared (key, declared).

    Strong evidence has a score of 3 or more, a share of 0.7 and a lead of 2; else what is declared counts, else the
    fallback. Declared languages that aren't supported give a null language. An override decides alone.
    """
    best = F.max(F.struct("score", F.col("language").alias("winner"))).alias("best")
    totals = scores.groupBy(key).agg(best, F.sum("score").alias("total"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))
    joined = declared.join(totals, key, "left")
    score, total = F.coalesce("best.score", F.lit(0)), F.coalesce("total", F.lit(0))
    second = F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0))
    share = F.when(total > 0, score / total).otherwise(0.0)
    strong = (score >= 3) & (share >= 0.7) & (score - second >= 2)
    tag = F.split(F.translate(F.lower(F.trim(F.coalesce("declared", F.lit("")))), "_", "-"), "-")[0]
    if override is not None:
        if override not in supported:
            raise ValueError(f"{override} isn't supported")
        language, evidence, confidence, review, mismatch = F.lit(override), F.lit("manual"), F.lit("high"), F.lit(False), F.lit(False)
    else:
        language = F.when((tag != "") & ~tag.isin(*supported), F.lit(None)).when(strong, F.col("best.winner")).when(tag != "", tag).otherwise(fallback)
        evidence = F.when(strong, "text").when(tag != "", "metadata").otherwise("fallback")
        confidence = F.when(strong & (score >= 8) & (share >= 0.8), "high").when(strong, "medium").otherwise("low")
        mismatch = F.coalesce(strong & (tag != "") & (F.col("best.winner") != tag), F.lit(False))
        review = ~strong | mismatch
    return joined.select(key, language.alias("language"), evidence.alias("evidence"), confidence.alias("confidence"), review.alias("review"), mismatch.alias("mismatch"), score.cast("long").alias("score"), total.cast("long").alias("total"))

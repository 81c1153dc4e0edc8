"""Conditions on passages by their tokens. All are columns, so they combine with &, | and ~."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import fold_all

KINDS = ("chapter", "front_matter", "back_matter", "unclassified")
MATCH_TYPES = ("phrase", "exact", "stem", "partial", "fuzzy")


def _words(words: Sequence[str] | Column) -> Column:
    return words if isinstance(words, Column) else F.array(*[F.lit(w) for w in words]).cast("array<string>")


def all_terms(tokens: Column, terms: Sequence[str] | Column) -> Column:
    return F.size(F.array_except(_words(terms), tokens)) == 0


def any_terms(tokens: Column, terms: Sequence[str] | Column) -> Column:
    return F.arrays_overlap(tokens, _words(terms))


def required_and_excluded(tokens: Column, required: Sequence[str] | Column, excluded: Sequence[str] | Column) -> Column:
    return all_terms(tokens, required) & ~any_terms(tokens, excluded)


def phrase(tokens: Column, words: Sequence[str] | Column) -> Column:
    """The words stand one after the other; stopwords count."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return F.contains(spaced(tokens), spaced(_words(words)))


def prefix(tokens: Column, start: str | Column) -> Column:
    """A token begins so; a start of one letter matches nothing."""
    start = F.lit(start) if isinstance(start, str) else start
    return (F.length(start) >= 2) & F.exists(tokens, lambda t: t.startswith(start))


def near(index: DataFrame, words: Sequence[str], distance: int = 10, key: str = "doc_id", column: str = "surface") -> DataFrame:
    """(key, section, sentence) of passages in which 2 to 8 words stand with at most `distance` tokens (20 at most)
    between the first and the last of them.

    For each occurrence of the first place, the nearest later occurrence of every other word decides, so the work is
    the occurrences of the words and not their combinations.
    """
    if not 2 <= len(words) <= 8:
        raise ValueError("near takes 2 to 8 words")
    distance, distinct = min(20, distance), list(dict.fromkeys(words))
    hits = index.filter((F.col("column") == column) & F.col("term").isin(*distinct)).select(key, "section", "sentence", "term", F.explode("positions").alias("at"))
    order = Window.partitionBy(key, "section", "sentence").orderBy("at", "term").rowsBetween(0, Window.unboundedFollowing)
    for i, w in enumerate(distinct):
        hits = hits.withColumn(f"_{i}", F.first(F.when(F.col("term") == w, F.col("at")), ignorenulls=True).over(order))
    places = [F.col(f"_{i}") for i in range(len(distinct))]
    complete = F.lit(True)
    for p in places:
        complete = complete & p.isNotNull()
    last = F.greatest(*places) if len(places) > 1 else places[0]
    return hits.filter(complete & (last - F.col("at") - 1 <= distance)).select(key, "section", "sentence").distinct()


def in_scope(passages: DataFrame, section: int | None = None, kind: str | None = None) -> DataFrame:
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind isn't one of {', '.join(KINDS)}")
    if section is not None and section < 0:
        raise ValueError("section is out of range")
    out = passages if section is None else passages.filter(F.col("section") == section)
    return out if kind is None else out.filter(F.col("kind") == kind)


def of_match_type(hits: DataFrame, match_type: str) -> DataFrame:
    if match_type not in MATCH_TYPES:
        raise ValueError(f"match_type isn't one of {', '.join(MATCH_TYPES)}")
    return hits.filter(F.col("match_type") == match_type)


def find_substring(passages: DataFrame, wanted: str, key: str = "doc_id", most: int = 5_000) -> DataFrame:
    """The first `most` passages of each document, in reading order, that hold the wanted letters; at least two are asked
    for."""
    if len(wanted.strip()) < 2:
        return passages.limit(0)
    found = passages.filter(F.contains(fold_all(F.col("text")), fold_all(F.lit(wanted.strip()))))
    place = F.row_number().over(Window.partitionBy(key).orderBy("section", "sentence"))
    return found.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def shelf_filter(books: DataFrame, wanted: str, *columns: str) -> DataFrame:
    """Books with the letters in any of the columns, whatever their case."""
    return books.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted.lower().strip())))


def owned_by(rows: DataFrame, owner: int | str, column: str = "user_id") -> DataFrame:
    """The owner's rows; those of others are as if they didn't exist."""
    return rows.filter(F.col(column) == owner)


def live(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return rows.filter(F.col(deleted).isNull())

"""Passages: one row for each sentence, with its section and its place in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.segment import sentences
from leafmill.functions.text import citation
from leafmill.sources.corpus import page_lines


def explode_passages(books: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, sentence, citation, text, title, source) from books with an array sections of (title, source,
    sentences)."""
    sections = books.select(key, F.posexplode("sections").alias("section", "s"))
    rows = sections.select(key, "section", "s.title", "s.source", F.posexplode("s.sentences").alias("sentence", "text"))
    return rows.select(key, "section", "sentence", citation(F.col("section"), F.col("sentence")).alias("citation"), "text", "title", "source")


def passages_of(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """Passages of plain documents: each line is a section, its sentences the passages; the title is the line's start.
    Sentences follow the rules of language, where docs have that column."""
    known = language in docs.columns
    lines = page_lines(docs, key, text, *[language] * known)
    cut = sentences(F.col("line"), F.col(language) if known else None)
    title = F.substring_index("line", " ", 4)  # made once a line, so the line doesn't go along with each sentence
    rows = lines.select(key, F.col("line_no").alias("section"), title.alias("title"), F.posexplode(cut).alias("sentence", "text"))
    return rows.select(key, "section", "sentence", citation(F.col("section"), F.col("sentence")).alias("citation"), "text", "title", F.concat(F.lit("line:"), F.col("section")).alias("source"))


def reading_order(key: str = "doc_id") -> Window:
    return Window.partitionBy(key).orderBy("section", "sentence")


def with_context(passages: DataFrame, key: str = "doc_id", span: int = 1, hit: bool = True, between: str = " ") -> DataFrame:
    """passages with context, context_start and context_end: the sentences up to `span` places away in the section,
    with the passage itself or without."""
    near = Window.partitionBy(key, "section").orderBy("sentence").rowsBetween(-span, span)
    rows = F.collect_list(F.struct("sentence", "text")).over(near)
    kept = rows if hit else F.filter(rows, lambda x: x["sentence"] != F.col("sentence"))
    return passages.withColumns({"context": F.array_join(F.transform(kept, lambda x: x["text"]), between), "context_start": F.min("sentence").over(near), "context_end": F.max("sentence").over(near)})


def offset_row(passages: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """passages with next_citation, n places on in reading order across sections (back for n below 0)."""
    return passages.withColumn("next_citation", F.lead("citation", n).over(reading_order(key)) if n >= 0 else F.lag("citation", -n).over(reading_order(key)))


def list_sentences(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    return passages.select(key, "citation", "text").orderBy(key, "citation")


def heading_sections(lines: DataFrame, is_heading: Column, key: str = "doc_id") -> DataFrame:
    """(key, section, title, start_line, n_lines): a section begins at each heading; lines before the first one are
    section 0 with the title "Page 1"."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("heading", F.coalesce(is_heading, F.lit(False))).withColumn("section", F.sum(F.col("heading").cast("int")).over(order))
    return marked.groupBy(key, "section").agg(F.coalesce(F.min(F.when(F.col("heading"), F.col("line"))), F.lit("Page 1")).alias("title"), F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("n_lines"))


# Words that lead a heading, numbers in words that may follow, and headings of their own.
LEADING = "chapter capítulo capitulo part parte".split()
NUMBERS = "one two three four five six seven eight nine ten uno dos tres cuatro cinco seis siete ocho nueve diez".split()
ALONE = ["prologue", "epilogue", "prólogo", "prologo", "epílogo", "epilogo", "preface", "introduction", "introducción", "biografía", "author biography"]
_ROMAN = "[IVXLCDM]+"
_NUMBERED = rf"(?:{'|'.join(LEADING)})\s+(?:{'|'.join([r'\d+', _ROMAN, *NUMBERS])})(?:[^\p{{L}}\p{{N}}].*)?"
#: Lines that are headings, in letters of any case, accented ones too.
HEADING = rf"(?iu)^(?:{'|'.join([_ROMAN + r'\.?', _NUMBERED, *ALONE])})$"


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 100) & line.rlike(HEADING)


def heading_by_typography(lines: DataFrame, key: str = "doc_id", ratio: float = 1.45, least_y: float = 40.0) -> DataFrame:
    """lines (key, line_no, line, y, height) with heading: short, without an end mark, and much higher than the upper
    median of the document's lines, or of a heading's wording."""
    heights = lines.filter("height > 0").groupBy(key).agg(upper_median(F.col("height")).alias("median_height"))
    tall = (F.length("line") <= 100) & ~F.col("line").rlike(r"[.!?,;:]$") & (F.col("height") >= ratio * F.col("median_height")) & (F.col("y") > least_y)
    return lines.join(heights, key, "left").withColumn("heading", F.coalesce(tall, F.lit(False)) | is_heading(F.col("line")))


def upper_median(value: Column) -> Column:
    """The larger of the two middle values for an even count."""
    return -F.percentile_approx(-value, 0.5, 1_000_000)


def outline_as_of(pages: DataFrame, outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages (key, page) with the title of the latest outline entry (key, page, title) that starts on the page or before.

    One sort of both together, no range join; of several entries of a page the least title counts.
    """
    starts = outline.groupBy(key, "page").agg(F.min("title").alias("start"))
    both = pages.select(key, "page", F.lit(None).cast("string").alias("start"), F.lit(1).alias("kind")).unionByName(starts.select(key, "page", "start", F.lit(0).alias("kind")))
    order = Window.partitionBy(key).orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("title", F.last("start", ignorenulls=True).over(order)).filter("kind = 1").select(key, "page", "title")

"""Running headers and footers: lines that many pages of a source begin or end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_lines(lines: DataFrame, book: str = "source", page: str = "doc_id", normal: Column | None = None, longest: int = 80) -> DataFrame:
    """(book, page, edge, line_no, margin): the first and the last line of pages of more than two lines, if not too long.

    margin is the line, or what `normal` makes of it.
    """
    margin = F.col("line") if normal is None else normal
    ends = lines.groupBy(book, page).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", margin.alias("margin"))).alias("top"), F.max(F.struct("line_no", margin.alias("margin"))).alias("bottom"))
    edges = F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"{e}.line_no").alias("line_no"), F.col(f"{e}.margin").alias("margin")) for e in ("top", "bottom")]))
    return ends.filter("n > 2").select(book, page, edges.alias("e")).select(book, page, "e.*").filter(F.length("margin") <= longest)


def repeated_margins(lines: DataFrame, book: str = "source", page: str = "doc_id", share: float = 0.6, least: int = 3, normal: Column | None = None) -> DataFrame:
    """(book, edge, margin, n): lines on the edge of `least` pages and of `share` of the book's pages, or more."""
    pages = lines.select(book, page).distinct().groupBy(book).agg(F.count(F.lit(1)).alias("pages"))
    counts = edge_lines(lines, book, page, normal).groupBy(book, "edge", "margin").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(pages, book).filter(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select(book, "edge", "margin", "n")


def strip_margins(lines: DataFrame, book: str = "source", page: str = "doc_id", share: float = 0.6, least: int = 3, normal: Column | None = None) -> DataFrame:
    """lines with removed: whether the line goes. Repeated lines do, but for a header's first page; so do page numbers
    that end a page, in books of three pages or more."""
    edges = edge_lines(lines, book, page, normal)
    held = repeated_margins(lines, book, page, share, least, normal)
    first = edges.groupBy(book, "edge", "margin").agg(F.min(page).alias("_first"))
    hits = edges.join(held.join(first, [book, "edge", "margin"]), [book, "edge", "margin"])
    gone = hits.filter((F.col("edge") == "bottom") | (F.col(page) > F.col("_first"))).select(book, page, "line_no", F.lit(True).alias("_gone")).distinct()
    pages = lines.groupBy(book).agg(F.countDistinct(page).alias("_pages"))
    last = Window.partitionBy(book, page)
    flagged = lines.join(gone, [book, page, "line_no"], "left").join(pages, book).withColumns({"_last": F.max("line_no").over(last), "_n": F.count(F.lit(1)).over(last)})
    number = (F.col("_pages") >= 3) & (F.col("_n") >= 2) & (F.col("line_no") == F.col("_last")) & F.col("line").rlike(r"(?i)^(?:page|página|pagina)?\s*[0-9]+$")
    return flagged.withColumn("removed", F.coalesce("_gone", F.lit(False)) | number).drop("_gone", "_pages", "_last", "_n")


def page_rollup(lines: DataFrame, page: str = "doc_id", least: int = 24) -> DataFrame:
    """(page, n_chars, n_lines, method, warning): a page of too few characters is to be recognised from its image."""
    n = F.coalesce(F.sum(F.length("line")), F.lit(0))
    return lines.groupBy(page).agg(n.alias("n_chars"), F.count(F.lit(1)).alias("n_lines"), F.when(n < least, "ocr").otherwise("native").alias("method"), F.when(n < least, "little text").alias("warning"))

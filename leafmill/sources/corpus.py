"""Reading and admitting documents, and writing what readers of the corpus need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import anchor, citation, clean_text

FORMATS = ("parquet", "json", "orc", "text", "csv")


def read_corpus(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, text: str = "text") -> DataFrame:
    """Documents that have a text. Malformed rows of text formats become nulls and fall out with the empty ones."""
    if form not in FORMATS:
        raise ValueError(f"{form} isn't one of {', '.join(FORMATS)}")
    reader = spark.read.format(form)
    if schema is not None:
        reader = reader.schema(schema)
    if form in ("json", "csv"):
        reader = reader.option("mode", "PERMISSIVE")
    docs = reader.load(path)
    if form == "text":
        docs = docs.withColumnRenamed("value", text)
    return docs.filter(F.length(F.trim(F.col(text))) > 0)


def page_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """(key, line_no, line): the lines of a text that have characters, clean and numbered from 0; and other columns."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: clean_text(x, compose=False)), lambda x: x != "")
    return docs.select(key, *others, F.posexplode(lines).alias("line_no", "line"))


def admission_checks(docs: DataFrame, text: str = "text", most_bytes: int = 20_000, least_chars: int = 1, most_lines: int = 200) -> DataFrame:
    """docs with reasons, an array that is empty for those to admit."""
    t = F.coalesce(F.col(text), F.lit(""))
    rules = (
        F.when(F.length(F.trim(t)) < least_chars, "empty"),
        F.when(F.octet_length(t) > most_bytes, "too large"),
        F.when(F.size(F.split(t, "\n")) > most_lines, "too many lines"),
        F.when(t.contains("�"), "broken encoding"),
    )
    return docs.withColumn("reasons", F.array_compact(F.array(*rules)))


def fingerprint(docs: DataFrame, text: str = "text", *settings: Column) -> DataFrame:
    """docs with sha256 of the text, and work_key, which also depends on settings such as language or parser version."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return docs.withColumns({"sha256": sha, "work_key": F.sha2(F.concat_ws("\u0001", sha, *[s.cast("string") for s in settings]), 256)})


def work_to_do(current: DataFrame, done: DataFrame, key: str = "work_key") -> DataFrame:
    """Rows whose key hasn't been worked on."""
    return current.join(done.select(key).distinct(), key, "left_anti")


def needs_ocr(docs: DataFrame, text: str = "text", least: int = 24) -> DataFrame:
    """docs with needs_ocr: whether the text has too few letters and digits to be one."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]", ""))
    return docs.withColumn("needs_ocr", n < least)


def citation_rows(passages: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, chapter, title, text, anchor) of each passage."""
    explicit = F.col("anchor") if "anchor" in passages.columns else F.lit(None).cast("string")
    return passages.select("doc_id", citation(F.col("section"), F.col("sentence")).alias("sentence_id"), F.col("section").alias("chapter"), "title", "text", anchor(explicit, F.col("source"), F.col("sentence")).alias("anchor"))


def citation_bundle(passages: DataFrame) -> DataFrame:
    """(doc_id, sections): for each document a JSON array of its sections, each with its citations in order."""
    rows = citation_rows(passages)
    sections = rows.groupBy("doc_id", "chapter").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("sentence_id", "text", "anchor"))).alias("sentences"))
    return sections.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("chapter", "title", "sentences")))).alias("sections"))


def export_library(passages: DataFrame, path: str | None = None, version: int = 1) -> DataFrame:
    """One row (id, version, sections) for each document; written as JSON lines where a path is given."""
    sections = passages.groupBy("doc_id", "section").agg(F.first("title").alias("title"), F.transform(F.sort_array(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]).alias("sentences"))
    books = sections.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.lit(version).alias("version"), F.transform(F.sort_array(F.collect_list(F.struct("section", "title", "sentences"))), lambda x: F.struct(x["title"].alias("title"), x["sentences"].alias("sentences"))).alias("sections"))
    if path:
        books.write.mode("overwrite").json(path)
    return books


EXPORTED = "id string, version int, language string, sections array<struct<title:string,sentences:array<string>>>"


def import_library(books: DataFrame, languages: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """books (of the schema EXPORTED) with errors and a fresh_id. Rows with errors are for quarantine; if any has some,
    nothing should be written."""
    rules = (
        F.when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), "bad id"),
        F.when(F.col("version") != 1, "unknown version"),
        F.when(~F.coalesce(F.col("language"), F.lit("en")).isin(*languages), "unknown language"),
        F.when(F.coalesce(F.size("sections"), F.lit(0)) == 0, "no sections"),
        F.when(~F.coalesce(F.forall("sections", lambda s: s["title"].isNotNull()), F.lit(True)), "section without a title"),
        F.when(~F.coalesce(F.forall("sections", lambda s: s["sentences"].isNotNull() & F.forall(s["sentences"], lambda t: t.isNotNull())), F.lit(True)), "sentence that is no text"),
    )
    copies = F.count(F.lit(1)).over(Window.partitionBy("id"))
    errors = F.array_compact(F.array(*rules, F.when((copies > 1) & F.col("id").isNotNull(), "repeated id")))
    return books.withColumns({"errors": errors, "fresh_id": F.expr("uuid()")})

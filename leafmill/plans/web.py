"""Registered queries: web pages, markup, layout, and streams that run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.markup import narration_events as events_of
from leafmill.functions.markup import sentence_rows as rows_of
from leafmill.operators import passages as pg
from leafmill.operators.vectors import embed_by_hashing
from leafmill.plans.common import LINES, PASSAGES, clean, files_of, lines, scratch, table
from leafmill.plans.library import ORACLE_SQL as LIBRARY_SQL
from leafmill.plans.search import ORACLE_SQL as SEARCH_SQL
from leafmill.sources import html
from leafmill.sources.layout import layout_lines as lines_of
from leafmill.streaming import jobs
from leafmill.streaming.incremental import IncrementalIndex


def html_blocks(spark, d):
    return html.html_blocks(table(spark, d, "pages"))


def html_blocks_plain(spark, d):
    return html.html_blocks_plain(table(spark, d, "pages")).select("page_id", F.col("block_no").cast("long").alias("block_no"), "tag", "text")


def html_sections(spark, d):
    return html.html_sections(html.html_blocks_plain(table(spark, d, "pages"))).select("page_id", F.col("section").cast("long").alias("section"), "title", "evidence", "n_blocks", "text")


def html_links(spark, d):
    return html.html_links(table(spark, d, "pages")).select("page_id", F.col("link_no").cast("long").alias("link_no"), "href", "label", "path", "ok")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Turns with markup: some with a pause, some with a voice, some with a voice that isn't closed."""
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.col("turn").alias("n"), "role")
    text = F.when(F.col("n") % 4 == 1, F.concat("text", F.lit(" [pause:"), F.col("n"), F.lit("]"))).when(F.col("n") % 4 == 2, F.concat(F.lit("[voice:"), "role", F.lit("]"), "text", F.lit("[/voice] end"))).when(F.col("n") % 4 == 3, F.concat(F.lit("[voice:"), "role", F.lit("]"), "text")).otherwise(F.col("text"))
    return rows.select("id", text.alias("text"))


def narration_events(spark, d):
    return events_of(_marked(spark, d), "id", "text").select("id", F.col("position").cast("long").alias("position"), "kind", "value", "voice", "problem")


def markup_sentences(spark, d):
    return rows_of(_marked(spark, d), "id", "text")


def layout_lines(spark, d):
    """All words of the documents' lines, twenty lines a page: y falls from line to line and x grows from word to word.

    Lines are dealt by page before they become words, so that words aren't shuffled.
    """
    rows = lines(spark, d).select("doc_id", (F.floor(F.col("line_no") / 20) + 1).cast("int").alias("page"), (F.col("line_no") % 20).alias("n"), "line")
    words = rows.repartition("doc_id", "page").select("doc_id", "page", "n", F.posexplode(F.split("line", " ")).alias("i", "text"))
    items = words.select("doc_id", "page", (F.col("i") * 10.0).alias("x"), (700.0 - 12 * F.col("n") + F.col("i") % 3).alias("y"), (10.0 + F.col("n") % 2).alias("h"), "text")
    return lines_of(items).select("doc_id", "page", "line_no", "line", "height")


def typographic_headings(spark, d):
    """Short lines are set large."""
    rows = lines(spark, d).withColumns({"height": F.when(F.length("line") < 12, 18.0).otherwise(10.0), "y": F.lit(100.0)})
    return pg.heading_by_typography(rows).select("doc_id", "line_no", "heading")


# ---- streams: each reads the table's folder as a stream, in the shared folder of spark.checkpoint.dir


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's file or folder as a stream of files."""
    rows = table(spark, d, name)
    return jobs.new_files(spark, f"{d}/{name}.parquet*", rows.schema)


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("micros", F.unix_micros("ts"))


_FOLLOWED: dict[tuple, IncrementalIndex] = {}


def _followed(spark: SparkSession, d: str) -> IncrementalIndex:
    """An index that has followed the documents through three drops, a stream of files. The first has two documents of three,
    one of them without its last line; the second the third one, and one that hasn't changed; the last one all of them."""
    name = (spark.sparkContext.applicationId, d, files_of(spark, f"{d}/documents.parquet"))
    if name in _FOLLOWED:  # another query of the session has run the stream
        return _FOLLOWED[name]
    at = scratch(spark, "stream")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    part, parts = F.pmod("doc_id", F.lit(3)), F.split("text", "\n")
    cut = F.when((part == 1) & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "\n")).otherwise(F.col("text"))
    drops = docs.filter(part != 0).withColumn("text", cut), docs.filter(part != 1), docs
    index = IncrementalIndex(spark, f"{at}/index")
    for n, rows in enumerate(drops):
        rows.write.option("compression", "zstd").parquet(f"{at}/drops/{n}")
        stream = jobs.new_files(spark, f"{at}/drops/*", docs.schema, per_batch=1_000_000, clean="delete")
        jobs.drain(stream.writeStream.foreachBatch(index.update()), f"{at}/checkpoint")
    _FOLLOWED[name] = index
    return index


def incremental_index(spark, d):
    return _followed(spark, d).passages().select("doc_id", "section", "sentence", "citation", "text")


def incremental_postings(spark, d):
    return _followed(spark, d).postings().withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


def incremental_frequencies(spark, d):
    return _followed(spark, d).frequencies()


def incremental_statistics(spark, d):
    return _followed(spark, d).statistics().withColumn("mean_length", F.round("mean_length", 6))


def incremental_changes(spark, d):
    return _followed(spark, d).changes()


def position_upserts(spark, d):
    at = scratch(spark, "stream")
    table_ = jobs.BatchLog(spark, f"{at}/positions", "user_id long, event_type string, ts timestamp, event_id long, value double")
    jobs.drain(_timed(spark, d).drop("props", "micros").writeStream.foreachBatch(jobs.upsert_latest(table_, ["user_id", "event_type"], ["ts", "event_id"])), f"{at}/checkpoint")
    return jobs.latest(table_.read().drop("v"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def resumable_embedding(spark, d):
    """Vectors of all documents, of which those of the first half were there before."""
    at = scratch(spark, "stream")
    schema = "doc_id long, hash string, model string, embedding array<float>"
    table_ = jobs.BatchLog(spark, f"{at}/vectors", schema)
    docs = table(spark, d, "documents").select("doc_id", "text")
    step = jobs.add_vectors(table_, lambda rows: embed_by_hashing(rows, "doc_id"), ["doc_id", "hash", "model"])
    step(docs.filter("doc_id % 2 = 0"), 0)
    jobs.drain(_stream(spark, d, "documents").select("doc_id", "text").writeStream.foreachBatch(lambda rows, i: step(rows, i + 1)), f"{at}/checkpoint")
    return jobs.of_last_batch(table_.read(), "doc_id").select("doc_id", "hash", F.size("embedding").alias("dim"))


def ingest_queue(spark, d):
    """Each row once, however many batches the files come in, and deleted users' rows not at all."""
    at = scratch(spark, "stream")
    table_ = jobs.BatchLog(spark, f"{at}/rows", "event_id long, user_id long")
    deleted = lambda: table(spark, d, "events").filter("user_id % 7 = 0").select("user_id")
    jobs.drain(_stream(spark, d, "events").select("event_id", "user_id").writeStream.foreachBatch(jobs.drop_deleted(table_, deleted, "user_id")), f"{at}/checkpoint")
    return table_.read().drop("v")


def _to_table(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = scratch(spark, "stream")
    jobs.drain(stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out"), f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def streamed_dedupe(spark, d):
    """Events sent twice, applied once."""
    events = _timed(spark, d)
    return _to_table(spark, jobs.once_each(events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))), "event_id", "ts").select("event_id", "user_id"))


def streamed_undo(spark, d):
    """Deletes and their ends by state and timers. Those still open when the stream ends aren't decided yet."""
    jobs.use_state_store(spark)
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "restore")
    stream = _timed(spark, d).withColumn("kind", kind).filter("kind is not null").select("user_id", "event_id", "ts", "micros", "kind")
    return _to_table(spark, jobs.undoable_deletes(stream, seconds=3600))


def streamed_limits(spark, d):
    jobs.use_state_store(spark)
    return _to_table(spark, jobs.rate_limited(_timed(spark, d).select("user_id", "event_id", "ts", "micros"), limit=1, seconds=3600))


def streamed_changes(spark, d):
    jobs.use_state_store(spark)
    return _to_table(spark, jobs.change_feed(_timed(spark, d).select("user_id", "event_id", "ts", "micros", F.col("event_type").alias("payload"))))


QUERIES = {f.__name__: f for f in (html_blocks, html_blocks_plain, html_sections, html_links, narration_events, markup_sentences, layout_lines, typographic_headings, incremental_index, incremental_postings, incremental_frequencies, incremental_statistics, incremental_changes, position_upserts, resumable_embedding, ingest_queue, streamed_dedupe, streamed_undo, streamed_limits, streamed_changes)}

_BODY = "html"
for _name in sorted(html.DROPPED):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_name}\\b[^>]*>.*?</{_name}\\s*>', '', 'g')"
_BLOCKS = rf"""raw AS (SELECT page_id, unnest(b) AS raw, generate_subscripts(b, 1) AS i FROM (SELECT page_id, regexp_extract_all({_BODY}, '(?is)<(?:h[1-4]|p|li|td|th)\b[^>]*>.*?</(?:h[1-4]|p|li|td|th)\s*>') AS b FROM pages)),
texts AS (SELECT page_id, i, lower(regexp_extract(raw, '^<(\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM raw),
blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_no, tag, text FROM texts WHERE text <> '')"""

_HEADING = pg.HEADING.replace("(?iu)", "(?i)").replace("'", "''")
#: When each user's first request passes, and then the first one later than the span after the last that passed.
_PASSED = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
following AS (SELECT a.user_id, a.r, min(b.r) AS n FROM e AS a JOIN e AS b ON b.user_id = a.user_id AND b.t - a.t > 3600000000 GROUP BY ALL),
passed AS (SELECT user_id, r FROM e WHERE r = 1 UNION ALL SELECT user_id, n FROM passed JOIN following USING (user_id, r))"""

ORACLE_SQL = {
    # one line of words for each input line: the words of a line are nearer than the gap, those of two lines are not
    "layout_lines": rf"WITH {LINES} SELECT doc_id, CAST(line_no // 20 + 1 AS INTEGER) AS page, CAST(line_no % 20 AS INTEGER) AS line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line, CAST(10 + line_no % 2 AS DOUBLE) AS height FROM lines",
    "typographic_headings": rf"""WITH {LINES}, h AS (SELECT *, CASE WHEN length(line) < 12 THEN 18.0 ELSE 10.0 END AS h FROM lines),
      m AS (SELECT doc_id, list_sort(list(h))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS m FROM h GROUP BY ALL)
      SELECT doc_id, line_no, length(line) <= 100 AND (NOT regexp_matches(line, '[.!?,;:]$') AND h >= 1.45 * m OR regexp_matches(line, '{_HEADING}')) AS heading FROM h JOIN m USING (doc_id)""",
    "streamed_limits": f"WITH RECURSIVE {_PASSED} SELECT user_id, event_id, passed.r IS NULL AS limited FROM e LEFT JOIN passed USING (user_id, r)",
    # a delete is final once a later event of its user, or the watermark, is past its time
    "streamed_undo": f"""WITH all_ AS ({LIBRARY_SQL["undo_ttl"]}), e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('error', 'click')),
      ends AS (SELECT user_id, max(t) AS last FROM e GROUP BY ALL)
      SELECT user_id, event_id, outcome FROM all_ JOIN e USING (user_id, event_id) JOIN ends USING (user_id)
      WHERE outcome <> 'purged' OR last - t > 3600000000 OR t // 1000 + 3600001 <= (SELECT max(t) // 1000 FROM e) - 10000""",
    "html_blocks_plain": f"WITH {_BLOCKS} SELECT * FROM blocks",
    "html_sections": f"""WITH {_BLOCKS}, h AS (SELECT *, tag IN ('h1', 'h2', 'h3', 'h4') AS head, sum(CAST(tag IN ('h1', 'h2', 'h3', 'h4') AS INTEGER)) OVER (PARTITION BY page_id ORDER BY block_no) AS part FROM blocks),
      s AS (SELECT page_id, part, coalesce(min(CASE WHEN head THEN text END), 'Untitled') AS title, CASE WHEN bool_or(head) THEN 'heading' ELSE 'spine' END AS evidence, count(*) AS n_blocks, coalesce(string_agg(CASE WHEN NOT head THEN text END, ' ' ORDER BY block_no), '') AS text FROM h GROUP BY ALL)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS section, title, evidence, n_blocks, text FROM s""",
    "html_links": r"""WITH raw AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS link_no, CASE WHEN p = '' THEN '/' ELSE p END AS base FROM (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="[^"]*"[^>]*>.*?</a>') AS l FROM pages)),
      parts AS (SELECT page_id, link_no, base, regexp_extract(raw, '(?i)\bhref="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS label FROM raw),
      full_ AS (SELECT *, regexp_replace(href, '[?#].*$', '') AS r FROM parts),
      joined AS (SELECT *, url_decode(CASE WHEN r = '' THEN base WHEN starts_with(r, '/') THEN r ELSE regexp_replace(base, '[^/]*$', '') || r END) AS f, NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(href, '//') AS ok FROM full_)
      SELECT page_id, link_no, href, label, CASE WHEN ok THEN '/' || array_to_string(list_filter(string_split(f, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path, ok FROM joined""",
    "incremental_index": f"WITH {PASSAGES} SELECT doc_id, section, sentence, citation, text FROM passages",
    "incremental_postings": SEARCH_SQL["postings"],
    "incremental_frequencies": SEARCH_SQL["document_frequencies"],
    "incremental_statistics": SEARCH_SQL["index_stats"],
    # a line is a section: the first drop lacks the passages of the last line of a document in three, the last one brings them
    "incremental_changes": f"""WITH {PASSAGES}, cut AS (SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10))[:-2], lambda l: {clean("l")}), lambda l: l <> '')) AS n FROM documents WHERE doc_id % 3 = 1 AND contains(text, chr(10))),
      p AS (SELECT doc_id % 3 AS part, doc_id, coalesce(section >= n, false) AS late, n IS NOT NULL AS cut FROM passages LEFT JOIN cut USING (doc_id)),
      rows_ AS (SELECT CASE WHEN part = 0 THEN 1 WHEN late THEN 2 ELSE 0 END AS batch, 'insert' AS change FROM p
        UNION ALL SELECT 2, 'unchanged' FROM p WHERE cut AND NOT late AND doc_id IN (SELECT doc_id FROM cut))
      SELECT batch, change, count(*) AS n FROM rows_ GROUP BY batch, change""",
    "position_upserts": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "resumable_embedding": "SELECT doc_id, sha256(text) AS hash, 64 AS dim FROM documents",
    "ingest_queue": "SELECT event_id, user_id FROM events WHERE user_id % 7 <> 0",
    "streamed_dedupe": "SELECT event_id, user_id FROM events",
    "streamed_changes": "SELECT user_id, event_id, event_type AS payload FROM events QUALIFY coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true)",
}

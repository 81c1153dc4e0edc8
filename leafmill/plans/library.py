"""Registered queries: structure, edits, the library, joins and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import clean_name as text_clean_name
from leafmill.functions.text import resolve_cascade, signature
from leafmill.operators import evaluate, library, series, structure
from leafmill.operators.index import index_diff as diff_index
from leafmill.operators.index import index_status as status_of
from leafmill.operators.index import with_hash
from leafmill.operators.passages import upper_median
from leafmill.plans.common import LINES, PASSAGES, lines, passages, table

# ---- structure: documents lack headings, so each line becomes a section whose title depends on its place and size

_TITLE = """CASE WHEN line_no = 0 AND doc_id % 3 = 0 THEN 'Preface' WHEN line_no = 1 AND doc_id % 5 = 0 THEN 'Parte ' || (1 + doc_id % 4)
  WHEN n_chars % 7 = 0 THEN 'Índice' WHEN n_chars % 7 = 1 THEN 'Epílogo' WHEN n_chars % 7 = 2 THEN 'Chapter ' || line_no WHEN n_chars % 7 = 3 THEN CAST(line_no AS STRING) || '. ' || first_word
  WHEN n_chars % 7 = 4 THEN 'IV.' ELSE first_word END"""
_EVIDENCE = "CASE n_chars % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'outline' WHEN 2 THEN 'spine' ELSE 'table-of-contents' END"
_ROLE = "CASE WHEN n_chars % 11 = 0 THEN 'chapter' WHEN n_chars % 11 = 1 THEN 'back_matter' ELSE '' END"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("doc_id", "line_no", "line", F.length("line").alias("n_chars"), F.split("line", " ")[0].alias("first_word"))
    return rows.select("doc_id", F.col("line_no").alias("section"), F.expr(_TITLE).alias("title"), F.expr(_EVIDENCE).alias("evidence"), F.expr(_ROLE).alias("role"), F.concat(F.lit("page:"), F.col("line_no")).alias("source"), F.array("line").alias("sentences"))


def section_votes(spark, d):
    return structure.votes(_sections(spark, d)).select("doc_id", "section", "kind", "subkind", "level", "confidence", "score", "margin")


def section_flags(spark, d):
    out = structure.classify_by_votes(_sections(spark, d))
    return out.select("doc_id", "section", F.array_join("flags", ",").alias("flags"), "review")


def numbering_gap(spark, d):
    return structure.numbering_gaps(structure.votes(_sections(spark, d))).filter("number is not null").select("doc_id", "section", "number", "previous_number", "gap")


def section_cascade(spark, d):
    return structure.classify_by_cascade(_sections(spark, d)).select("doc_id", "section", "kind", "confidence", "basis", "reason", "review")


def duplicate_titles(spark, d):
    return structure.votes(_sections(spark, d)).filter("n_title > 1").select("doc_id", "section", F.col("n_title").alias("n"))


def start_section(spark, d):
    return structure.start_section(structure.votes(_sections(spark, d)))


def review_rollup(spark, d):
    return structure.review_rollup(structure.classify_by_votes(_sections(spark, d))).select("doc_id", "n_sections", "review_count", "needs_review", F.size("all_flags").cast("long").alias("n_flags"))


def section_edits(spark, d):
    """The second section of each document is retitled and made a chapter, then all are classified."""
    edits = table(spark, d, "documents").select("doc_id", F.lit(1).alias("section"), F.lit("Notas").alias("title"), F.lit("chapter").alias("kind"))
    return structure.classify_by_cascade(structure.apply_review(_sections(spark, d), edits)).filter("section = 1").select("doc_id", "title", "kind", "basis")


def split_remap(spark, d):
    rows = passages(spark, d)
    edits = table(spark, d, "documents").select("doc_id", F.lit(2).alias("at_section"), F.lit(1).alias("boundary"))
    return structure.remap(rows.select("doc_id", "section", "sentence", "text"), structure.split_mapping(rows, edits))


def merge_remap(spark, d):
    rows = passages(spark, d)
    edits = table(spark, d, "documents").select("doc_id", F.lit(0).alias("at_section"))
    return structure.remap(rows.select("doc_id", "section", "sentence", "text"), structure.merge_mapping(rows, edits))


def edit_sentences(spark, d):
    rows = passages(spark, d)
    edits = rows.filter("section = 0 and sentence = 0").select("doc_id", "section", "sentence", F.concat(F.lit("new\n"), "text").alias("new_text"))
    return structure.edit_sentences(rows, edits)


# ---- the library


def library_sort(spark, d):
    """All books by when they were opened last, of customers as authors and orders as books."""
    books = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Book "), F.col("o_custkey")).alias("title"), F.col("o_orderstatus").alias("author"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).cast("timestamp").alias("last_opened"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_totalprice").alias("progress"))
    return library.shelf_order(books, "opened").select("doc_id", "title")


def shelf_filter(spark, d):
    from leafmill.operators.filters import shelf_filter as on_shelf

    return on_shelf(table(spark, d, "customer"), "BUILD", "c_name", "c_mktsegment").select("c_custkey", "c_mktsegment")


def continue_reading(spark, d):
    events = table(spark, d, "events").filter("event_type = 'view'")
    return library.continue_reading(events, "user_id", "ts", "event_id").select("user_id", "event_id")


def latest_position(spark, d):
    return library.latest_by_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("user_id", "event_type", "event_id", "value")


def latest_job(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.col("o_orderkey").alias("n"), "o_orderkey", "o_orderstatus")
    return library.with_latest(customers, jobs, "c_custkey", ["o_orderdate", "n"], "o_orderstatus", "o_orderkey")


def extents(spark, d):
    return library.extents(passages(spark, d)).withColumn("n_words", F.col("n_words").cast("long"))


def usage_quota(spark, d):
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return library.usage(docs, "source", "path", F.col("size"), 100_000)


def progress(spark, d):
    sizes = passages(spark, d).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))
    positions = table(spark, d, "documents").select("doc_id", F.lit(3).alias("section"), F.lit(1).alias("sentence"), F.lit(1).alias("start"))
    return library.progress_percent(sizes, positions)


def readiness(spark, d):
    return library.readiness(table(spark, d, "lineitem"), F.col("l_returnflag") != "N", "l_orderkey").withColumn("ready", F.col("ready").cast("long"))


def contiguous_ready(spark, d):
    return library.contiguous_ready(table(spark, d, "lineitem"), F.col("l_quantity") > 10, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def ready_run(spark, d):
    return library.ready_run(passages(spark, d), F.length("text") % 5 > 0, "doc_id", ["section", "sentence"], 20).select("doc_id", "citation", "run")


def rotated_order(spark, d):
    return library.rotated_order(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.lit(3)).select("l_orderkey", "l_linenumber", F.col("turn").cast("long").alias("turn"))


def timeline_offsets(spark, d):
    return library.timeline(table(spark, d, "documents"), ["source"], ["doc_id"], F.col("n_chars"), F.floor(F.col("doc_id") / 4096)).select("doc_id", "start", "end")


def median_height(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(upper_median(F.col("l_quantity").cast("double")).alias("median"))


# ---- joins on what exists, and sets


def index_diff(spark, d):
    """The index of all but some documents against the present one, in which the texts of others changed."""
    now = passages(spark, d)
    old = now.filter("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return diff_index(with_hash(old), with_hash(now.filter("doc_id % 10 <> 5")), ["doc_id", "section", "sentence"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def index_status(spark, d):
    now = table(spark, d, "documents").select("doc_id", signature(F.col("text")).alias("fingerprint"))
    then = now.filter("doc_id % 10 <> 3").withColumn("fingerprint", F.when(F.col("doc_id") % 10 == 4, "x").otherwise(F.col("fingerprint")))
    return status_of(now, then)


def missing_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return library.missing_vectors(docs, table(spark, d, "embeddings"), "vec_id")


def stale_vectors(spark, d):
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return library.stale_rows(table(spark, d, "embeddings").select("vec_id", "label"), labelled, "vec_id")


def reusable_items(spark, d):
    rows = passages(spark, d).select("doc_id", "section", "sentence", signature(F.col("text")).alias("signature"))
    items = rows.withColumn("status", F.when(F.col("sentence") % 2 == 0, "complete").otherwise("failed"))
    wanted = rows.withColumn("signature", F.when(F.col("section") % 3 == 0, "changed").otherwise(F.col("signature")))
    return library.reusable(items, wanted, "doc_id", "section", "sentence").select("doc_id", "section", "sentence")


def shared_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source"))
    return library.shared_sources(docs, "doc_id", "source").select("doc_id", "shared")


def collectible(spark, d):
    parts = table(spark, d, "part").select("p_partkey")
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return library.collectible(parts, used, "p_partkey")


def manual_override(spark, d):
    inferred = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("quality"))
    return library.with_override(inferred, table(spark, d, "labels"), ["doc_id"], "quality")


def owner_rows(spark, d):
    from leafmill.operators.filters import live, owned_by

    rows = table(spark, d, "events").withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))
    return live(owned_by(rows, 8)).select("event_id", "event_type")


def toggled_marks(spark, d):
    return library.toggled(table(spark, d, "events").filter("event_type = 'click'"), "user_id", "value").select("user_id", "value", "toggles")


def cast_voices(spark, d):
    cast = F.create_map(F.lit("user"), F.lit("alto"), F.lit("system"), F.lit("bass"))
    return table(spark, d, "conversations").select("conv_id", "turn", resolve_cascade(F.col("role"), cast, F.lit("default")).alias("voice"))


def clean_names(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text_clean_name(F.concat(F.lit("— "), F.col("text"))).alias("name"))


# ---- series of events


def signal_stats(spark, d):
    return series.signal_stats(table(spark, d, "events"), "user_id", F.col("value") - 25)


def active_bounds(spark, d):
    return series.active_bounds(table(spark, d, "events"), "user_id", "event_id", F.col("value"), 60.0, 100)


def rolling_eta(spark, d):
    return series.rolling_eta(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value"), F.lit(12)).select("event_id", "rate")


def rate_limit(spark, d):
    return series.rate_limit(table(spark, d, "events"), "user_id", F.col("ts").cast("timestamp"), "event_id", 3, 4 * 3600)


def change_snapshots(spark, d):
    return series.change_snapshots(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


def undo_ttl(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "restore")
    return series.undo_outcomes(table(spark, d, "events"), "user_id", F.col("ts").cast("timestamp"), "event_id", kind, seconds=3600)


def late_updates(spark, d):
    events = table(spark, d, "events")
    return series.without_late(events.filter("event_type = 'view'"), events.filter("event_type = 'error'"), "user_id", "ts").select("event_id")


def dedupe_requests(spark, d):
    events = table(spark, d, "events")
    return series.deduplicated(events.unionByName(events.filter("event_id % 3 = 0")), "event_id", ["ts"]).select("event_id", "user_id")


def latency_percentiles(spark, d):
    return evaluate.latency_percentiles(table(spark, d, "events"), F.col("value"), "event_type")


def regression_check(spark, d):
    rows = evaluate.latency_percentiles(table(spark, d, "events"), F.col("value"), "event_type")
    now = rows.select(F.concat(F.lit("p50_"), "event_type").alias("metric"), F.col("p50").alias("value"))
    before = rows.select(F.concat(F.lit("p50_"), "event_type").alias("metric"), (F.col("p95") - 50).alias("value"))
    return evaluate.regressions(now, before)


QUERIES = {f.__name__: f for f in (section_votes, section_flags, numbering_gap, section_cascade, duplicate_titles, start_section, review_rollup, section_edits, split_remap, merge_remap, edit_sentences, library_sort, shelf_filter, continue_reading, latest_position, latest_job, extents, usage_quota, progress, readiness, contiguous_ready, ready_run, rotated_order, timeline_offsets, median_height, index_diff, index_status, missing_vectors, stale_vectors, reusable_items, shared_sources, collectible, manual_override, owner_rows, toggled_marks, cast_voices, clean_names, signal_stats, active_bounds, rolling_eta, rate_limit, change_snapshots, undo_ttl, late_updates, dedupe_requests, latency_percentiles, regression_check)}

_NUMERAL = r"regexp_extract(t, '^(?:(?:chapter|capitulo)\s+)?([0-9]+|[ivxlcdm]+)(?:[.]|$|\s)', 1)"
_LETTER = "CASE substring(x.s, i, 1) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END"
#: The value of a numeral in SQL: digits, or letters of which each counts against the next one if that is larger.
_VALUE = f"""CASE WHEN {_NUMERAL} = '' THEN NULL WHEN regexp_matches({_NUMERAL}, '^[0-9]') THEN TRY_CAST({_NUMERAL} AS INTEGER) ELSE
  CAST(list_sum(list_transform(range(1, length({_NUMERAL}) + 1), lambda i: CASE WHEN {_LETTER.replace("x.s", _NUMERAL)} < {_LETTER.replace("x.s", _NUMERAL).replace(", i, 1)", ", i + 1, 1)")} THEN -1 ELSE 1 END * {_LETTER.replace("x.s", _NUMERAL)})) AS INTEGER) END"""
_SECTIONS = f"""{LINES}, raw AS (SELECT doc_id, line_no, line, length(line) AS n_chars, string_split(line, ' ')[1] AS first_word FROM lines),
sections AS (SELECT doc_id, line_no AS section, line, {_TITLE.replace("STRING", "VARCHAR")} AS title, {_EVIDENCE} AS evidence, {_ROLE} AS role,
  len(string_split(line, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n_sections FROM raw),
folded AS (SELECT *, replace(strip_accents(replace(lower(title), 'ñ', chr(57344))), chr(57344), 'ñ') AS t FROM sections)"""
_E = r"($|[^\p{L}\p{N}_])"
_VOTES = rf"""{_SECTIONS},
words AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n_title, regexp_matches(t, '^(part|parte)\s+\S+') AS is_part,
  CASE WHEN regexp_matches(t, '^preface{_E}') THEN 'front_matter' WHEN regexp_matches(t, '^epilogo{_E}') THEN 'back_matter' WHEN regexp_matches(t, '^indice{_E}') THEN CASE WHEN place > n_sections * 0.75 THEN 'back_matter' ELSE 'front_matter' END END AS kw,
  CASE WHEN regexp_matches(t, '^preface{_E}') THEN 'preface' WHEN regexp_matches(t, '^epilogo{_E}') THEN 'epilogue' WHEN regexp_matches(t, '^indice{_E}') THEN CASE WHEN place > n_sections * 0.75 THEN 'index' ELSE 'toc' END END AS kwsub FROM folded),
sums AS (SELECT *, CASE kw WHEN 'front_matter' THEN 6 ELSE 0 END AS f, CASE kw WHEN 'back_matter' THEN 6 ELSE 0 END AS b,
  CASE WHEN evidence IN ('table-of-contents', 'outline') THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(t, '^(chapter|capitulo)\s+\S+') OR (evidence = 'heading' AND (regexp_matches(t, '^[ivxlcdm]+[.]?$') OR regexp_matches(t, '^[0-9]+[.)]\s+\S+'))) THEN 5 ELSE 0 END
  + CASE WHEN is_part THEN 3 ELSE 0 END AS c FROM words),
tops AS (SELECT *, greatest(f, b, c) AS top, list_sort([f, b, c], 'DESC')[2] AS second, CASE WHEN c >= f AND c >= b THEN 'chapter' WHEN f >= b THEN 'front_matter' ELSE 'back_matter' END AS winner FROM sums),
votes AS (SELECT *, CASE WHEN role <> '' THEN role WHEN top > second THEN winner ELSE 'unclassified' END AS kind,
  CASE WHEN role <> '' AND ((f > 0 AND role <> 'front_matter') OR (b > 0 AND role <> 'back_matter') OR (c > 0 AND role <> 'chapter')) THEN NULL WHEN is_part THEN 'part_divider' ELSE kwsub END AS subkind,
  CASE WHEN role <> '' THEN 'high' WHEN top = 0 OR top = second THEN 'low' WHEN top >= 6 AND top - second >= 3 THEN 'high' WHEN top >= 3 AND top - second >= 2 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN role <> '' THEN 'document' WHEN top > 0 AND kw IS NULL AND evidence IN ('table-of-contents', 'outline') THEN 'document' ELSE 'inferred' END AS confidence,
  CASE WHEN role <> '' THEN 100 ELSE top END AS score, CASE WHEN role <> '' THEN 100 ELSE top - second END AS margin FROM tops),
numbered AS (SELECT *, CASE WHEN kind = 'chapter' THEN {_VALUE} END AS number,
  sum(CAST(is_part AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY section) AS part_no FROM votes),
gaps AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id, part_no ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_number FROM numbered),
flagged AS (SELECT *, coalesce(number <> previous_number + 1, false) AS gap,
  concat_ws(',', CASE WHEN n_title > 1 THEN 'duplicate_title' END, CASE WHEN words < 20 THEN 'tiny_section' END, CASE WHEN words > 12000 THEN 'huge_section' END, CASE WHEN coalesce(number <> previous_number + 1, false) THEN 'numbering_gap' END, CASE WHEN regexp_matches(strip_accents(lower(line)), '\.{{3,}}\s*[0-9]+|(chapter|capitulo)\s+[0-9]+\s+[0-9]+') THEN 'toc_inside_body' END) AS flags FROM gaps),
reviewed AS (SELECT *, confidence = 'inferred' OR kind = 'unclassified' OR flags <> '' AS review FROM flagged)"""
_CASCADE = rf"""{_SECTIONS},
firsts AS (SELECT *, min(CASE WHEN regexp_matches(t, '^(chapter|capitulo)\s+(1|i|one|uno|primero){_E}') THEN place END) OVER (PARTITION BY doc_id) AS fc, count(*) OVER (PARTITION BY doc_id, t) AS n_title,
  CASE WHEN t IN ('preface', 'indice') THEN 'front_matter' WHEN t = 'epilogo' THEN 'back_matter' WHEN regexp_matches(t, '^(chapter|capitulo|part|parte)\s+\S+') THEN 'chapter' END AS word FROM folded),
cascade AS (SELECT *, CASE WHEN role <> '' THEN 1 WHEN evidence = 'outline' THEN 2 WHEN word IS NOT NULL THEN 3 WHEN evidence = 'heading' AND (regexp_matches(t, '^[0-9]+[.)]\s+\S+') OR regexp_matches(t, '^[ivxlcdm]+\.?$')) THEN 4 ELSE 5 END AS rule FROM firsts),
classified AS (SELECT doc_id, section, title, CASE rule WHEN 1 THEN role WHEN 2 THEN coalesce(word, 'chapter') WHEN 3 THEN word WHEN 4 THEN 'chapter' ELSE 'unclassified' END AS kind,
  CASE WHEN rule <= 2 THEN 'high' WHEN rule <= 4 THEN 'medium' ELSE 'low' END AS confidence, CASE rule WHEN 1 THEN 'document role' WHEN 2 THEN evidence WHEN 3 THEN 'title keyword' WHEN 4 THEN 'heading' ELSE 'page:' || section END AS basis,
  CASE rule WHEN 1 THEN 'document_role' WHEN 2 THEN CASE WHEN word IS NULL THEN 'navigation_boundary' ELSE 'navigation_with_title' END WHEN 3 THEN 'title_keyword' WHEN 4 THEN 'explicit_heading' ELSE CASE WHEN fc > 0 AND place < fc AND evidence = 'spine' THEN 'before_first_chapter' ELSE 'unknown_boundary' END END AS reason,
  n_title, words FROM cascade)"""

ORACLE_SQL = {
    "section_votes": f"WITH {_VOTES} SELECT doc_id, section, kind, subkind, level, confidence, score, margin FROM votes",
    "section_flags": f"WITH {_VOTES} SELECT doc_id, section, flags, review FROM reviewed",
    "numbering_gap": f"WITH {_VOTES} SELECT doc_id, section, number, previous_number, gap FROM flagged WHERE number IS NOT NULL",
    "section_cascade": f"WITH {_CASCADE} SELECT doc_id, section, kind, confidence, basis, reason, confidence = 'low' OR kind = 'unclassified' OR n_title > 1 OR words < 20 OR words > 12000 AS review FROM classified",
    "duplicate_titles": f"WITH {_VOTES} SELECT doc_id, section, n_title AS n FROM votes WHERE n_title > 1",
    "start_section": f"WITH {_VOTES} SELECT doc_id, coalesce(min(CASE WHEN kind = 'chapter' AND NOT coalesce(subkind = 'part_divider' AND words < 20, false) THEN section END), min(CASE WHEN kind = 'unclassified' THEN section END), min(CASE WHEN kind NOT IN ('front_matter', 'back_matter') THEN section END), 0) AS start FROM votes GROUP BY ALL",
    "review_rollup": f"WITH {_VOTES} SELECT doc_id, count(*) AS n_sections, CAST(sum(CAST(review AS INTEGER)) AS BIGINT) AS review_count, bool_or(review) AS needs_review, CAST(sum(CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END) AS BIGINT) AS n_flags FROM reviewed GROUP BY ALL",
    "section_edits": f"WITH {_SECTIONS} SELECT doc_id, 'Notas' AS title, 'chapter' AS kind, 'manual review' AS basis FROM sections WHERE section = 1",
    "split_remap": f"WITH {PASSAGES}, s AS (SELECT doc_id, max(sentence) AS m FROM passages WHERE section = 2 GROUP BY ALL), r AS (SELECT p.doc_id, text, section + CASE WHEN m >= 1 AND (section > 2 OR section = 2 AND sentence >= 1) THEN 1 ELSE 0 END AS ns, sentence - CASE WHEN m >= 1 AND section = 2 AND sentence >= 1 THEN 1 ELSE 0 END AS nt FROM passages p LEFT JOIN s USING (doc_id)) SELECT doc_id, ns AS section, nt AS sentence, printf('%04d-%05d', ns, nt) AS citation, text FROM r",
    "merge_remap": f"WITH {PASSAGES}, s AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS m FROM passages WHERE section = 0 GROUP BY ALL), r AS (SELECT doc_id, text, CASE WHEN section > 0 THEN section - 1 ELSE 0 END AS ns, sentence + CASE WHEN section = 1 THEN m ELSE 0 END AS nt FROM passages JOIN s USING (doc_id)) SELECT doc_id, ns AS section, nt AS sentence, printf('%04d-%05d', ns, nt) AS citation, text FROM r",
    "edit_sentences": f"WITH {PASSAGES}, r AS (SELECT doc_id, section, sentence + CASE WHEN section = 0 THEN 1 ELSE 0 END AS sentence, sentence AS old_sentence, text, section = 0 AND sentence = 0 AS changed FROM passages) SELECT * FROM r UNION ALL SELECT doc_id, section, 0, 0, 'new', true FROM passages WHERE section = 0 AND sentence = 0",
    "library_sort": "SELECT o_orderkey AS doc_id, 'Book ' || o_custkey AS title FROM orders ORDER BY o_orderdate DESC, o_orderkey",
    "shelf_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')",
    "continue_reading": "SELECT user_id, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "latest_position": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "latest_job": "WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey, o_orderstatus, o_orderkey FROM customer LEFT JOIN o ON c_custkey = o_custkey",
    "extents": f"WITH {PASSAGES} SELECT doc_id, count(DISTINCT section) AS n_sections, count(*) AS n_sentences, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS n_words FROM passages GROUP BY ALL",
    "usage_quota": "WITH f AS (SELECT DISTINCT source, text FROM documents) SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS used, sum(octet_length(encode(text))) > 100000 AS over FROM f GROUP BY ALL",
    "progress": f"WITH {PASSAGES}, n AS (SELECT doc_id, section, count(*) AS n FROM passages GROUP BY ALL), s AS (SELECT doc_id, sum(CASE WHEN section < 3 THEN n WHEN section = 3 THEN least(n, 2) ELSE 0 END) AS r, sum(n) AS t FROM n WHERE section >= 1 GROUP BY ALL) SELECT d.doc_id, CAST(coalesce(floor(100.0::DOUBLE * r / t + 0.5), 0) AS INTEGER) AS percent FROM documents d LEFT JOIN s USING (doc_id)",
    "readiness": "SELECT l_orderkey, CAST(sum(CAST(l_returnflag <> 'N' AS INTEGER)) AS BIGINT) AS ready, count(*) AS total FROM lineitem GROUP BY ALL",
    "contiguous_ready": "WITH p AS (SELECT l_orderkey, l_quantity > 10 AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem) SELECT l_orderkey, coalesce(min(CASE WHEN NOT ok THEN i END), count(*)) AS contiguous FROM p GROUP BY ALL",
    "ready_run": f"WITH {PASSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, sentence) AS i, length(text) % 5 > 0 AS ok FROM passages), s AS (SELECT *, min(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, max(i) OVER (PARTITION BY doc_id) AS m FROM n) SELECT doc_id, citation, CAST(least(20, coalesce(stop, m + 1) - i) AS INTEGER) AS run FROM s",
    "rotated_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber < 3 AS INTEGER), l_linenumber) - 1 AS turn FROM lineitem",
    "timeline_offsets": 'SELECT doc_id, CAST(s - n_chars AS BIGINT) AS start, CAST(s AS BIGINT) AS "end" FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents)',
    "median_height": "SELECT l_suppkey, CAST(list_sort(list(l_quantity))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS DOUBLE) AS median FROM lineitem GROUP BY ALL",
    "index_diff": f"WITH {PASSAGES} SELECT CASE doc_id % 10 WHEN 3 THEN 'insert' WHEN 4 THEN 'update' WHEN 5 THEN 'delete' ELSE 'unchanged' END AS change, count(*) AS n FROM passages GROUP BY ALL",
    "index_status": "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'stale' ELSE 'ready' END AS status FROM documents",
    "missing_vectors": "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "stale_vectors": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "reusable_items": f"WITH {PASSAGES} SELECT doc_id, section, sentence FROM passages WHERE sentence % 2 = 0 AND section % 3 <> 0",
    "shared_sources": "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS shared FROM documents",
    "collectible": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "manual_override": "SELECT doc_id, coalesce(l.quality, CAST(n_chars > 300 AS INTEGER)) AS quality FROM documents LEFT JOIN labels l USING (doc_id)",
    "owner_rows": "SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_type <> 'error'",
    "toggled_marks": "SELECT user_id, value, count(*) AS toggles FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1",
    "cast_voices": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'alto' WHEN 'system' THEN 'bass' ELSE 'default' END AS voice FROM conversations",
    "clean_names": "SELECT conv_id, turn, CASE WHEN n <> '' AND length(n) <= 50 AND n NOT IN ('The', 'This', 'That', 'He', 'She', 'They', 'El', 'Ella', 'Él', 'Los', 'La', 'It', 'I', 'We', 'You') THEN n END AS name FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace('— ' || text, '^[ \\t\\n—–\"“«]+', ''), '[ \\t\\n”».,:;!?\"]+$', '')) AS n FROM conversations)",
    "signal_stats": "SELECT user_id, count(value) AS n, round(sqrt(sum((value - 25) * (value - 25)) / count(value)), 6) AS rms, max(abs(value - 25)) AS peak FROM events GROUP BY ALL",
    "active_bounds": "SELECT user_id, coalesce(greatest(min(event_id), min(CASE WHEN value > 60 THEN event_id END) - 100), min(event_id)) AS first, coalesce(least(max(event_id), max(CASE WHEN value > 60 THEN event_id END) + 100), max(event_id)) AS last FROM events GROUP BY ALL",
    "rolling_eta": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM events",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      s AS (SELECT user_id, 0 AS r, CAST([] AS BIGINT[]) AS passed, CAST(NULL AS BIGINT) AS event_id, false AS limited FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL SELECT user_id, r, CASE WHEN len(recent) >= 3 THEN recent ELSE list_append(recent, t) END, event_id, len(recent) >= 3 FROM (SELECT s.user_id, e.r, e.t, e.event_id, list_filter(s.passed, lambda p: p >= e.t - 14400000000) AS recent FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
      SELECT user_id, event_id, limited FROM s WHERE r > 0""",
    "change_snapshots": "SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true)",
    "undo_ttl": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('error', 'click')),
back AS (SELECT d.user_id, d.r, d.t, min(b.r) AS back FROM e AS d LEFT JOIN e AS b ON b.user_id = d.user_id AND NOT b.gone AND b.r > d.r AND b.t - d.t <= 3600000000 WHERE d.gone GROUP BY ALL),
after AS (SELECT o.user_id, o.r, o.back, min(d.r) AS after FROM back AS o LEFT JOIN e AS d ON d.user_id = o.user_id AND d.gone AND CASE WHEN o.back IS NULL THEN d.r > o.r AND d.t - o.t > 3600000000 ELSE d.r > o.back END GROUP BY ALL),
opened AS (SELECT user_id, min(r) AS r FROM e WHERE gone GROUP BY ALL UNION ALL SELECT opened.user_id, after.after FROM opened JOIN after USING (user_id, r) WHERE after.after IS NOT NULL)
SELECT user_id, event_id, CASE WHEN opened.r IS NULL THEN 'repeated' WHEN back IS NULL THEN 'purged' ELSE 'restored' END AS outcome FROM e LEFT JOIN opened USING (user_id, r) LEFT JOIN after USING (user_id, r) WHERE gone""",
    "late_updates": "WITH g AS (SELECT user_id, min(ts) AS g FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT event_id FROM events LEFT JOIN g USING (user_id) WHERE event_type = 'view' AND (g IS NULL OR ts < g)",
    "dedupe_requests": "SELECT event_id, user_id FROM events",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(median(value), 6) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL",
    "regression_check": "SELECT 'p50_' || event_type AS metric, b AS before, n AS now FROM (SELECT event_type, round(median(value), 6) AS n, quantile_disc(value, 0.95) - 50 AS b FROM events GROUP BY ALL) WHERE n + 0.005 < b",
}

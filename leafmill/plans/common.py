"""What the registered queries share: tables, and the SQL for lines, passages and tokens that the oracles build on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.functions import segment
from leafmill.functions.text import STOPWORDS
from leafmill.operators.passages import passages_of
from leafmill.operators.search import as_queries
from leafmill.operators.stored import store_lists, term_lists
from leafmill.sources.corpus import page_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, where their files give fewer partitions than that; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of the files of a table, as the file system that Spark reads has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))


_INDEXES: dict[tuple, DataFrame] = {}
#: Bytes of the documents' files for each bucket of the index, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64


def passage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents' passages. The first query of a session that needs it writes it; it is written anew where
    the documents' files have changed since."""
    files = files_of(spark, f"{sf_dir}/documents.parquet")
    name = (spark.sparkContext.applicationId, sf_dir, files)
    if name not in _INDEXES:
        buckets = max(LEAST_BUCKETS, -(-sum(size for _, size, _ in files) // BUCKET_BYTES))
        _INDEXES[name] = store_lists(term_lists(passages(spark, sf_dir), buckets=buckets), scratch(spark, "index"), buckets)
    return _INDEXES[name]


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_queries(table(spark, sf_dir, "benchmark"), "item_id", "text")


def quoted(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SPACES = r"'[\x{0009}-\x{000D}\p{Z}]+'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(173), ''), {SPACES}, ' ', 'g'))"


def fold(x: str) -> str:
    return f"regexp_replace(replace(strip_accents(replace(lower({x}), 'ñ', chr(57344))), chr(57344), 'ñ'), '\\p{{M}}', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


STOP = f"[{quoted(STOPWORDS)}]"


def content(x: str, least: int = 1) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({STOP}, w) AND length(w) >= {least})"


LINES = f"""lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, i, {clean("l")} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> '')"""

_CLOSERS = segment.CLOSERS.replace("'", "''")
_WORD = r"[\p{L}\p{N}_]"


def _kept(x: str) -> str:
    return f"translate({x}, '.!?', chr(57344) || chr(57345) || chr(57346))"


def shielded(line: str) -> str:
    """line with the end marks of addresses and abbreviations replaced, to be taken back by `unshielded`."""
    cut, begin = rf"(length(w) - length(regexp_extract(w, '[{segment.TRAILING}]+$', 0)))", rf"length(regexp_extract(w, '^(.*?)(?:{segment.LINK})', 1))"
    link = f"substring(w, 1, {begin}) || {_kept(f'substring(w, {begin} + 1, greatest({cut} - {begin}, 0))')}"
    word = f"CASE WHEN regexp_matches(w, '{segment.LINK}') THEN {link} WHEN regexp_matches(w, '{segment.MAIL}') THEN {_kept(f'substring(w, 1, {cut})')} ELSE substring(w, 1, {cut}) END || substring(w, {cut} + 1)"
    out = f"array_to_string(list_transform(string_split({line}, ' '), lambda w: {word}), ' ')"
    out = rf"regexp_replace({out}, '([\p{{L}}\p{{N}}_-])\.({'|'.join(segment.SITES)})', '\1' || chr(57344) || '\2', 'g')"
    for a, b, gap in segment.PAIRS:
        out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_])({a})\.({gap})({b})\.', '\1\2' || chr(57344) || '\3\4' || chr(57344), 'gi')"
    return out


#: Sentences of lines: pieces behind each run of end marks, whether each goes on, and runs of those that end one.
SENTENCES = rf"""s_pieces AS (SELECT doc_id, line_no, es, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
  SELECT doc_id, line_no, coalesce(starts_with(lower(lang), 'es'), false) AS es, regexp_extract_all({shielded("line")}, '[^.!?]*[.!?]+[{_CLOSERS.replace("]", chr(92) + "]")}]*|[^.!?]+') AS ps FROM lines JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))),
s_near AS (SELECT *, coalesce(lag(p) OVER w, '') AS before, coalesce(lead(p) OVER w, '') AS rest, rtrim(right(p, 40), '{_CLOSERS}') AS bare FROM s_pieces WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
s_words AS (SELECT *, regexp_extract(rtrim(bare, '.!?'), '{_WORD}+$', 0) AS word, substring(bare, length(rtrim(bare, '.!?')) + 1) AS marks, substring(ltrim(rest), 1, 1) AS nxt FROM s_near),
s_held AS (SELECT *, nxt IN (',', ';', ':') OR nxt <> '' AND starts_with(marks, '.') AND (
    CASE WHEN es THEN lower(word) IN ({quoted(segment.TITLES["es"])}) ELSE lower(word) IN ({quoted(segment.TITLES["en"])}) END
    OR lower(word) IN ({quoted(segment.MONTHS)}) AND regexp_matches(nxt, '[0-9]')
    OR lower(word) IN ({quoted(segment.OPEN_ENDED)}) AND regexp_matches(nxt, '\p{{Ll}}')
    OR length(word) = 1 AND regexp_matches(word, '\p{{Lu}}') AND regexp_matches(nxt, '\p{{Lu}}')
    OR regexp_matches(p, '^[A-Z][.]') AND regexp_matches(before, '(^|[^\p{{L}}\p{{N}}_])[A-Z]\.$')
    OR regexp_matches(p, '[0-9]\.$') AND regexp_matches(rest, '^[0-9]')
    OR starts_with(marks, '...') AND regexp_matches(nxt, '\p{{Ll}}')) AS held,
  nxt <> '' AND regexp_matches(trim(p), '^([0-9]+|[IVXLCDM]+)\.$') AS listed FROM s_words),
s_alone AS (SELECT *, listed AND NOT held AS alone, coalesce(lag(held) OVER w, false) AS after_held, i - row_number() OVER (PARTITION BY doc_id, line_no, listed AND NOT held ORDER BY i) AS run FROM s_held WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
s_ended AS (SELECT *, CASE WHEN held THEN false WHEN alone THEN ((row_number() OVER r) % 2 = 0) = NOT (first_value(after_held) OVER r) ELSE true END AS ended FROM s_alone WINDOW r AS (PARTITION BY doc_id, line_no, alone, run ORDER BY i)),
s_parts AS (SELECT doc_id, line_no, n, trim(string_agg(p, '' ORDER BY i)) AS part FROM (
  SELECT *, coalesce(sum(CAST(ended AS INTEGER)) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM s_ended) GROUP BY ALL),
s_glued AS (SELECT *, sum(CASE WHEN regexp_matches(part, '[\p{{L}}\p{{N}}]') THEN 1 ELSE 0 END) OVER w AS own, row_number() OVER w AS k FROM s_parts WHERE part <> '' WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY n)),
sentences AS (SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY least_n) - 1 AS INTEGER) AS sentence, text FROM (
  SELECT doc_id, line_no, min(n) AS least_n, translate(string_agg(part, '' ORDER BY n), chr(57344) || chr(57345) || chr(57346), '.!?') AS text FROM (
    SELECT *, CASE WHEN own = 0 THEN 0 WHEN first_value(own) OVER (PARTITION BY doc_id, line_no ORDER BY n) = 0 THEN own ELSE own - 1 END AS whole FROM s_glued) GROUP BY doc_id, line_no, whole))"""

PASSAGES = f"""{LINES},
{SENTENCES},
passages AS (SELECT doc_id, line_no AS section, sentence, printf('%04d-%05d', line_no, sentence) AS citation, text, array_to_string(string_split(line, ' ')[1:4], ' ') AS title, 'line:' || line_no AS source FROM sentences JOIN lines USING (doc_id, line_no))"""

QUERIES_CTE = f"""queries AS (SELECT query_id, terms, len(terms) AS n FROM (
  SELECT query_id, list_filter(t, lambda w, i: list_position(t, w) = i)[1:24] AS terms FROM (
    SELECT item_id AS query_id, {content(tokens("text"), 2)} AS t FROM benchmark WHERE length(text) <= 500)) WHERE len(terms) > 0),
asked AS (SELECT query_id, n, unnest(terms) AS term FROM queries)"""

"""Registered queries: sources, normalising, tokens, segmentation, language and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import segment, snowball, stem
from leafmill.functions import text as tx
from leafmill.operators import language, margins, passages as pg
from leafmill.plans.common import LINES, PASSAGES, SENTENCES, SPACES, clean, content, fold, lines, passages, quoted, table, tokens
from leafmill.sources import corpus


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def fold_keep_enye(spark, d):
    return _docs(spark, d).select("doc_id", tx.fold_keep_enye(F.col("text")).alias("folded"))


def fold_all(spark, d):
    return _docs(spark, d).select("doc_id", tx.fold_all(F.col("text")).alias("folded"))


def token_counts(spark, d):
    found = tx.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.array_join(F.slice(found, 1, 20), " ").alias("first_tokens"))


def content_terms(spark, d):
    rows = _docs(spark, d).select("lang", F.explode(tx.content_terms(tx.tokens(F.col("text")), least=2)).alias("term"))
    return rows.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


def word_stats(spark, d):
    n = tx.word_count(F.col("text")).cast("long")
    return _docs(spark, d).select("doc_id", n.alias("n_words"), tx.reading_minutes(n, F.col("lang")).alias("minutes"))


def dehyphenate(spark, d):
    return _docs(spark, d).select("doc_id", F.length(tx.dehyphenate(F.regexp_replace("text", "th", "t-\nh"))).cast("long").alias("n"))


def margin_forms(spark, d):
    return lines(spark, d).groupBy(tx.normalize_margin(F.col("line")).alias("form")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def page_lines(spark, d):
    return lines(spark, d).select("doc_id", "line_no", "line")


def explode_passages(spark, d):
    """From nested sections, as books hold them, back to passages."""
    rows = passages(spark, d)
    sections = rows.groupBy("doc_id", "section").agg(F.first("title").alias("title"), F.first("source").alias("source"), F.transform(F.sort_array(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]).alias("sentences"))
    books = sections.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section", "title", "source", "sentences"))), lambda s: F.struct(s["title"].alias("title"), s["source"].alias("source"), s["sentences"].alias("sentences"))).alias("sections"))
    return pg.explode_passages(books)


def list_sentences(spark, d):
    return pg.list_sentences(passages(spark, d))


def citations(spark, d):
    return corpus.citation_rows(passages(spark, d))


def citation_bundles(spark, d):
    return corpus.citation_bundle(passages(spark, d))


def export_library(spark, d):
    return corpus.export_library(passages(spark, d)).select("id", "version", F.size("sections").alias("n_sections"), F.to_json("sections").alias("sections"))


def import_checks(spark, d):
    books = corpus.export_library(passages(spark, d)).withColumn("language", F.lit("en"))
    sections = F.when(F.col("id").endswith("7"), F.transform("sections", lambda s: F.struct(F.lit(None).cast("string").alias("title"), s["sentences"].alias("sentences")))).otherwise(F.col("sections"))
    broken = books.select(F.when(F.col("id").endswith("9"), F.concat("id", F.lit(" "))).otherwise(F.col("id")).alias("id"), "version", "language", sections.alias("sections"))
    return corpus.import_library(broken).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def admission_checks(spark, d):
    return corpus.admission_checks(_docs(spark, d), most_bytes=5_000, least_chars=40, most_lines=20).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def fingerprints(spark, d):
    return corpus.fingerprint(_docs(spark, d), "text", F.col("lang"), F.lit(4)).select("doc_id", "sha256", "work_key")


def work_to_do(spark, d):
    now = corpus.fingerprint(_docs(spark, d), "text", F.col("lang"))
    done = corpus.fingerprint(_docs(spark, d).filter(F.col("lang") != "de"), "text", F.col("lang"))
    return corpus.work_to_do(now, done).select("doc_id", "lang")


def needs_ocr(spark, d):
    return corpus.needs_ocr(_docs(spark, d)).select("doc_id", "needs_ocr")


def content_signatures(spark, d):
    return passages(spark, d).select("doc_id", "citation", tx.signature(F.col("text"), F.col("title"), F.lit(1)).alias("signature"))


def language_codes(spark, d):
    tag = F.regexp_extract("html", r'<html[^>]*\blang="([^"]*)"', 1)
    return table(spark, d, "pages").select("page_id", tx.language_code(F.nullif(tag, F.lit(""))).alias("language"))


def highlights(spark, d):
    parts = tx.highlight_parts(F.col("text"), F.lit("tion"))
    marked = F.array_join(F.transform(parts, lambda p: F.when(p["match"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return passages(spark, d).select("doc_id", "citation", marked.alias("marked"))


def excerpts(spark, d):
    rows = passages(spark, d).groupBy("doc_id", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]).alias("s"))
    return rows.select("doc_id", "section", tx.excerpt(F.col("s")).alias("excerpt"))


def ordinals(spark, d):
    """Roman and decimal numerals among the folded tokens."""
    rows = _docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("numeral")).filter(F.col("numeral").rlike("^([ivxlcdm]{1,6}|[0-9]{1,9})$"))
    return rows.groupBy("numeral").agg(F.count(F.lit(1)).alias("n")).withColumn("value", tx.ordinal(F.col("numeral")))


def context_window(spark, d):
    return pg.with_context(passages(spark, d)).select("doc_id", "citation", "context", "context_start", "context_end")


def turn_context(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.lit(0).alias("section"), F.col("turn").alias("sentence"), "text")
    return pg.with_context(turns, "conv_id", hit=False, between=" … ").select("conv_id", F.col("sentence").alias("turn"), "context")


def offset_rows(spark, d):
    return pg.offset_row(passages(spark, d), 3).select("doc_id", "citation", "next_citation")


def heading_sections(spark, d):
    """Lines of up to three words stand for headings, which the documents lack."""
    heading = pg.is_heading(F.col("line")) | (F.size(F.split("line", " ")) <= 3)
    return pg.heading_sections(lines(spark, d), heading)


def outline_as_of(spark, d):
    rows = lines(spark, d).withColumnRenamed("line_no", "page")
    outline = rows.filter(F.size(F.split("line", " ")) <= 8).select("doc_id", "page", F.col("line").alias("title"))
    return pg.outline_as_of(rows, outline)


def repeated_margins(spark, d):
    rows = lines(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return margins.repeated_margins(rows, share=0.02)


def strip_margins(spark, d):
    rows = lines(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return margins.strip_margins(rows, share=0.02).select("source", "doc_id", "line_no", "removed")


def page_rollup(spark, d):
    return margins.page_rollup(lines(spark, d))


def even_sample(spark, d):
    return language.even_sample(lines(spark, d), "doc_id", "line_no", most=5).select("doc_id", "line_no")


def language_scores(spark, d):
    return language.language_scores(lines(spark, d)).withColumn("score", F.col("score").cast("long"))


def detect_language(spark, d):
    docs = _docs(spark, d)
    return language.detect_language(language.language_scores(lines(spark, d)), docs.select("doc_id", F.col("lang").alias("declared")))


def split_sentences_exact(spark, d):
    rows = lines(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "line_no", F.posexplode(segment.sentences(F.col("line"), F.col("lang"))).alias("sentence", "text"))


def chunk_text(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segment.chunks(F.col("text"), 400)).alias("chunk", "text"))


def split_balanced(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segment.halves(F.col("text"), 120)).alias("part", "text"))


def stems(spark, d):
    rows = _docs(spark, d).select("lang", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return stem.with_stems(rows, language=F.col("lang")).groupBy("lang", "stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms"))


def read_corpus(spark, d):
    return corpus.read_corpus(spark, f"{d}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))


def snowball_stems(spark, d):
    rows = _docs(spark, d).select("lang", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return snowball.with_stems(rows, language=F.col("lang")).groupBy("lang", "stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms"))


QUERIES = {f.__name__: f for f in (clean_text, fold_keep_enye, fold_all, token_counts, content_terms, word_stats, dehyphenate, margin_forms, page_lines, explode_passages, list_sentences, citations, citation_bundles, export_library, import_checks, admission_checks, fingerprints, work_to_do, needs_ocr, content_signatures, language_codes, highlights, excerpts, ordinals, context_window, turn_context, offset_rows, heading_sections, outline_as_of, repeated_margins, strip_margins, page_rollup, even_sample, language_scores, detect_language, split_sentences_exact, chunk_text, split_balanced, stems, snowball_stems, read_corpus)}



def _stem_sql(language: str) -> str:
    """The stem of w in SQL: a case for each suffix, in their order."""
    cases = []
    for end, put in (rule.split(":") for rule in stem.SUFFIXES[language]):
        base = f"w[1:length(w) - {len(end)}]"
        fits = f"ends_with(w, '{end}') AND length(w) >= {len(end) + 3} AND regexp_matches({base}, '[aeiouyáéíóúü]')"
        if end == "s":
            fits += f" AND NOT regexp_matches({base}, '[sui]$')"
        if end in ("ing", "ed"):
            cases.append(f"WHEN {fits} AND length({base}) > 3 AND right({base}, 1) = {base}[-2] AND right({base}, 1) NOT IN ('l', 's', 'z') THEN {base}[1:-2]")
        cases.append(f"WHEN {fits} THEN {base} || '{put}'")
    return f"CASE {' '.join(cases)} ELSE w END"


_STEM = f"CASE lang WHEN 'es' THEN {_stem_sql('es')} ELSE {_stem_sql('en')} END"
_MARKERS = " UNION ALL ".join(f"SELECT '{lang}' AS language, unnest([{quoted(sorted(set(words)))}]) AS word" for lang, words in language.MARKERS.items())
_SAMPLE = "CASE WHEN length(line) <= 6000 THEN line ELSE concat_ws(' ', line[1:2000], substring(line, CAST(floor(length(line) / 2) - 1000 + 1 AS BIGINT), 2000), substring(line, length(line) - 2000 + 1, 2000)) END"
_SCORES = f"""{LINES}, markers AS ({_MARKERS}),
words AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower({_SAMPLE}), '\\p{{L}}+')) AS word FROM lines),
counts AS (SELECT doc_id, line_no, word, least(count(*), 20) AS n FROM words GROUP BY ALL),
scores AS (SELECT doc_id, language, CAST(sum(n) AS BIGINT) AS score FROM counts JOIN markers USING (word) GROUP BY ALL)"""
_EDGES = f"""{LINES}, books AS (SELECT lines.*, source FROM lines JOIN documents USING (doc_id)),
ends AS (SELECT source, doc_id, count(*) AS n, min(line_no) AS a, max(line_no) AS b, arg_min(line, line_no) AS top, arg_max(line, line_no) AS bottom FROM books GROUP BY ALL),
edges AS (SELECT * FROM (SELECT source, doc_id, 'top' AS edge, a AS line_no, top AS margin FROM ends WHERE n > 2 UNION ALL SELECT source, doc_id, 'bottom', b, bottom FROM ends WHERE n > 2) WHERE length(margin) <= 80),
pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM books GROUP BY ALL),
repeated AS (SELECT source, edge, margin, n FROM (SELECT source, edge, margin, count(*) AS n FROM edges GROUP BY ALL) JOIN pages USING (source) WHERE n >= greatest(3, ceil(pages * 0.02::DOUBLE)))"""

_SOLID = SPACES.replace("[", "[^", 1)


def _bare(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^' || {SPACES}, ''), {SPACES} || '$', '')"


def _halving(k: int) -> str:
    """Level k + 1 of the tree of parts: those of more than 120 words cut in two, at the place that comes first."""
    own = "PARTITION BY doc_id, path"
    pieces = lambda pattern: f"(SELECT doc_id, path, n, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(part, {pattern}) AS l FROM long{k}))"
    ends = lambda pattern: f"(SELECT doc_id, path, n, x, sum(length(x)) OVER ({own} ORDER BY i) AS e FROM {pieces(pattern)})"
    return f"""long{k} AS (SELECT doc_id, path, part, length(part) AS n FROM level{k} WHERE len(regexp_extract_all(part, {_SOLID})) > 120),
at{k} AS (SELECT doc_id, path, n, e, 0 AS late FROM {ends("'(?s).*?[,:;—–]' || " + SPACES)} WHERE 4 * e > n AND 4 * e < 3 * n
  UNION ALL SELECT doc_id, path, n, e - length(regexp_extract(x, {SPACES} || '$')), 1 FROM {ends(_SOLID + " || " + SPACES)}),
cut{k} AS (SELECT doc_id, path, e FROM at{k} QUALIFY row_number() OVER ({own} ORDER BY late, abs(2 * e - n), e) = 1),
level{k + 1} AS (SELECT doc_id, path, part FROM level{k} ANTI JOIN cut{k} USING (doc_id, path)
  UNION ALL SELECT doc_id, path || '0', {_bare('left(part, CAST(e AS BIGINT))')} FROM long{k} JOIN cut{k} USING (doc_id, path)
  UNION ALL SELECT doc_id, path || '1', {_bare('substring(part, CAST(e AS BIGINT) + 1)')} FROM long{k} JOIN cut{k} USING (doc_id, path))"""


_FITS = "list_max(list_filter(range(100, 401), lambda n: strlen(left(rest, n)) <= 400))"

ORACLE_SQL = {
    "read_corpus": "SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(trim(text)) > 0",
    "chunk_text": f"""WITH RECURSIVE base AS (SELECT doc_id, trim(regexp_replace(text, {SPACES}, ' ', 'g')) AS rest FROM documents WHERE text IS NOT NULL),
      views AS (SELECT doc_id, -1 AS chunk, CAST(NULL AS VARCHAR) AS text, rest FROM base UNION ALL
        SELECT doc_id, chunk + 1, left(rest, used - 1), substring(rest, used + 1) FROM (SELECT doc_id, chunk, rest, CASE WHEN strlen(rest) <= 400 THEN length(rest) + 1 WHEN clause > length(head) // 2 THEN clause ELSE length(head) - length(string_split(head, ' ')[-1]) END AS used
          FROM (SELECT *, length(regexp_extract(head, '^.*[,;:—] ')) AS clause FROM (SELECT doc_id, chunk, rest, left(rest, {_FITS}) AS head FROM views WHERE rest <> ''))) WHERE used > 1),
      whole AS (SELECT doc_id FROM views WHERE rest = '' GROUP BY doc_id)
      SELECT doc_id, chunk, text FROM views JOIN whole USING (doc_id) WHERE chunk >= 0""",
    "split_balanced": f"""WITH level0 AS (SELECT doc_id, '' AS path, {_bare('text')} AS part FROM documents WHERE text IS NOT NULL), {", ".join(_halving(k) for k in range(8))},
      done AS (SELECT *, max(len(regexp_extract_all(part, {_SOLID}))) OVER (PARTITION BY doc_id) AS most FROM level8)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS part, part AS text FROM done WHERE most <= 120 AND part <> ''""",
    "clean_text": f"SELECT doc_id, {clean('nfc_normalize(text)')} AS clean FROM documents",
    "fold_keep_enye": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "fold_all": "SELECT doc_id, regexp_replace(strip_accents(lower(text)), '\\p{M}', '', 'g') AS folded FROM documents",
    "token_counts": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w[1:20], ' ') AS first_tokens FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "content_terms": f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({content(tokens('text'), 2)}) AS term FROM documents) GROUP BY ALL",
    "word_stats": f"SELECT doc_id, n_words, round(CAST(n_words AS DOUBLE) / CASE WHEN lang = 'es' THEN 160 ELSE 170 END, 2) AS minutes FROM (SELECT doc_id, lang, CAST(CASE WHEN trim(regexp_replace(text, {SPACES}, ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, {SPACES}, ' ', 'g')), ' ')) END AS BIGINT) AS n_words FROM documents)",
    "dehyphenate": "SELECT doc_id, CAST(length(regexp_replace(replace(text, 'th', 't-' || chr(10) || 'h'), '(\\p{Ll})-[ \\t]*\\n[ \\t\\n]*(\\p{Ll})', '\\1\\2', 'g')) AS BIGINT) AS n FROM documents",
    "margin_forms": f"WITH {LINES} SELECT form, count(*) AS n FROM (SELECT regexp_replace(lower(line), '[0-9]+', '#', 'g') AS form FROM lines) GROUP BY ALL HAVING count(*) > 1",
    "page_lines": f"WITH {LINES} SELECT * FROM lines",
    "explode_passages": f"WITH {PASSAGES} SELECT * FROM passages",
    "split_sentences_exact": f"WITH {LINES}, {SENTENCES} SELECT doc_id, line_no, sentence, text FROM sentences",
    "list_sentences": f"WITH {PASSAGES} SELECT doc_id, citation, text FROM passages",
    "citation_bundles": f"""WITH {PASSAGES}, s AS (SELECT doc_id, section AS chapter, min(title) AS title, list({{'sentence_id': citation, 'text': text, 'anchor': source || '#sentence=' || sentence}} ORDER BY citation) AS sentences FROM passages GROUP BY ALL)
      SELECT doc_id, CAST(to_json(list({{'chapter': chapter, 'title': title, 'sentences': sentences}} ORDER BY chapter)) AS VARCHAR) AS sections FROM s GROUP BY ALL""",
    "export_library": f"""WITH {PASSAGES}, s AS (SELECT doc_id, section, min(title) AS title, list(text ORDER BY sentence) AS sentences FROM passages GROUP BY ALL)
      SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS version, CAST(count(*) AS INTEGER) AS n_sections, CAST(to_json(list({{'title': title, 'sentences': sentences}} ORDER BY section)) AS VARCHAR) AS sections FROM s GROUP BY doc_id""",
    "import_checks": f"WITH {PASSAGES} SELECT CASE doc_id % 10 WHEN 9 THEN 'bad id' WHEN 7 THEN 'section without a title' ELSE '' END AS errors, count(*) AS n FROM (SELECT DISTINCT doc_id FROM passages) GROUP BY ALL",
    "stems": f"WITH w AS (SELECT lang, unnest({tokens('text')}) AS w FROM documents) SELECT lang, {_STEM} AS stem, count(*) AS n, count(DISTINCT w) AS n_terms FROM w GROUP BY ALL",
    "citations": f"WITH {PASSAGES} SELECT doc_id, citation AS sentence_id, section AS chapter, title, text, source || '#sentence=' || sentence AS anchor FROM passages",
    "admission_checks": "SELECT doc_id, concat_ws(',', CASE WHEN length(trim(text)) < 40 THEN 'empty' END, CASE WHEN octet_length(encode(text)) > 5000 THEN 'too large' END, CASE WHEN len(string_split(text, chr(10))) > 20 THEN 'too many lines' END, CASE WHEN contains(text, chr(65533)) THEN 'broken encoding' END) AS reasons FROM documents",
    "fingerprints": "SELECT doc_id, sha256(text) AS sha256, sha256(concat_ws(chr(1), sha256(text), lang, '4')) AS work_key FROM documents",
    "work_to_do": "SELECT doc_id, lang FROM documents WHERE lang = 'de'",
    "needs_ocr": "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) < 24 AS needs_ocr FROM documents",
    "content_signatures": f"WITH {PASSAGES} SELECT doc_id, citation, sha256(concat_ws(chr(1), text, title, '1')) AS signature FROM passages",
    "language_codes": "SELECT page_id, CASE WHEN c = '' THEN 'en' WHEN c IN ('en', 'es', 'fr', 'de') THEN c END AS language FROM (SELECT page_id, string_split(replace(lower(trim(regexp_extract(html, '<html[^>]*[^\\w]lang=\"([^\"]*)\"', 1))), '_', '-'), '-')[1] AS c FROM pages)",
    "highlights": f"WITH {PASSAGES} SELECT doc_id, citation, regexp_replace(text, '([tT][iIíìîïÍÌÎÏ][oOóòôöÓÒÔÖ][nNñÑ])', '[\\1]', 'g') AS marked FROM passages",
    "excerpts": f"WITH {PASSAGES} SELECT doc_id, section, substring(string_agg(text, ' ' ORDER BY sentence), 1, 600) AS excerpt FROM passages WHERE sentence < 2 GROUP BY ALL",
    "ordinals": f"""WITH words AS (SELECT numeral, count(*) AS n FROM (SELECT unnest({tokens("text")}) AS numeral FROM documents) WHERE regexp_full_match(numeral, '[ivxlcdm]{{1,6}}|[0-9]{{1,9}}') GROUP BY ALL),
      digits AS (SELECT numeral, i, CASE numeral[i] WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 END AS v FROM (SELECT numeral, unnest(range(1, length(numeral) + 1)) AS i FROM words)),
      signed AS (SELECT numeral, CASE WHEN lead(v) OVER (PARTITION BY numeral ORDER BY i) > v THEN -v ELSE v END AS v FROM digits)
      SELECT numeral, n, CAST(coalesce(TRY_CAST(numeral AS BIGINT), s) AS INTEGER) AS value FROM words JOIN (SELECT numeral, sum(v) AS s FROM signed GROUP BY ALL) USING (numeral)""",
    "context_window": f"WITH {PASSAGES} SELECT doc_id, citation, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS context, coalesce(lag(sentence) OVER w, sentence) AS context_start, coalesce(lead(sentence) OVER w, sentence) AS context_end FROM passages WINDOW w AS (PARTITION BY doc_id, section ORDER BY sentence)",
    "turn_context": "SELECT conv_id, turn, concat_ws(' … ', lag(text) OVER w, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "offset_rows": f"WITH {PASSAGES} SELECT doc_id, citation, lead(citation, 3) OVER (PARTITION BY doc_id ORDER BY section, sentence) AS next_citation FROM passages",
    "heading_sections": f"WITH {LINES}, marked AS (SELECT doc_id, line_no, line, CAST(len(string_split(line, ' ')) <= 3 AS INTEGER) AS h FROM lines), cut AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section FROM marked) SELECT doc_id, section, coalesce(min(CASE WHEN h = 1 THEN line END), 'Page 1') AS title, min(line_no) AS start_line, count(*) AS n_lines FROM cut GROUP BY ALL",
    "outline_as_of": f"WITH {LINES} SELECT doc_id, line_no AS page, last_value(CASE WHEN len(string_split(line, ' ')) <= 8 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM lines",
    "repeated_margins": f"WITH {_EDGES} SELECT * FROM repeated",
    "strip_margins": f"""WITH {_EDGES},
      hits AS (SELECT edges.*, row_number() OVER (PARTITION BY source, edge, margin ORDER BY doc_id) AS k FROM edges SEMI JOIN repeated USING (source, edge, margin)),
      gone AS (SELECT DISTINCT source, doc_id, line_no FROM hits WHERE edge = 'bottom' OR k > 1)
      SELECT b.source, b.doc_id, b.line_no, g.line_no IS NOT NULL OR (p.pages >= 3 AND e.n >= 2 AND b.line_no = e.b AND regexp_full_match(lower(b.line), '(page|página|pagina)?\\s*[0-9]+')) AS removed
      FROM books b LEFT JOIN gone g ON b.source = g.source AND b.doc_id = g.doc_id AND b.line_no = g.line_no JOIN pages p ON b.source = p.source JOIN ends e ON b.source = e.source AND b.doc_id = e.doc_id""",
    "page_rollup": f"WITH {LINES} SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) AS n_lines, CASE WHEN sum(length(line)) < 24 THEN 'ocr' ELSE 'native' END AS method, CASE WHEN sum(length(line)) < 24 THEN 'little text' END AS warning FROM lines GROUP BY ALL",
    "even_sample": f"WITH {LINES}, n AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, line_no FROM n WHERE n <= 5 OR list_contains(list_transform([0, 1, 2, 3, 4], lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS INTEGER)), line_no)",
    "language_scores": f"WITH {_SCORES} SELECT * FROM scores",
    "detect_language": f"""WITH {_SCORES},
      best AS (SELECT doc_id, max(score) AS score, arg_max(language, (score, language)) AS winner, sum(score) AS total, coalesce(list_sort(list(score), 'DESC')[2], 0) AS second FROM scores GROUP BY doc_id),
      facts AS (SELECT d.doc_id, d.lang, winner, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(score >= 3 AND score * 1.0 / total >= 0.7 AND score - second >= 2, false) AS strong FROM documents d LEFT JOIN best USING (doc_id))
      SELECT doc_id, CASE WHEN strong THEN winner ELSE lang END AS language, CASE WHEN strong THEN 'text' ELSE 'metadata' END AS evidence, CASE WHEN strong AND score >= 8 AND score * 1.0 / total >= 0.8 THEN 'high' WHEN strong THEN 'medium' ELSE 'low' END AS confidence, NOT strong OR winner <> lang AS review, strong AND winner <> lang AS mismatch, score, total FROM facts""",
}

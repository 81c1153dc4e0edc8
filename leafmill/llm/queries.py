"""The registered queries of this subpackage: each applies one operator, with production parameters, to its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.licenses import with_licenses

    found = with_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from leafmill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from a labelled table of its own, not from the rules' verdicts."""
    from leafmill.llm.labelled_urls import labelled_urls
    from leafmill.llm.urls import host_and_path, judge, train

    host, path = host_and_path(F.col("url"))
    known = labelled_urls(spark).select(host.alias("host"), path.alias("path"), "label")
    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), model=train(known)).select("page_id", "host", "path", "rule", "verdict")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.chat import conversations, format_preferences, with_borrowed_replies

    out = format_preferences(with_borrowed_replies(conversations(_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.brown import score

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = score(_table(spark, sf_dir, "documents"), held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.secrets import joined, with_secrets

    found = with_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("secrets").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.decontam import with_matches

    found = with_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.col("contamination.items")
    return found.select("doc_id", "contamination.n_words", "contamination.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("contamination.n_hit") > 0).alias("contaminated"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.quality import judge, learn_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, learn_rules(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.divergence import divergences

    return divergences(_table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.suffixes import remove_shared

    out = remove_shared(_table(spark, sf_dir, "documents"), size=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from leafmill.llm.alignment import align

    out = align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_secret_scans": op6_secret_scans,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: SQL for the queries whose rows need no trained model and no tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": f"""WITH d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
here AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM asked) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM here JOIN asked USING (n, run)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_substring_dedup": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
runs AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM runs WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes AS x ON x.doc_id = a.doc_id JOIN sizes AS y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, e.v FROM reach JOIN (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) AS e ON e.u = reach.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(v) AS component_id, min(v) = d.doc_id AS kept FROM d JOIN reach ON u = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id, n""",
    "op11_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce({_LOWER}, '') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
n AS (SELECT lang, source, term, count(*) AS c FROM w JOIN v USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(c) AS total FROM v GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS total FROM n GROUP BY lang, source) USING (lang, source)),
shares AS (SELECT g.lang, g.source, v.term, coalesce(n.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 2)) // (g.total + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (v.c + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}

"""Registered queries: the index, conditions, search, vectors, features and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import vectors as fv
from leafmill.functions.text import tokens as text_tokens
from leafmill.operators import evaluate, features, filters, index, search, stored
from leafmill.operators import vectors as ov
from leafmill.plans.common import PASSAGES, QUERIES_CTE, STOP, benchmark_queries, content, passage_lists, passages, quoted, table, tokens

_HIT = ["doc_id", "section", "sentence"]
# Words that the conditions below ask for.
SOME, MORE, RARE = ("thing", "with"), ("para", "osue"), ("reed", "hand")


def _tokened(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).withColumn("tokens", text_tokens(F.col("text")))


def postings(spark, d):
    return index.postings(passages(spark, d)).select(*_HIT, "column", "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def index_stats(spark, d):
    return index.statistics(passages(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


def document_frequencies(spark, d):
    return index.document_frequencies(index.postings(passages(spark, d)))


def vocabulary(spark, d):
    return index.vocabulary(index.postings(passages(spark, d)))


def _asked(spark, d):
    return benchmark_queries(spark, d).select("query_id", F.explode("terms").alias("term"))


def bm25(spark, d):
    return stored.bm25(passage_lists(spark, d), _asked(spark, d))


def all_terms_filter(spark, d):
    return _tokened(spark, d).filter(filters.all_terms(F.col("tokens"), SOME)).select("doc_id", "citation")


def any_terms_filter(spark, d):
    return _tokened(spark, d).filter(filters.any_terms(F.col("tokens"), RARE)).select("doc_id", "citation")


def excluded_terms(spark, d):
    return _tokened(spark, d).filter(filters.required_and_excluded(F.col("tokens"), ["the"], ["of", "and"])).select("doc_id", "citation")


def phrase_search(spark, d):
    return _tokened(spark, d).filter(filters.phrase(F.col("tokens"), ["of", "the"])).select("doc_id", "citation")


def prefix_search(spark, d):
    return _tokened(spark, d).filter(filters.prefix(F.col("tokens"), "thst")).select("doc_id", "citation")


def near_search(spark, d):
    rows = index.postings(passages(spark, d), stopwords=())
    return filters.near(rows, ["thing", "with"], 8)


def scoped_passages(spark, d):
    rows = passages(spark, d).withColumn("kind", F.when(F.col("section") == 0, "front_matter").otherwise("chapter"))
    return filters.in_scope(rows, section=1, kind="chapter").select("doc_id", "citation")


def find_substring(spark, d):
    return filters.find_substring(passages(spark, d), "Ñasta").select("doc_id", "citation")


def search_overlap(spark, d):
    return search.search_overlap(passages(spark, d), benchmark_queries(spark, d)).select("query_id", "rank", *_HIT, "citation", "match", "matched", "score")


def question_checks(spark, d):
    """Each benchmark text, and all of those of a passage of it as one, as a question."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    whole = items.groupBy((-F.floor(F.col("item_id") / 10) - 1).alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return search.question_checks(items.unionByName(whole), "item_id", "text").withColumn("n_letters", F.col("n_letters").cast("long"))


def _plain_tiers(spark, d):
    return search.tier_candidates(passages(spark, d), benchmark_queries(spark, d), stems=False, fuzzy=False, lists=passage_lists(spark, d))


def tier_union(spark, d):
    return _plain_tiers(spark, d).groupBy("query_id", "match_type", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("matched")).alias("n_matched"))


def ranked_tiers(spark, d):
    return search.rank_hits(_plain_tiers(spark, d), most=8).select("query_id", "rank", *_HIT, "match_type", "coverage", "score")


def match_type_filter(spark, d):
    hits = search.rank_hits(_plain_tiers(spark, d), most=8)
    return filters.of_match_type(hits, "exact").select("query_id", "rank", *_HIT)


def search_tiered(spark, d):
    """Stems, fuzzy terms and diverse picks included."""
    return search.search_tiered(passages(spark, d), benchmark_queries(spark, d), lists=passage_lists(spark, d)).select("query_id", "pick", *_HIT, "match_type", "coverage", "score", "context")


def greedy_diversity(spark, d):
    ranked = search.rank_hits(_plain_tiers(spark, d), most=100)
    return search.diverse_hits(ranked)


def answer_passages(spark, d):
    return search.answer_passages(search.rank_hits(_plain_tiers(spark, d), most=8)).withColumn("n_passages", F.col("n_passages").cast("long"))


def _fuzzy_terms(spark, d):
    """Query terms with their third letter changed, so that they need correction."""
    changed = F.concat(F.substring("term", 1, 2), F.lit("x"), F.substring("term", 4, 100))
    return _asked(spark, d).select(changed.alias("term")).filter(F.length("term") >= 4).distinct()


def fuzzy_blocks(spark, d):
    vocabulary = index.postings(passages(spark, d), columns=("surface",)).select("term")
    return index.fuzzy_blocks(_fuzzy_terms(spark, d), vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def closest_terms(spark, d):
    vocabulary = index.postings(passages(spark, d), columns=("surface",)).select("term")
    return index.closest_terms(index.fuzzy_blocks(_fuzzy_terms(spark, d), vocabulary))


def summaries(spark, d):
    return features.summaries(passages(spark, d)).select(*_HIT, "text", "score")


def entities(spark, d):
    return features.entities(passages(spark, d), most=20).select("doc_id", "term", "count", F.array_join("passages", ",").alias("passages"))


def keywords(spark, d):
    return features.keywords(passages(spark, d), most=20).select("doc_id", "term", "count", F.size("sections").cast("long").alias("n_sections"))


def quotes(spark, d):
    return features.quotes(passages(spark, d)).select("doc_id", "citation", "quote")


def repetitions(spark, d):
    return features.repetitions(passages(spark, d)).select("doc_id", "tokens", "count", F.col("first.section").alias("section"), F.col("first.sentence").alias("sentence"))


def corpus_repetitions(spark, d):
    return features.repetitions(passages(spark, d), key=None).select("tokens", "count", F.col("first.doc_id").alias("doc_id"))


def speakers(spark, d):
    return features.dialogue_speakers(passages(spark, d)).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))


def character_counts(spark, d):
    name = F.regexp_extract("text", r"^(\p{Lu}\p{Ll}+)", 1)
    rows = features.character_counts(table(spark, d, "conversations"), "role", name, ["conv_id", "turn"], most=20)
    return rows.select("role", "name", "count", F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn"))


def distinct_terms(spark, d):
    return index.vocabulary(index.postings(passages(spark, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ov.cosine_topk(rows, queries, least=0.2)


def normalized_vectors(spark, d):
    unit = fv.l2_normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(fv.norm(F.col("embedding")), 5).alias("norm"), F.round(fv.norm(unit), 5).alias("unit_norm"), F.round(unit[0], 5).alias("first"))


def pooled_vectors(spark, d):
    """The mean vector of each label, from the vectors as rows of tokens with a mask."""
    rows = table(spark, d, "embeddings").withColumn("part", F.pmod(F.col("vec_id"), F.lit(16)))
    held = rows.groupBy("label", "part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    mask = F.transform("all", lambda x: (x["vec_id"] % 3 > 0).cast("int"))
    pooled = fv.mean_pool(F.transform("all", lambda x: x["embedding"]), mask)
    return held.select("label", "part", F.round(pooled[0], 5).alias("first"), F.round(pooled[63], 5).alias("last"))


def rrf_fusion(spark, d):
    """For each query, a vector whose id 50 divides: the ranks by likeness to it and to the next vector, fused."""
    rows = table(spark, d, "embeddings")
    lists = [ov.cosine_topk(rows, rows.filter(F.col("vec_id") % 50 == i).select((F.col("vec_id") - i).alias("query_id"), "embedding"), least=-1.0) for i in (0, 1)]
    return search.fuse(*lists, ["query_id", "vec_id"]).select("query_id", "vec_id", "rank_a", "rank_b", F.round("rrf", 6).alias("rrf"))


def hybrid_ranks(spark, d):
    """Lexical ranks fused with those by vectors. The vector table's ids are taken as documents, whose first sentences the
    vectors stand for, its labels as models, and the vector of an item's id as the question's."""
    lexical = search.search_overlap(passages(spark, d), benchmark_queries(spark, d), most=20).select("query_id", *_HIT, "rank")
    rows = table(spark, d, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("doc_id"), F.lit("0000-00000").alias("citation"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), "embedding")
    known = search.embedded(passages(spark, d), vectors, "m0").select(*_HIT, "embedding")
    asked = rows.join(table(spark, d, "benchmark"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    semantic = ov.cosine_topk(known, asked, key="doc_id", least=-1.0).join(known.select(*_HIT), "doc_id").select("query_id", *_HIT, "rank")
    return search.hybrid_search(lexical, semantic).select("query_id", "rank", *_HIT, "source")


def _judged(spark, d):
    """Quality predicted from the share of symbols, against the labels."""
    share = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length("text"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", "lang", share.alias("share"))
    predicted = F.when(F.col("share") > 0.08, 0).otherwise(1)
    level = F.when(F.abs(F.col("share") - 0.08) > 0.06, "high").when(F.abs(F.col("share") - 0.08) > 0.04, "medium").otherwise("low")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("gold"), predicted.alias("predicted"), level.alias("level"))


def confusion(spark, d):
    return evaluate.confusion(_judged(spark, d), "gold", "predicted")


def class_scores(spark, d):
    return evaluate.class_scores(_judged(spark, d), "gold", "predicted")


def overall_scores(spark, d):
    return evaluate.overall_scores(_judged(spark, d), "gold", "predicted")


def calibration(spark, d):
    return evaluate.calibration(_judged(spark, d), "level", "gold", "predicted")


def _scored_queries(spark, d):
    """Benchmark items as queries; their labels are the passages that hold their first three words in a row."""
    rows = passages(spark, d)
    queries = benchmark_queries(spark, d)
    hits = search.search_overlap(rows, queries, most=10).withColumns({"context_start": F.col("sentence") - 1, "context_end": F.col("sentence") + 1})
    first = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(text_tokens(F.col("text")), 1, 3), " ").alias("phrase"))
    shingles = F.explode(F.array_distinct(F.transform(F.slice("tokens", 1, F.size("tokens") - 2), lambda t, i: F.concat_ws(" ", t, F.get("tokens", i + 1), F.get("tokens", i + 2)))))
    gold = rows.withColumn("tokens", text_tokens(F.col("text"))).filter(F.size("tokens") >= 3).select(*_HIT, shingles.alias("phrase")).join(first, "phrase").select("query_id", *_HIT).distinct()
    relevant = evaluate.relevance(hits, gold)
    return evaluate.query_scores(queries.select("query_id", F.when(F.size("terms") > 20, "long").otherwise("short").alias("category")), relevant, gold, hits)


def retrieval_metrics(spark, d):
    return evaluate.retrieval_metrics(_scored_queries(spark, d)).select("n", "recall_1", "recall_5", "recall_10", "mrr", "ndcg_10", "abstain_precision", "abstain_recall")


def metrics_by_category(spark, d):
    return evaluate.retrieval_metrics(_scored_queries(spark, d), "category").select("category", "n", "recall_5", "mrr")


QUERIES = {f.__name__: f for f in (postings, index_stats, document_frequencies, vocabulary, bm25, all_terms_filter, any_terms_filter, excluded_terms, phrase_search, prefix_search, near_search, scoped_passages, find_substring, search_overlap, question_checks, tier_union, ranked_tiers, match_type_filter, search_tiered, greedy_diversity, answer_passages, fuzzy_blocks, closest_terms, summaries, entities, keywords, quotes, repetitions, corpus_repetitions, speakers, character_counts, distinct_terms, cosine_topk, normalized_vectors, pooled_vectors, rrf_fusion, hybrid_ranks, confusion, class_scores, overall_scores, calibration, retrieval_metrics, metrics_by_category)}

_TOKENED = f"{PASSAGES}, tokened AS (SELECT *, {tokens('text')} AS w FROM passages)"
_WORDS = f"""{PASSAGES}, words AS (
  SELECT doc_id, section, sentence, 'surface' AS "column", unnest({tokens('text')}) AS term, generate_subscripts({tokens('text')}, 1) - 1 AS p FROM passages UNION ALL
  SELECT doc_id, section, sentence, 'title', unnest({tokens('title')}), generate_subscripts({tokens('title')}, 1) - 1 FROM passages),
postings AS (SELECT doc_id, section, sentence, "column", term, count(*) AS tf, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM words WHERE NOT list_contains({STOP}, term) GROUP BY ALL),
sizes AS (SELECT doc_id, section, sentence, count(*) AS length FROM words GROUP BY ALL),
stats AS (SELECT doc_id, count(*) AS n_passages, avg(coalesce(length, 0)) AS mean_length FROM passages LEFT JOIN sizes USING (doc_id, section, sentence) GROUP BY doc_id),
df AS (SELECT doc_id, term, count(DISTINCT (section, sentence)) AS df FROM postings GROUP BY ALL)"""
_BM = f"""{_WORDS}, {QUERIES_CTE},
hits AS (SELECT query_id, doc_id, section, sentence, term, sum(tf * CASE "column" WHEN 'surface' THEN 1.0::DOUBLE ELSE 1.6::DOUBLE END) AS tf FROM postings JOIN asked USING (term) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, section, sentence, round(sum(greatest(ln((n_passages - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS bm25
  FROM hits JOIN df USING (doc_id, term) JOIN stats USING (doc_id) JOIN sizes USING (doc_id, section, sentence) GROUP BY ALL)"""
_TIERS = f"""{_BM},
found AS (SELECT query_id, doc_id, section, sentence, count(DISTINCT term) AS m FROM postings JOIN asked USING (term) GROUP BY ALL),
tiers AS (SELECT f.*, n, CASE WHEN m = n THEN 'exact' ELSE 'partial' END AS match_type, CASE WHEN m = n THEN 40 ELSE 20 END AS tier, round(CAST(m AS DOUBLE) / n, 6) AS coverage, coalesce(bm25, 0) AS bm25 FROM found f JOIN queries USING (query_id) LEFT JOIN bm USING (query_id, doc_id, section, sentence)),
capped AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY query_id, tier ORDER BY bm25 DESC, doc_id, section, sentence) <= 160),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, section, sentence) AS rank FROM (SELECT *, round(tier + coverage + 0.1::DOUBLE * least(1.0::DOUBLE, abs(bm25)), 6) AS score FROM capped)),
best AS (SELECT * FROM ranked WHERE rank <= 8)"""
_OVERLAP = f"""{PASSAGES}, {QUERIES_CTE},
distinct_words AS (SELECT doc_id, section, sentence, citation, unnest(list_distinct({content(tokens('text'), 2)})) AS term FROM passages),
overlap AS (SELECT query_id, n, doc_id, section, sentence, citation, count(*) AS matched FROM distinct_words JOIN asked USING (term) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, section, sentence, citation, CASE WHEN matched = n THEN 'exact' ELSE 'partial' END AS match, matched, CASE WHEN matched = n THEN CAST(100 + matched AS DOUBLE) ELSE round(20 + CAST(matched AS DOUBLE) / n, 6) END AS score FROM overlap),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, section, sentence) AS rank FROM scored)"""
def _RUN(a: str, b: str) -> str:  # noqa: N802
    """The longest common run of two words: its size, and its places, negated, as the earliest of several counts."""
    runs = f"list_transform(range(1, length({a}) - n + 2), lambda i: {{'size': n, 'a': -i, 'b': -instr({b}, substring({a}, i, n))}})"
    return f"list_reverse_sort(list_filter(flatten(list_transform(range(1, least(length({a}), length({b})) + 1), lambda n: {runs})), lambda x: x.b < 0))[1]"


_FUZZY = f"""{PASSAGES}, {QUERIES_CTE},
changed AS (SELECT DISTINCT term[1:2] || 'x' || substring(term, 4) AS term FROM asked WHERE length(term[1:2] || 'x' || substring(term, 4)) >= 4),
known AS (SELECT DISTINCT candidate FROM (SELECT unnest({tokens('text')}) AS candidate FROM passages) WHERE NOT list_contains({STOP}, candidate)),
blocks AS (SELECT term, candidate FROM changed JOIN known ON (left(term, 1) = left(candidate, 1) OR right(term, 1) = right(candidate, 1)) AND abs(length(term) - length(candidate)) <= 2)"""
_NAMES = r"\p{Lu}\p{Ll}+(?: (?:(?:de|del|la) )?\p{Lu}\p{Ll}+){0,3}"
_JUDGED = r"""judged AS (SELECT doc_id, lang, quality AS gold, CASE WHEN share > 0.08 THEN 0 ELSE 1 END AS predicted, CASE WHEN abs(share - 0.08) > 0.06 THEN 'high' WHEN abs(share - 0.08) > 0.04 THEN 'medium' ELSE 'low' END AS level
  FROM labels JOIN (SELECT doc_id, lang, CAST(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS share FROM documents) USING (doc_id))"""
_CLASSES = f"""{_JUDGED}, sides AS (SELECT gold AS label, 1 AS support, 0 AS found, CAST(gold = predicted AS INTEGER) AS hit FROM judged UNION ALL SELECT predicted, 0, 1, 0 FROM judged),
sums AS (SELECT label, CAST(sum(support) AS BIGINT) AS support, sum(found) AS found, sum(hit) AS hit FROM sides GROUP BY label),
pr AS (SELECT label, support, CASE WHEN found > 0 THEN CAST(hit AS DOUBLE) / found ELSE 0 END AS p, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS r FROM sums),
classes AS (SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr)"""
_SCORED = f"""{_OVERLAP}, top10 AS (SELECT * FROM found WHERE rank <= 10),
three AS (SELECT doc_id, section, sentence, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, section, sentence, {tokens('text')} AS w FROM passages) WHERE len(w) >= 3),
phrases AS (SELECT item_id AS query_id, array_to_string({tokens('text')}[1:3], ' ') AS phrase FROM benchmark),
gold AS (SELECT DISTINCT query_id, doc_id, section, sentence FROM three JOIN phrases ON array_to_string(w[i:i + 2], ' ') = phrase),
relevant AS (SELECT DISTINCT t.query_id, rank FROM top10 t JOIN gold g ON t.query_id = g.query_id AND t.doc_id = g.doc_id AND t.section = g.section AND g.sentence BETWEEN t.sentence - 1 AND t.sentence + 1),
firsts AS (SELECT query_id, min(rank) AS first_rank, sum(1 / log2(rank + 1)) AS dcg FROM relevant GROUP BY ALL),
labelled AS (SELECT query_id, least(count(*), 10) AS k FROM gold GROUP BY ALL),
ideal AS (SELECT query_id, sum(1 / log2(i + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, k + 1)) AS i FROM labelled) GROUP BY ALL),
per_query AS (SELECT q.query_id, CASE WHEN q.n > 20 THEN 'long' ELSE 'short' END AS category, l.k IS NOT NULL AS answerable, t.query_id IS NULL AS abstained, first_rank, CASE WHEN l.k IS NOT NULL THEN least(1.0::DOUBLE, coalesce(dcg, 0) / ideal) END AS ndcg
  FROM queries q LEFT JOIN labelled l USING (query_id) LEFT JOIN ideal USING (query_id) LEFT JOIN firsts USING (query_id) LEFT JOIN (SELECT DISTINCT query_id FROM top10) t USING (query_id))"""
_RECALL = lambda k: f"round(avg(CASE WHEN answerable THEN CAST(coalesce(first_rank <= {k}, false) AS INTEGER) END), 6)"
_MRR = "round(avg(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first_rank, 0) END), 6)"
_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_TO = lambda i, name: f"{name} AS (SELECT a.vec_id - {i} AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = {i} QUALIFY rank <= 20)"

ORACLE_SQL = {
    "postings": f'WITH {_WORDS} SELECT * FROM postings',
    "index_stats": f"WITH {_WORDS} SELECT doc_id, n_passages, round(mean_length, 6) AS mean_length FROM stats",
    "document_frequencies": f"WITH {_WORDS} SELECT * FROM df",
    "vocabulary": f"WITH {_WORDS} SELECT DISTINCT doc_id, term FROM postings",
    "distinct_terms": f"WITH {_WORDS} SELECT doc_id, count(DISTINCT term) AS n_terms FROM postings GROUP BY ALL",
    "bm25": f"WITH {_BM} SELECT * FROM bm",
    "all_terms_filter": f"WITH {_TOKENED} SELECT doc_id, citation FROM tokened WHERE list_has_all(w, [{quoted(SOME)}])",
    "any_terms_filter": f"WITH {_TOKENED} SELECT doc_id, citation FROM tokened WHERE list_has_any(w, [{quoted(RARE)}])",
    "excluded_terms": f"WITH {_TOKENED} SELECT doc_id, citation FROM tokened WHERE list_contains(w, 'the') AND NOT list_has_any(w, ['of', 'and'])",
    "phrase_search": f"WITH {_TOKENED} SELECT doc_id, citation FROM tokened WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')",
    "prefix_search": f"WITH {_TOKENED} SELECT doc_id, citation FROM tokened WHERE len(list_filter(w, lambda x: starts_with(x, 'thst'))) > 0",
    "near_search": f"WITH {_TOKENED}, places AS (SELECT doc_id, section, sentence, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM tokened) SELECT DISTINCT doc_id, section, sentence FROM places a JOIN places b USING (doc_id, section, sentence) WHERE a.term = 'thing' AND b.term = 'with' AND abs(a.p - b.p) - 1 <= 8",
    "scoped_passages": f"WITH {PASSAGES} SELECT doc_id, citation FROM passages WHERE section = 1",
    "find_substring": f"WITH {PASSAGES} SELECT doc_id, citation FROM passages WHERE contains(strip_accents(lower(text)), 'nasta') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY section, sentence) <= 5000",
    "search_overlap": f"WITH {_OVERLAP} SELECT query_id, rank, doc_id, section, sentence, citation, match, matched, score FROM found WHERE rank <= 100",
    "question_checks": f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT CAST(-floor(item_id / 10.0) - 1 AS BIGINT), string_agg(text, ' ' ORDER BY item_id) FROM benchmark GROUP BY 1)
      SELECT query_id, length(text) AS n_letters, CASE WHEN length(text) > 500 THEN 'refused' WHEN len({content(tokens("text"), 2)}) = 0 THEN 'without terms' ELSE 'asked' END AS status FROM q""",
    "tier_union": f"WITH {_TIERS} SELECT query_id, match_type, tier, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_matched FROM capped GROUP BY ALL",
    "ranked_tiers": f"WITH {_TIERS} SELECT query_id, rank, doc_id, section, sentence, match_type, coverage, score FROM best",
    "match_type_filter": f"WITH {_TIERS} SELECT query_id, rank, doc_id, section, sentence FROM best WHERE match_type = 'exact'",
    "greedy_diversity": f"""WITH RECURSIVE {_TIERS},
      cands AS (SELECT query_id, list({{'doc_id': doc_id, 'section': section, 'sentence': sentence, 'score': score, 'rank': rank}} ORDER BY rank) AS c FROM ranked WHERE rank <= 100 GROUP BY query_id),
      picked AS (SELECT query_id, 0 AS pick, c AS c, c[1:0] AS p FROM cands UNION ALL SELECT query_id, pick + 1, c, list_append(p, best.x) FROM (SELECT query_id, pick, c, p, list_reverse_sort(list_transform(
        list_filter(c, lambda x: len(list_filter(p, lambda y: y.doc_id = x.doc_id AND y.section = x.section AND abs(y.sentence - x.sentence) <= 1)) = 0),
        lambda x: {{'value': x.score - 0.08::DOUBLE * len(list_filter(p, lambda y: y.doc_id = x.doc_id AND y.section = x.section)), 'early': -x.rank, 'x': x}}))[1] AS best FROM picked WHERE pick < 8) WHERE best IS NOT NULL)
      SELECT query_id, pick, x.doc_id AS doc_id, x.section AS section, x.sentence AS sentence, x.score AS score FROM (SELECT query_id, unnest(p) AS x, generate_subscripts(p, 1) AS pick FROM (SELECT query_id, p FROM picked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pick DESC) = 1))""",
    "answer_passages": f"WITH {_TIERS} SELECT query_id, CASE WHEN n > 0 THEN 'supported' ELSE 'no supporting passage found' END AS status, n AS n_passages FROM (SELECT query_id, CAST(sum(CAST(coverage >= 0.8 AND match_type = 'exact' AND rank <= 5 AS INTEGER)) AS BIGINT) AS n FROM best GROUP BY ALL)",
    "fuzzy_blocks": f"WITH {_FUZZY} SELECT term, count(*) AS n FROM blocks GROUP BY ALL",
    "closest_terms": f"""WITH RECURSIVE {_FUZZY},
      parts AS (SELECT term, candidate, candidate AS a, term AS b, {_RUN("candidate", "term")} AS r FROM blocks UNION ALL SELECT term, candidate, p.a, p.b, {_RUN("p.a", "p.b")} FROM (
        SELECT term, candidate, unnest([{{'a': left(a, r.a - 1), 'b': left(b, r.b - 1)}}, {{'a': substring(a, r.a + r.size), 'b': substring(b, r.b + r.size)}}]) AS p FROM (SELECT term, candidate, a, b, {{'size': r.size, 'a': -r.a, 'b': -r.b}} AS r FROM parts WHERE r IS NOT NULL)) WHERE p.a <> '' AND p.b <> ''),
      rated AS (SELECT term, candidate, CAST(2 * sum(coalesce(r.size, 0)) AS DOUBLE) / (length(term) + length(candidate)) AS s FROM parts GROUP BY term, candidate)
      SELECT term, candidate, round(s, 6) AS similarity FROM rated WHERE s >= 0.78::DOUBLE QUALIFY row_number() OVER (PARTITION BY term ORDER BY s DESC, candidate DESC) = 1""",
    "summaries": f"""WITH {_TOKENED}, base AS (SELECT *, {content('w')} AS terms FROM tokened), s AS (SELECT doc_id, section, count(*) AS s FROM base GROUP BY ALL),
      f AS (SELECT doc_id, section, sentence, term, count(*) AS f FROM (SELECT doc_id, section, sentence, unnest(terms) AS term FROM base) GROUP BY ALL),
      c AS (SELECT doc_id, section, term, count(*) AS c FROM f GROUP BY ALL),
      sums AS (SELECT doc_id, section, sentence, sum((1 + ln(f)) * ln(1 + CAST(s AS DOUBLE) / (1 + c))) AS x, sum(f) AS n FROM f JOIN c USING (doc_id, section, term) JOIN s USING (doc_id, section) GROUP BY ALL),
      scored AS (SELECT doc_id, section, sentence, text, round(coalesce(x / sqrt(greatest(n, 1)), 0), 6) AS score FROM base LEFT JOIN sums USING (doc_id, section, sentence) WHERE len(w) >= 5),
      once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, section, text ORDER BY score DESC, sentence) = 1)
      SELECT doc_id, section, sentence, text, score FROM once QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, sentence) <= 3""",
    "entities": f"""WITH {PASSAGES}, names AS (SELECT doc_id, citation, unnest(list_distinct(regexp_extract_all(text, '{_NAMES}'))) AS term FROM passages),
      kept AS (SELECT * FROM names WHERE length(term) > 2 AND NOT list_contains({STOP}, lower(term))),
      sums AS (SELECT doc_id, term, count(*) AS count, array_to_string(list_sort(list(citation))[1:30], ',') AS passages FROM kept GROUP BY ALL) SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) <= 20""",
    "keywords": f"""WITH {PASSAGES}, words AS (SELECT doc_id, section, unnest(list_distinct({content(tokens('text'), 4)})) AS term FROM passages),
      sums AS (SELECT doc_id, term, count(*) AS count, count(DISTINCT section) AS n_sections FROM words GROUP BY ALL) SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) <= 20""",
    "quotes": f"""WITH {PASSAGES}, q AS (SELECT doc_id, section, sentence, citation, unnest(regexp_extract_all(text, '“[^”]+”|«[^»]+»|"[^"\\n]+"')) AS quote FROM passages) SELECT doc_id, citation, quote FROM q""",
    "repetitions": f"""WITH {_TOKENED}, r AS (SELECT doc_id, array_to_string(w, ' ') AS tokens, count(*) AS count, min((section, sentence)) AS f FROM tokened WHERE len(w) >= 8 GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, tokens, count, f[1] AS section, f[2] AS sentence FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, tokens) <= 50""",
    "corpus_repetitions": f"WITH {_TOKENED} SELECT array_to_string(w, ' ') AS tokens, count(*) AS count, min(doc_id) AS doc_id FROM tokened WHERE len(w) >= 8 GROUP BY ALL HAVING count(*) > 1 ORDER BY count DESC, tokens LIMIT 50",
    "speakers": f"""WITH {PASSAGES}, s AS (SELECT regexp_matches(text, '[“”«»"]|^[—–]') AS dialogue, nullif(regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}])(?:said|asked|replied|whispered|shouted|dijo|preguntó|respondió|susurró|gritó)\\s+(\\p{{Lu}}\\p{{Ll}}+(?:[- ]\\p{{Lu}}\\p{{Ll}}+)?)', 1), '') AS a,
      nullif(regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}])(\\p{{Lu}}\\p{{Ll}}+(?:[- ]\\p{{Lu}}\\p{{Ll}}+)?)\\s+(?:said|asked|replied|whispered|shouted|dijo|preguntó|respondió|susurró|gritó)(?:$|[^\\p{{L}}\\p{{N}}])', 1), '') AS b FROM passages)
      SELECT CASE WHEN dialogue THEN coalesce(a, b, 'Dialogue') ELSE 'Narrator' END AS speaker, count(*) AS n FROM s GROUP BY ALL""",
    "character_counts": """WITH n AS (SELECT role, conv_id, turn, regexp_extract(text, '^(\\p{Lu}\\p{Ll}+)', 1) AS name FROM conversations),
      s AS (SELECT role, name, count(*) AS count, min((conv_id, turn)) AS f FROM n WHERE name <> '' AND length(name) <= 50 AND name NOT IN ('The', 'This', 'That', 'He', 'She', 'They', 'El', 'Ella', 'Él', 'Los', 'La', 'It', 'I', 'We', 'You') GROUP BY ALL)
      SELECT role, name, count, f[1] AS conv_id, f[2] AS turn FROM s QUALIFY row_number() OVER (PARTITION BY role ORDER BY count DESC, name) <= 20""",
    "cosine_topk": f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COSINE}, 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {_COSINE} >= 0.2 QUALIFY rank <= 20",
    "normalized_vectors": "SELECT vec_id, round(n, 5) AS norm, CAST(1 AS DOUBLE) AS unit_norm, round(CAST(embedding[1] AS DOUBLE) / n, 5) AS first FROM (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
    "pooled_vectors": "SELECT label, vec_id % 16 AS part, round(avg(CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[1] AS DOUBLE) END), 5) AS first, round(avg(CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[64] AS DOUBLE) END), 5) AS last FROM embeddings GROUP BY ALL",
    "rrf_fusion": f"WITH {_TO(0, 'a')}, {_TO(1, 'b')} SELECT query_id, vec_id, a.rank AS rank_a, b.rank AS rank_b, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf FROM a FULL JOIN b USING (query_id, vec_id)",
    "hybrid_ranks": f"""WITH {_OVERLAP}, a AS (SELECT * FROM found WHERE rank <= 20), known AS (SELECT doc_id, section, sentence, embedding FROM passages JOIN embeddings ON doc_id = vec_id AND citation = '0000-00000' AND label % 2 = 0),
      b AS (SELECT a.vec_id AS query_id, b.doc_id, b.section, b.sentence, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 6) DESC, b.doc_id) AS rank FROM embeddings a JOIN benchmark ON item_id = a.vec_id, known b QUALIFY rank <= 20),
      f AS (SELECT query_id, doc_id, section, sentence, a.rank AS x, b.rank AS y, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM a FULL JOIN b USING (query_id, doc_id, section, sentence))
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id, section, sentence) AS rank, doc_id, section, sentence, CASE WHEN y IS NULL THEN 'lexical' WHEN x IS NULL THEN 'semantic' ELSE 'both' END AS source FROM f QUALIFY rank <= 8""",
    "confusion": f"WITH {_JUDGED} SELECT gold, predicted, count(*) AS n FROM judged GROUP BY ALL",
    "class_scores": f"WITH {_CLASSES} SELECT * FROM classes",
    "overall_scores": f"WITH {_CLASSES} SELECT (SELECT round(avg(CAST(gold = predicted AS INTEGER)), 6) FROM judged) AS accuracy, (SELECT count(*) FROM judged) AS n, (SELECT round(avg(f1), 6) FROM classes) AS macro_f1",
    "calibration": f"WITH {_JUDGED} SELECT level, count(*) AS n, round(avg(CAST(gold = predicted AS INTEGER)), 6) AS accuracy FROM judged GROUP BY ALL",
    "retrieval_metrics": f"WITH {_SCORED} SELECT count(*) AS n, {_RECALL(1)} AS recall_1, {_RECALL(5)} AS recall_5, {_RECALL(10)} AS recall_10, {_MRR} AS mrr, round(avg(ndcg), 6) AS ndcg_10, CAST(CASE WHEN sum(CAST(abstained AS INTEGER)) > 0 THEN round(sum(CAST(abstained AND NOT answerable AS INTEGER)) * 1.0::DOUBLE / sum(CAST(abstained AS INTEGER)), 6) ELSE 0 END AS DOUBLE) AS abstain_precision, CAST(CASE WHEN sum(CAST(NOT answerable AS INTEGER)) > 0 THEN round(sum(CAST(abstained AND NOT answerable AS INTEGER)) * 1.0::DOUBLE / sum(CAST(NOT answerable AS INTEGER)), 6) ELSE 0 END AS DOUBLE) AS abstain_recall FROM per_query",
    "metrics_by_category": f"WITH {_SCORED} SELECT category, count(*) AS n, {_RECALL(5)} AS recall_5, {_MRR} AS mrr FROM per_query GROUP BY ALL",
}

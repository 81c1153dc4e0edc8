"""Search for many queries at once: by overlap, in tiers, and together with vectors.

Queries are a table: query_id, terms, and for tiers also required, excluded, prefixes (arrays of folded tokens) and
phrases (an array of strings of folded tokens). Queries travel to the postings; postings are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.snowball import with_stems
from leafmill.functions.text import content_terms, tokens
from leafmill.operators.filters import all_terms, any_terms
from leafmill.operators.index import closest_terms, fuzzy_blocks, hinted
from leafmill.operators.passages import with_context
from leafmill.operators.stored import hits_of, known_terms, term_lists

#: Points of a tier.
TIERS = {"phrase": 40, "exact": 40, "stem": 30, "partial": 20, "fuzzy": 10}
_PLACE = ["section", "sentence"]


def question_checks(rows: DataFrame, key: str, text: str, letters: int = 500) -> DataFrame:
    """(query_id, n_letters, status) of each question: asked, without terms, or refused, as one of more than so many letters
    is; it isn't cut. Null counts as empty."""
    n = F.coalesce(F.length(text), F.lit(0))
    found = F.size(content_terms(tokens(F.coalesce(text, F.lit(""))), least=2))
    return rows.select(F.col(key).alias("query_id"), n.alias("n_letters"), F.when(n > letters, "refused").when(found == 0, "without terms").otherwise("asked").alias("status"))


def as_queries(rows: DataFrame, key: str, text: str, letters: int = 500, terms: int = 24, least: int = 2) -> DataFrame:
    """(query_id, terms): the distinct content terms of a question, the first 24 of them. Questions of more than `letters`
    are refused, and those without terms ask for nothing; question_checks tells both."""
    found = content_terms(tokens(F.col(text)), least=least)
    asked = rows.filter(F.length(text) <= letters)
    return asked.select(F.col(key).alias("query_id"), F.slice(F.array_distinct(found), 1, terms).alias("terms")).filter(F.size("terms") > 0)


def embedded(passages: DataFrame, vectors: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """passages with the vector that one model has made of each, by citation; passages without one are left out."""
    made = vectors.filter(F.col("model") == model).select(key, "citation", "embedding")
    return passages.join(made, [key, "citation"])


def search_overlap(passages: DataFrame, queries: DataFrame, key: str = "doc_id", most: int = 100, least: int = 2) -> DataFrame:
    """(query_id, rank, key, section, sentence, citation, match, matched, score): passages by the terms that they share
    with a query. All of them: 100 and their number; else 20 and the share. Passages that have none are no hits."""
    words = passages.select(key, *_PLACE, "citation", F.explode(F.array_distinct(content_terms(tokens(F.col("text")), least=least))).alias("term"))
    asked, hint = queries.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")), hinted(queries)
    hits = words.join(hint(asked), "term").groupBy("query_id", "n", key, *_PLACE, "citation").agg(F.count(F.lit(1)).alias("matched"))
    exact = F.col("matched") == F.col("n")
    score = F.when(exact, 100.0 + F.col("matched")).otherwise(F.round(20.0 + F.col("matched") / F.col("n"), 6))
    scored = hits.select("query_id", key, *_PLACE, "citation", F.when(exact, "exact").otherwise("partial").alias("match"), "matched", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key, *_PLACE))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


_OPERATORS = ("required", "excluded", "prefixes", "phrases")


def _none() -> Column:
    return F.array().cast("array<string>")


def _with_defaults(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "terms", *[(F.col(c) if c in queries.columns else _none()).alias(c) for c in _OPERATORS])


def _bit(position: Column) -> Column:
    """The bit of a place in an array, from 1; none for 0."""
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def _expanded(asked: DataFrame, terms: DataFrame, stems: bool, language: Column | str) -> DataFrame:
    """(query_id, term, asked, surface, own): the index's terms that answer each asked one: itself, what a prefix leads, and
    those of its stem. own marks the term itself, which counts for BM25."""
    pairs = asked.select("query_id", F.explode(F.array_distinct(F.concat("terms", "required"))).alias("term"))
    flags = lambda surface, own: (F.lit(surface).alias("surface"), F.lit(own).alias("own"))
    out = pairs.select("query_id", "term", F.col("term").alias("asked"), *flags(True, True))
    if "prefixes" in asked.columns:
        starts = asked.select("query_id", F.explode("prefixes").alias("start"))
        led = terms.join(starts, (F.left("term", F.lit(1)) == F.left("start", F.lit(1))) & F.col("term").startswith(F.col("start")))
        out = out.unionByName(led.select("query_id", "term", F.col("start").alias("asked"), *flags(True, False)))
    if stems:
        of_stem = with_stems(terms, language=language).join(with_stems(pairs, language=language).withColumnRenamed("term", "asked"), "stem")
        out = out.unionByName(of_stem.select("query_id", "term", "asked", *flags(False, False)))
    return out


def _fulfilled(rows: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """rows without those of queries whose phrases or excluded terms the passage lacks or has; only these are looked up."""
    if not {"phrases", "excluded"} & set(rows.columns):
        return rows
    has = lambda c: F.size(c) > 0 if c in rows.columns else F.lit(False)
    strict = has("phrases") | has("excluded")
    words = passages.select(key, *_PLACE, tokens(F.concat_ws(" ", "text", "title")).alias("tokens"))
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    ok = F.lit(True)
    if "phrases" in rows.columns:
        ok = ok & F.forall("phrases", lambda p: F.contains(spaced(F.array_join("tokens", " ")), spaced(p)))
    if "excluded" in rows.columns:
        ok = ok & ~any_terms(F.col("tokens"), F.col("excluded"))
    return rows.filter(~strict).unionByName(rows.filter(strict).join(words, [key, *_PLACE]).filter(ok).drop("tokens"))


def tier_candidates(passages: DataFrame, queries: DataFrame, key: str = "doc_id", stems: bool = True, fuzzy: bool = True, cap: int = 160, language: Column | str = "en", lists: DataFrame | None = None) -> DataFrame:
    """(query_id, key, section, sentence, match_type, tier, matched, coverage, bm25), the best tier of each passage.

    exact: all terms; stem: all stems; partial: some terms or, a point lower, some stems; fuzzy: where a query without
    operators has no hit at all, with each term of four letters or more changed into the closest one. Required terms and
    phrases must be there and excluded terms mustn't. The `cap` best of a tier by BM25 go on, for each query. lists is the
    index of the passages, stored or not; without it one is made. Hits are summed up and ranked in their buckets.
    """
    lists = term_lists(passages, key) if lists is None else lists
    given, hint = [c for c in _OPERATORS if c in queries.columns], hinted(queries)
    asked = queries.select("query_id", *[F.coalesce(c, _none()).alias(c) for c in ("terms", *given)]).filter(F.size("terms") > 0)
    whole = _with_defaults(asked)
    # A bit for each asked word of a query: what a passage has of them is one number, by the words themselves and by all means.
    wanted = F.array_distinct(F.concat("terms", "required"))
    mask = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, w: n.bitwiseOR(_bit(F.array_position("wanted", w))))
    masks = whole.withColumn("wanted", wanted).select("query_id", "wanted", mask(F.col("terms")).alias("all_terms"), mask(F.col("required")).alias("must"), F.size("terms").alias("n"))
    masks = masks.withColumn("wanted", F.when(F.size("wanted") <= 62, F.col("wanted")).otherwise(F.raise_error(F.lit("a query has at most 62 terms"))))
    ways = _expanded(whole.select("query_id", "terms", "required", *[c for c in given if c == "prefixes"]), known_terms(lists), stems, language)
    ways = ways.join(masks.select("query_id", "wanted"), "query_id").select("query_id", "term", "surface", "own", _bit(F.array_position("wanted", F.col("asked"))).alias("bit"))
    place = ["bucket", "query_id", key, *_PLACE]
    best = hits_of(lists, hint(ways), key).groupBy(*place).agg(F.bit_or(F.when(F.col("surface"), F.col("bit")).otherwise(0)).alias("plain"), F.bit_or("bit").alias("any"), F.round(F.sum(F.when(F.col("own"), F.col("impact")).otherwise(0.0)), 6).alias("bm25"))
    rows = _fulfilled(best.join(hint(masks.select("query_id", "all_terms", "must", "n").join(asked.select("query_id", *[c for c in given if c in ("phrases", "excluded")]), "query_id")), "query_id"), passages, key)
    phrases = F.size("phrases") if "phrases" in given else F.lit(0)
    has = lambda bits, c: F.col(bits).bitwiseAND(F.col(c)) == F.col(c)
    all_plain = has("plain", "all_terms") & has("plain", "must")
    some_plain = (F.col("plain").bitwiseAND(F.col("all_terms")) != 0) & has("plain", "must")
    match = F.when(all_plain & (phrases > 0), "phrase").when(all_plain, "exact").when(has("any", "all_terms"), "stem").otherwise("partial")
    rows = rows.filter(has("any", "must")).withColumn("match_type", match)
    by_surface = F.col("match_type").isin("phrase", "exact") | (F.col("match_type") == "partial") & some_plain
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("match_type")] - F.when((F.col("match_type") == "partial") & ~some_plain, 1).otherwise(0)
    bits = F.when(by_surface, F.col("plain")).otherwise(F.col("any")).bitwiseAND(F.col("all_terms"))
    found = rows.select(*place, "match_type", tier.alias("tier"), bits.alias("bits"), "n", phrases.alias("n_phrases"), "bm25")
    if fuzzy:
        found = found.unionByName(_fuzzy(whole, found, lists, key))
    scored = found.withColumn("coverage", F.round(F.bit_count("bits") / F.col("n"), 6))
    best_of = lambda *within: F.row_number().over(Window.partitionBy(*within, "query_id", "tier").orderBy(F.desc("bm25"), key, *_PLACE)) <= cap
    for within in (["bucket"], []):  # the best of each bucket, then of all
        scored = scored.withColumn("_good", best_of(*within)).filter("_good").drop("_good")
    terms = F.array_distinct("terms")  # they come first among what is wanted, so their bits are the first ones
    matched = F.filter(F.col("terms"), lambda w: F.col("bits").bitwiseAND(_bit(F.array_position(terms, w))) != 0)
    scored = scored.join(hint(whole.select("query_id", "terms")), "query_id").withColumn("matched", F.array_distinct(matched))
    return scored.select("query_id", key, *_PLACE, "match_type", "tier", "matched", "n_phrases", "bm25", "coverage")


def _fuzzy(asked: DataFrame, found: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Hits of corrected queries, for queries without operators and without hits. Corrected terms are none of the query's
    own, so they count nothing for BM25."""
    plain = asked.filter(F.size(F.concat(*_OPERATORS)) == 0)
    lost = plain.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("asked"))
    close = closest_terms(fuzzy_blocks(lost.withColumnRenamed("asked", "term"), known_terms(lists)))
    fixed = lost.join(close.withColumnRenamed("term", "asked"), "asked").select("query_id", "n", "asked", F.col("candidate").alias("term"))
    place = ["bucket", "query_id", key, *_PLACE]
    hits = hits_of(lists, fixed, key).groupBy(*place, "n").agg(F.countDistinct("asked").alias("has"))
    every = (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1).alias("bits")
    return hits.filter(F.col("has") == F.col("n")).select(*place, F.lit("fuzzy").alias("match_type"), F.lit(TIERS["fuzzy"]).alias("tier"), every, "n", F.lit(0).alias("n_phrases"), F.lit(0.0).alias("bm25"))


def rank_hits(candidates: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """candidates with score and rank: tier + coverage + 0.2 for each phrase + 0.1 * min(1, bm25), the `most` best."""
    score = F.round(F.col("tier") + F.col("coverage") + 0.2 * F.col("n_phrases") + 0.1 * F.least(F.lit(1.0), F.abs("bm25")), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key, *_PLACE)
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def diverse_hits(ranked: DataFrame, key: str = "doc_id", most: int = 8, penalty: float = 0.08, span: int = 1) -> DataFrame:
    """(query_id, pick, key, section, sentence, score): `most` hits of each query, picked so that they spread.

    Each pick is the hit that costs least: its score, negated, plus a penalty for each pick that its section already has.
    Sentences up to `span` from a pick are out. Ties go by score, then by place. ranked holds a bounded list for each query.
    """
    place = [key, *_PLACE]
    kind = f"array<struct<cost:double,low:double,{','.join(f'{c}:{ranked.schema[c].dataType.simpleString()}' for c in place)}>>"
    section = lambda p, c: (p[key] == c[key]) & (p["section"] == c["section"])
    near = lambda p, c: section(p, c) & (F.abs(p["sentence"] - c["sentence"]) <= span)

    def pick(picks: Column, hits: Column) -> Column:
        free = F.filter(hits, lambda c: ~F.exists(picks, lambda p: near(p, c)))
        rated = F.transform(free, lambda c: F.struct((c["low"] + penalty * F.size(F.filter(picks, lambda p: section(p, c)))).alias("cost"), c["low"], *[c[x] for x in place]))
        return F.concat(picks, F.slice(F.array_sort(rated), 1, 1)).cast(kind)

    lists = ranked.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score").cast("double")).alias("low"), *place)).alias("hits"))
    picks = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array().cast(kind), lambda done, _: pick(done, F.col("hits")))
    out = lists.select("query_id", F.posexplode(picks).alias("at", "p"))
    return out.select("query_id", (F.col("at") + 1).alias("pick"), *[F.col(f"p.{c}").alias(c) for c in place], (-F.col("p.low")).alias("score"))


def search_tiered(passages: DataFrame, queries: DataFrame, key: str = "doc_id", most: int = 8, language: Column | str = "en", pool: int = 800, lists: DataFrame | None = None) -> DataFrame:
    """Diverse hits of each query with text, context, match_type, matched and coverage. Queries without terms have none."""
    ranked = rank_hits(tier_candidates(passages, queries, key, language=language, lists=lists), key, pool)
    picked = diverse_hits(ranked, key, most)
    facts = ranked.select("query_id", key, *_PLACE, "match_type", "matched", "coverage", "bm25")
    sections = hinted(queries)(picked.select(F.col(key).alias("_key"), F.col("section").alias("_section")).distinct())  # only theirs are looked up
    near = passages.join(sections, (F.col(key) == F.col("_key")) & (F.col("section") == F.col("_section")), "left_semi")
    shown = with_context(near, key).select(key, *_PLACE, "citation", "text", "context", "context_start", "context_end")
    return picked.join(facts, ["query_id", key, *_PLACE]).join(shown, [key, *_PLACE])


def answer_passages(hits: DataFrame, least: float = 0.8, first: int = 5) -> DataFrame:
    """(query_id, status, n_passages): supported if one of the first hits covers enough of the query, and not by parts."""
    good = (F.col("coverage") >= least) & F.col("match_type").isin("exact", "phrase", "stem") & (F.col("rank") <= first)
    n = F.sum(good.cast("int"))
    return hits.groupBy("query_id").agg(F.when(n > 0, "supported").otherwise("no supporting passage found").alias("status"), n.alias("n_passages"))


def fuse(a: DataFrame, b: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """(keys, rank_a, rank_b, rrf): reciprocal-rank fusion of two lists with a column rank."""
    both = a.select(*keys, F.col("rank").alias("rank_a")).join(b.select(*keys, F.col("rank").alias("rank_b")), keys, "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", F.round(part("rank_a") + part("rank_b"), 9))


def hybrid_search(lexical: DataFrame, semantic: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """(query_id, rank, key, section, sentence, source, rrf): both lists fused; source says which of them has a hit."""
    fused = fuse(lexical, semantic, ["query_id", key, *_PLACE])
    source = F.when(F.col("rank_b").isNull(), "lexical").when(F.col("rank_a").isNull(), "semantic").otherwise("both")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), key, *_PLACE))
    return fused.withColumns({"source": source, "rank": rank}).filter(F.col("rank") <= most)

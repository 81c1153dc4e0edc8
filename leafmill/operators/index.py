"""The inverted index of passages: postings, statistics, BM25, and what changed since the index was made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import STOPWORDS, signature, tokens

#: What a hit in a column counts.
WEIGHTS = {"surface": 1.0, "title": 1.6, "stems": 0.5}


def postings(passages: DataFrame, key: str = "doc_id", stopwords: tuple[str, ...] = STOPWORDS, columns: tuple[str, ...] = ("surface", "title")) -> DataFrame:
    """(key, section, sentence, column, term, tf, positions): how often and where a passage's column has a term.

    Stopwords have no rows, so their long lists are never shuffled; they still count in positions.
    """
    source = {"surface": "text", "title": "title"}
    parts = [passages.select(key, "section", "sentence", F.lit(c).alias("column"), F.posexplode(tokens(F.col(source[c]))).alias("position", "term")) for c in columns]
    words = parts[0]
    for more in parts[1:]:
        words = words.unionByName(more)
    words = words.filter(~F.col("term").isin(*stopwords)) if stopwords else words
    return words.groupBy(key, "section", "sentence", "column", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def lengths(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, sentence, length): tokens in all columns of a passage."""
    return passages.select(key, "section", "sentence", (F.size(tokens(F.col("text"))) + F.size(tokens(F.col("title")))).alias("length"))


def statistics(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_passages, mean_length) of each document."""
    return lengths(passages, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_passages"), F.avg("length").alias("mean_length"))


def document_frequencies(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, df): passages of a document that have a term in any column."""
    return index.select(key, "section", "sentence", "term").distinct().groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term): the distinct terms of each document."""
    return index.select(key, "term").distinct()


def hinted(queries: DataFrame, most: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """What to do with tables made of queries, a few rows for each: broadcast them if a count finds at most so many queries,
    else leave the join to the optimizer."""
    return F.broadcast if queries.limit(most + 1).count() <= most else lambda rows: rows


def index_diff(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of passages with a hash in either table: insert, update, delete or unchanged."""
    old, new = stored.select(*keys, F.col("hash").alias("old")), current.select(*keys, F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("unchanged")
    return old.join(new, keys, "full_outer").select(*keys, change.alias("change"))


def with_hash(passages: DataFrame, *settings: Column) -> DataFrame:
    return passages.withColumn("hash", signature(F.col("text"), F.col("title"), *settings))


def index_status(current: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status) of each document with a fingerprint: missing, stale or ready."""
    both = current.select(key, F.col("fingerprint").alias("now")).join(stored.select(key, F.col("fingerprint").alias("then")), key, "left")
    return both.select(key, F.when(F.col("then").isNull(), "missing").when(F.col("then") != F.col("now"), "stale").otherwise("ready").alias("status"))


def fuzzy_blocks(terms: DataFrame, vocabulary: DataFrame, term: str = "term", least: int = 4, band: int = 2) -> DataFrame:
    """(term, candidate) pairs that share the first or last letter and differ by at most `band` in length.

    Blocks are (first or last letter, length), so the join is on equality; each term looks into 2 * band + 1 lengths.
    """
    asked = terms.select(F.col(term).alias("term")).distinct().filter(F.length("term") >= least)
    known = vocabulary.select(F.col(term).alias("candidate")).distinct()

    def ends(df: DataFrame, name: str, sizes: Column) -> DataFrame:
        letters = F.array(F.concat(F.lit("<"), F.substring(name, 1, 1)), F.concat(F.lit(">"), F.substring(name, -1, 1)))
        return df.select(name, F.explode(letters).alias("letter"), sizes.alias("size"))

    wide = ends(asked, "term", F.explode(F.sequence(F.length("term") - band, F.length("term") + band)))
    return wide.join(ends(known, "candidate", F.length("candidate")), ["letter", "size"]).select("term", "candidate").distinct()


def block_similarity(a: Column, b: Column) -> Column:
    """2 M / (length of a + length of b), M being the letters in matching blocks: the longest run that both words have, then
    likewise in what stands before it in both, and behind it in both. Of runs of that length it is the first one in a, and
    there the first in b. Words of some dozens of letters are meant.
    """
    pair = "array<struct<a:string,b:string>>"
    kind = f"struct<todo:{pair},same:int>"

    def longest(x: Column) -> Column:
        """(size, a, b): the longest common run of x.a and x.b, and where it begins in each, from 1; null without one."""
        most = F.least(F.length(x["a"]), F.length(x["b"]))
        of_size = lambda n: F.transform(F.sequence(F.lit(1), F.length(x["a"]) - n + 1), lambda i: F.struct(n.alias("size"), i.alias("a"), F.instr(x["b"], F.substring(x["a"], i, n)).alias("b")))
        runs = F.flatten(F.transform(F.sequence(most, F.lit(1), F.lit(-1)), of_size))
        return F.when(most > 0, F.get(F.filter(runs, lambda r: r["b"] > 0), F.lit(0)))

    def split(done: Column, x: Column, r: Column) -> Column:
        behind = lambda w, at: F.substring(x[w], at + r["size"], F.length(x[w]))
        parts = F.array(F.struct(F.left(x["a"], r["a"] - 1).alias("a"), F.left(x["b"], r["b"] - 1).alias("b")), F.struct(behind("a", r["a"]).alias("a"), behind("b", r["b"]).alias("b")))
        more = F.filter(parts, lambda p: (p["a"] != "") & (p["b"] != ""))
        rest = F.slice(done["todo"], 2, F.size(done["todo"]))
        return F.when(r.isNull(), F.struct(rest.alias("todo"), done["same"].alias("same")).cast(kind)).otherwise(F.struct(F.concat(more, rest).alias("todo"), (done["same"] + r["size"]).alias("same")).cast(kind))

    def step(done: Column) -> Column:
        x = done["todo"][0]
        return F.when(F.size(done["todo"]) == 0, done).otherwise(F.element_at(F.transform(F.array(longest(x)), lambda r: split(done, x, r)), 1))

    start = F.struct(F.array(F.struct(a.alias("a"), b.alias("b"))).alias("todo"), F.lit(0).alias("same")).cast(kind)
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)  # each run leaves two parts at most
    return 2 * F.aggregate(steps, start, lambda done, _: step(done), lambda done: done["same"]) / (F.length(a) + F.length(b))


def closest_terms(blocks: DataFrame, least: float = 0.78) -> DataFrame:
    """(term, candidate, similarity): of the candidates of each term that are at least so similar by matching blocks the
    most similar one, and of several the last in the order of letters.

    Each letter matches as often as both words have it at most; pairs that this keeps below the bound aren't compared.
    """
    of = lambda word, letter: F.length(word) - F.length(F.replace(F.col(word), letter, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("candidate", "")), F.lit(0), lambda n, x: n + F.least(of("candidate", x), of("term", x)))
    # A quicker bound goes first: letters that only one of the words has.
    common = lambda x, y: F.length(x) - F.length(F.call_function("translate", F.col(x), F.col(y), F.lit("")))
    most = 2 * F.least(common("candidate", "term"), common("term", "candidate")) / (F.length("term") + F.length("candidate"))
    close = blocks.filter((most >= least) & (2 * shared / (F.length("term") + F.length("candidate")) >= least)).withColumn("similarity", block_similarity(F.col("candidate"), F.col("term"))).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", "candidate"))
    return close.groupBy("term").agg(best.alias("_best")).select("term", "_best.candidate", F.round("_best.similarity", 6).alias("similarity"))

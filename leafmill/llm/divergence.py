"""How far the sources of a language differ in the words they use.

Counts of terms by language and source are made once, with each batch of texts summed up before it is shuffled, and the
vocabulary of each language is put in an order in which terms with equal counts in all sources stand together: by the count
in the language, then by a fingerprint of the counts of each source. Pieces of that order are the columns: each source has,
for each piece, its counts run-length encoded, as a run of places that share a count. Two sources are compared by
intersecting the boundaries of their runs: in each of the pieces that result, the divergence of one term times the length.

A piece of the vocabulary holds a bounded number of terms, a task a bounded number of sources of one piece (two tiles), so
neither a language nor a source with most of the corpus is held by one task. Sums over pieces give the pairs. All numbers
are whole; divisions are exact for counts below 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.store import stored
from leafmill.llm.words import NOT_LETTER, find_words, slices

#: Shares are in billionths.
UNIT = 1_000_000_000
_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and documents, a row for each slice of texts that has the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(2), 1 << 23):
                part = batch.slice(first, last - first)
                groups, of_doc = {}, []
                for group in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    of_doc.append(groups.setdefault(group, len(groups)))
                words = find_words(part.column(2), NOT_LETTER, lower=True)
                terms = words.array().dictionary_encode()
                size = max(1, len(terms.dictionary))
                in_doc, n = np.unique(words.texts() * size + terms.indices.to_numpy(), return_counts=True)
                in_group, at = np.unique(np.array(of_doc, np.int64)[in_doc // size] * size + in_doc % size, return_inverse=True)
                names = list(groups)
                owner = [names[i] for i in (in_group // size).tolist()]
                columns = [pa.array([x[k] for x in owner], pa.string()) for k in (0, 1)]
                columns += [terms.dictionary.take(pa.array(in_group % size)).cast(pa.string()), pa.array(np.bincount(at, n, len(in_group)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(in_group)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * n / total) of whole numbers below 9e15: long division, three decimal digits at a time."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def runs(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column that is zero but at places (ascending)."""
    edges = np.unique(np.concatenate([places, places + 1, [length]]))
    edges = edges[edges > 0]
    value = np.zeros(len(edges), np.int64)
    value[np.searchsorted(edges, places + 1)] = counts
    last = np.append(value[1:] != value[:-1], True)[: len(value)]
    return edges[last], value[last]


def run_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over all places of floor((p - q) ** 2 / (p + q)) of two columns of shares: one term for each intersection of runs."""
    ends = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], ends)] for x in (a, b))
    return int(((p - q) ** 2 // np.maximum(1, p + q) * np.diff(ends, prepend=0)).sum())


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10, piece: int = 1 << 14, tile: int = 32) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    Terms are maximal runs of ASCII letters and characters outside ASCII; A-Z are lower-cased. A language keeps those that
    occur in at least least_docs of its documents. A term's share in a group is 1 + floor(1e9 (n + 2) / (N + 2 V)) for n
    occurrences of it there, N of all kept terms and V kept terms; the divergence of shares p and q is
    floor((p - q)^2 / (p + q)).

    Part `pair`: for each other source of the language the sum of divergences over all kept terms, all of them ranked. Part
    `term`: the top terms of the source by divergence from the whole language, of those that it has and uses more. Ties go
    by item. Null languages, sources and texts count as ''. A source without terms has pairs, but no terms; a language that
    keeps no term has pairs of value 0; one with a single source has no pairs. Rows count each time that they repeat.
    Other columns are ignored. piece and tile bound what a task holds: terms of a column, and sources.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = stored(term_counts(plain).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.bit_xor(F.xxhash64("source", "n")).alias("like")).filter(F.col("docs") >= least_docs)
    order = terms.repartitionByRange("lang", "all", "like", "term").sortWithinPartitions("lang", "all", "like", "term").withColumn("id", F.monotonically_increasing_id())
    order = stored(order.select("lang", "term", "all", F.floor(F.col("id") / piece).alias("piece"), F.col("id").alias("place")), "vocabulary")
    whole = order.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    pieces = order.groupBy("lang", "piece").agg(F.min("place").alias("low"), F.count("*").alias("length"))

    found = counted.join(order, ["lang", "term"]).groupBy(*_GROUP, "piece").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("place", "n", "all", "term"))).alias("terms"))
    groups = plain.select(*_GROUP).distinct().join(found.groupBy(*_GROUP).agg(F.sum("total").alias("total")), _GROUP, "left").join(whole, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = stored(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")

    # Pairs: a column of runs for each group and piece of its language, laid out by tiles of sources.
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    columns = groups.join(pieces, "lang", "left").join(tiles, "lang").join(found.drop("total"), [*_GROUP, "piece"], "left").fillna(0, ["low", "length"]).fillna(-1, ["piece"])
    own = F.floor(F.col("number") / tile).cast("int")
    columns = columns.select("lang", "piece", own.alias("tile"), "source", F.col("total") + 2 * F.col("kept"), "low", "length", F.col("terms.place"), F.col("terms.n"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    columns = columns.toDF("lang", "piece", "tile", "source", "out_of", "low", "length", "places", "counts", "other").withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["tile", "source", "out_of", "low", "length"]).to_pylist()
        shares = []
        for r, places, counts in zip(rows, table["places"], table["counts"], strict=True):
            at, n = (np.array(x.values if x.is_valid else [], np.int64) for x in (places, counts))
            ends, value = runs(at - r["low"], n, r["length"])
            shares.append((ends, share(value + 2, max(1, r["out_of"]))))
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        left, right = ([i for i, r in enumerate(rows) if r["tile"] == t] for t in (one, two))
        pairs = [(i, j) for i in left for j in right if one != two or rows[i]["source"].encode() < rows[j]["source"].encode()]
        values = [run_sum(shares[i], shares[j]) if rows[i]["length"] else 0 for i, j in pairs]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(pairs), pa.string()), "source": pa.array([rows[i]["source"] for i, _ in pairs], pa.string()), "item": pa.array([rows[j]["source"] for _, j in pairs], pa.string()), "value": pa.array(values, pa.int64())})

    half = columns.groupBy("lang", "piece", "one", "two").applyInArrow(compare, "lang string, source string, item string, value long").groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("two")
    pairs = half.select("lang", "value", both).select("lang", "two.source", "two.item", "value")
    ranked = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = pairs.select(*_GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    # Terms: the counts of a group and piece stay together until what they are divided by has joined them.
    exact = lambda n, of: (F.lit(UNIT).cast("decimal(10,0)") * (F.col(n) + 2).cast("decimal(18,0)"), (F.col(of) + 2 * F.col("kept")).cast("decimal(18,0)"))
    spread = found.drop("total").join(groups, _GROUP).select(*_GROUP, "total", "lang_total", "kept", F.explode("terms").alias("t")).select(*_GROUP, "total", "lang_total", "kept", "t.term", "t.n", "t.all")
    for name, (up, down) in {"p": exact("n", "total"), "q": exact("all", "lang_total")}.items():
        spread = spread.withColumns({f"{name}_up": up, f"{name}_down": down}).withColumn(name, F.expr(f"1 + {name}_up div {name}_down"))
    more = spread.filter("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.unionByName(more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))

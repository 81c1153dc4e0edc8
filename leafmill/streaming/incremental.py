"""An index of passages that follows its documents: each batch adds what it changes.

Documents whose fingerprint is current are skipped before they are split. The passages of the others are compared with those
that were there. Only passages that differ are written and tokenised, each as one row with its postings, so that postings are
made and read without a shuffle; those that they replace, or that are gone, are noted in a small table of their own. A batch
that runs again reads what was there before it, and writes the same. Shuffle files of a step go when it has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import STOPWORDS, citation, signature, tokens
from leafmill.operators.index import with_hash
from leafmill.operators.passages import passages_of
from leafmill.streaming.jobs import BatchLog, of_last_batch, without_shuffle_files

_PLACE = ["doc_id", "section", "sentence"]
_HITS = "array<struct<column:string,term:string,positions:array<int>>>"
_TABLES = {
    "fingerprints": "doc_id long, fingerprint string",
    "passages": f"doc_id long, section int, sentence int, change string, text string, title string, length int, hits {_HITS}",
    "gone": "doc_id long, section int, sentence int",
    "changes": "batch int, change string, n long",
}


def _hits(column: str, words: Column) -> Column:
    """(column, term, positions) of the distinct words of an array that are no stopwords."""
    one = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)
    placed = F.filter(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: ~x["term"].isin(*STOPWORDS))

    def grouped(x: Column) -> Column:
        """x: sorted by term, so each term's places are a run of it."""
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.element_at(x, i)["term"] != F.get(x, i - 2)["term"]))
        run = lambda s, a, k: F.slice(x, a, F.coalesce(F.get(s, k + 1), F.size(x) + 1) - a)
        return one(starts, lambda s: F.transform(s, lambda a, k: F.struct(F.lit(column).alias("column"), F.element_at(x, a)["term"].alias("term"), F.transform(run(s, a, k), lambda e: e["at"]).alias("positions"))))

    return one(F.array_sort(placed), lambda x: F.when(F.size(x) > 0, grouped(x)).otherwise(F.array().cast(_HITS))).cast(_HITS)


def _current(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of the passages' log that no later batch has replaced or taken away."""
    later = gone.select(*[F.col(c).alias(f"_{c}") for c in (*_PLACE, "v")])
    same = F.col("v") < F.col("_v")
    for c in _PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.filter(F.col("change").isin("insert", "update")).join(later, same, "left_anti").drop("v")


def _ended(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("change").isin("update", "delete"))


class IncrementalIndex:
    """Passages, postings and statistics of documents (doc_id, text, and lang if there is one), in folders of one folder."""

    def __init__(self, spark: SparkSession, folder: str, fold: int = 64):
        self.log = {name: BatchLog(spark, f"{folder.rstrip('/')}/{name}", schema, fold) for name, schema in _TABLES.items()}

    def update(self, order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: documents of the batch replace their earlier texts, and one without a text has no passages.

        Of a document that comes twice in a batch the row counts that is last by `order`, columns of the batch; without them,
        or where they are equal, the one with the largest text. Null ids are one document.
        """

        def run(batch: DataFrame, batch_id: int) -> None:
            facts = [c for c in ("text", "lang") if c in batch.columns]
            rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [])], *facts)
            known = of_last_batch(self.log["fingerprints"].read(before=batch_id), "doc_id").select("doc_id", F.col("fingerprint").alias("_print"))
            # What is known comes as rows beside the batch's, so texts move once and null ids meet.
            docs = batch.select("doc_id", rank.alias("_r")).unionByName(known, allowMissingColumns=True).groupBy("doc_id").agg(F.max("_r").alias("_r"), F.max("_print").alias("_print"))
            docs = docs.filter(F.col("_r").isNotNull()).select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in facts], "_print").withColumn("fingerprint", signature(*map(F.col, facts)))
            changed = docs.filter(~F.col("fingerprint").eqNullSafe(F.col("_print")))
            with without_shuffle_files(batch.sparkSession, self.log["changes"].spark):
                self._differences(batch_id, changed)

        return run

    def _differences(self, batch_id: int, changed: DataFrame) -> None:
        write = lambda name, rows, current: self.log[name].write(batch_id, rows, current)
        write("fingerprints", changed, lambda rows: of_last_batch(rows, "doc_id").drop("v"))
        ids = self.log["fingerprints"].batch(batch_id).select(F.col("doc_id").alias("_id"))
        old = self._log(before=batch_id).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        side = lambda rows, name: rows.select(*_PLACE, F.struct("text", "title").alias(name))
        both = side(passages_of(changed), "new").unionByName(side(old, "old"), allowMissingColumns=True).groupBy(*_PLACE).agg(F.max("new").alias("new"), F.max("old").alias("old"))
        change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("unchanged")
        rows = both.withColumn("change", change).withColumn("new", F.when(F.col("change").isin("insert", "update"), F.col("new"))).select(*_PLACE, "change", "new.text", "new.title")
        words = rows.withColumns({"_surface": tokens(F.col("text")), "_title": tokens(F.col("title"))})
        facts = {"length": F.size("_surface") + F.size("_title"), "hits": F.concat(_hits("surface", F.col("_surface")), _hits("title", F.col("_title")))}
        has = F.col("text").isNotNull()
        write("passages", words.withColumns({k: F.when(has, v) for k, v in facts.items()}), lambda rows: _current(rows, _ended(rows)).withColumn("change", F.lit("insert")))
        made = self.log["passages"].batch(batch_id)
        write("gone", _ended(made), lambda rows: rows.filter(F.lit(False)).drop("v"))
        write("changes", made.groupBy("change").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(batch_id)), lambda rows: rows.drop("v"))

    def _log(self, before: int | None = None) -> DataFrame:
        """The passages' rows as they are after the last batch, or the last one below `before`."""
        return _current(self.log["passages"].read(before), self.log["gone"].read(before))

    def passages(self, before: int | None = None) -> DataFrame:
        """Passages as they are after the last batch, or the last one below `before`."""
        rows = self._log(before).select(*_PLACE, citation(F.col("section"), F.col("sentence")).alias("citation"), "text", "title")
        return with_hash(rows)

    def postings(self) -> DataFrame:
        """Postings of the current passages, as operators.index.postings makes them."""
        rows = self._log().select(*_PLACE, F.explode("hits").alias("_hit"))
        return rows.select(*_PLACE, "_hit.column", "_hit.term", F.size("_hit.positions").cast("long").alias("tf"), "_hit.positions")

    def frequencies(self) -> DataFrame:
        """(doc_id, term, df), as operators.index.document_frequencies."""
        terms = F.array_distinct(F.transform("hits", lambda h: h["term"]))
        return self._log().select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))

    def statistics(self) -> DataFrame:
        """(doc_id, n_passages, mean_length), as operators.index.statistics."""
        return self._log().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"), F.avg("length").alias("mean_length"))

    def changes(self) -> DataFrame:
        """(batch, change, n): passages that each batch has inserted, updated, deleted or left as they were."""
        return self.log["changes"].read().select("batch", "change", "n")

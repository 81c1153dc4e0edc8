"""Measuring classifications and searches against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, predicted, n)."""
    return rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each label in either column."""
    counts = confusion(rows, gold, predicted)
    parts = counts.select(F.explode(F.array(
        F.struct(F.col(gold).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("found"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("found"), F.lit(0).cast("long").alias("hit")),
    )).alias("p")).select("p.*")
    sums = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "found", "hit")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = share("hit", "found"), share("hit", "support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return sums.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def overall_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row (accuracy, macro_f1, n)."""
    total = rows.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return total.crossJoin(class_scores(rows, gold, predicted).agg(F.round(F.avg("f1"), 6).alias("macro_f1")))  # one row each


def calibration(rows: DataFrame, confidence: str, gold: str, predicted: str) -> DataFrame:
    """(confidence, n, accuracy)."""
    return rows.groupBy(confidence).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(gold) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def relevance(hits: DataFrame, gold: DataFrame, key: str = "doc_id", cut: int = 10) -> DataFrame:
    """(query_id, rank): ranks up to `cut` of hits (query_id, rank, key, section, context_start, context_end) whose context
    holds a labelled place (query_id, key, section, sentence)."""
    places = gold.withColumnRenamed("sentence", "_sentence")
    return hits.filter(F.col("rank") <= cut).join(places, ["query_id", key, "section"]).filter("_sentence between context_start and context_end").select("query_id", "rank").distinct()


def query_scores(queries: DataFrame, relevant: DataFrame, gold: DataFrame, hits: DataFrame, cut: int = 10) -> DataFrame:
    """queries with answerable, abstained, first_rank and ndcg (binary, the ideal from the labels, 1 at most)."""
    labels = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    found = relevant.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    answered = hits.select("query_id").distinct().withColumn("answered", F.lit(True))
    rows = queries.join(labels, "query_id", "left").join(found, "query_id", "left").join(answered, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(cut)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    ndcg = F.when(F.col("n_gold").isNotNull(), F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / ideal))
    return rows.select(*queries.columns, F.col("n_gold").isNotNull().alias("answerable"), F.col("answered").isNull().alias("abstained"), "first_rank", F.round(ndcg, 6).alias("ndcg"))


def retrieval_metrics(scores: DataFrame, *group: str) -> DataFrame:
    """(group, n, recall_1, recall_5, recall_10, mrr, ndcg_10, abstain_precision, abstain_recall)."""
    at = lambda k: F.avg(F.when(F.col("answerable"), (F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("double")))
    mrr = F.avg(F.when(F.col("answerable"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0))))
    right, negatives, silent = (F.sum(c.cast("int")) for c in (F.col("abstained") & ~F.col("answerable"), ~F.col("answerable"), F.col("abstained")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    named = (("recall_1", at(1)), ("recall_5", at(5)), ("recall_10", at(10)), ("mrr", mrr), ("ndcg_10", F.avg("ndcg")), ("abstain_precision", share(right, silent)), ("abstain_recall", share(right, negatives)))
    return scores.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.round(c, 6).alias(n) for n, c in named])


def latency_percentiles(rows: DataFrame, value: Column, *group: str) -> DataFrame:
    """(group, n, p50, p95): the median, and the value at the nearest rank, ceil(0.95 n)."""
    return rows.withColumn("_v", value).groupBy(*group).agg(F.count("_v").alias("n"), F.round(F.percentile("_v", 0.5), 6).alias("p50"), F.expr("percentile_disc(0.95) within group (order by _v)").alias("p95"))


def regressions(now: DataFrame, before: DataFrame, key: str = "metric", value: str = "value", tolerance: float = 0.005) -> DataFrame:
    """(key, before, now) of metrics that fell by more than the tolerance; latency and index figures don't count."""
    rows = now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key)
    return rows.filter((F.col("now") + tolerance < F.col("before")) & ~F.col(key).startswith("latency") & ~F.col(key).startswith("index_"))


def top_by(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)

"""The library: shelf orders, progress, readiness, quota, and what work can be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- shelf


def shelf_order(books: DataFrame, by: str, title: str = "title", author: str = "author", opened: str = "last_opened", created: str = "created", progress: str = "progress", key: str = "doc_id") -> DataFrame:
    """books with place, in the order of: opened (created where never opened), added, title, author (missing ones last) or
    progress. One sort by range; places are numbered from each range's start, so no task sees all books."""
    orders = {
        "opened": [F.coalesce(opened, created).desc_nulls_last()],
        "added": [F.col(created).desc_nulls_last()],
        "title": [F.lower(title).asc_nulls_last()],
        "author": [F.lower(author).asc_nulls_last(), F.lower(title).asc_nulls_last()],
        "progress": [F.col(progress).desc_nulls_last()],
    }
    if by not in orders:
        raise ValueError(f"order isn't one of {', '.join(orders)}")
    return books.orderBy(*orders[by], key)


def continue_reading(rows: DataFrame, user: str, opened: str, *facts: str) -> DataFrame:
    """(user, facts): those of each user's row opened last."""
    last = F.max(F.struct(opened, *facts)).alias("last")
    return rows.filter(F.col(opened).isNotNull()).groupBy(user).agg(last).select(user, *[F.col(f"last.{c}").alias(c) for c in (opened, *facts)])


def extents(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sections, n_sentences, n_words)."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    sections = passages.groupBy(key, "section").agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("words"))
    return sections.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_sentences"), F.sum("words").alias("n_words"))


def usage(files: DataFrame, owner: str, path: str, size: Column, limit: int) -> DataFrame:
    """(owner, n_files, used, over): bytes of the distinct files of an owner, and whether they are more than the limit."""
    distinct = files.groupBy(owner, path).agg(F.max(size).alias("size"))
    sums = distinct.groupBy(owner).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("used"))
    return sums.withColumn("over", F.col("used") > limit)


def would_exceed(used: DataFrame, new: DataFrame, owner: str, size: str, limit: int) -> DataFrame:
    """new (owner, size) with fits: whether the owner has room for it."""
    return new.join(used.select(owner, "used"), owner, "left").withColumn("fits", F.coalesce("used", F.lit(0)) + F.col(size) <= limit)


# ---- reading


def progress_percent(sizes: DataFrame, positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, percent): sentences up to the position, of those from the start section on; 0 to 100, halves up.

    sizes (key, section, n), positions (key, section, sentence, start).
    """
    rows = sizes.join(positions.withColumnRenamed("section", "at"), key).filter(F.col("section") >= F.col("start"))
    read = F.when(F.col("section") < F.col("at"), F.col("n")).when(F.col("section") == F.col("at"), F.least(F.col("n"), F.col("sentence") + 1)).otherwise(0)
    sums = rows.groupBy(key).agg(F.sum(read).alias("read"), F.sum("n").alias("total"))
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("read") / F.col("total") + 0.5)).otherwise(0)
    return positions.select(key).join(sums, key, "left").select(key, F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(percent, F.lit(0)))).cast("int").alias("percent"))


def timeline(rows: DataFrame, key: list[str], order: list[str], length: Column, block: Column) -> DataFrame:
    """rows with start and end: sums of the lengths before a row, and with it.

    block must not fall as the order rises. Its sums are added up first, one row for each block of a key, so that a task
    that goes through rows has those of one block, and not all of a large key.
    """
    upto = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_block", block)
    sums = held.groupBy(*key, "_block").agg(F.sum(length).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*key, "_block")]
    inside = held.withColumn("_inside", F.sum(length).over(upto))
    placed = inside.alias("r").join(sums.drop("_sum").alias("s"), same).select("r.*", "_before")
    return placed.withColumn("end", F.col("_before") + F.col("_inside")).withColumn("start", F.col("end") - length).drop("_block", "_before", "_inside")


def readiness(items: DataFrame, ready: Column, *group: str) -> DataFrame:
    return items.groupBy(*group).agg(F.sum(ready.cast("int")).alias("ready"), F.count(F.lit(1)).alias("total"))


def contiguous_ready(items: DataFrame, ready: Column, group: str, *order: str) -> DataFrame:
    """(group, contiguous): how many items at the start are ready, in their order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    marked = items.withColumns({"_place": place, "_ready": ready})
    return marked.groupBy(group).agg(F.coalesce(F.min(F.when(~F.col("_ready"), F.col("_place"))), F.count(F.lit(1))).cast("long").alias("contiguous"))


def ready_run(items: DataFrame, ready: Column, group: str, order: list[str], most: int = 5) -> DataFrame:
    """items with run: ready ones in a row from this one on, across sections, `most` at most."""
    place = Window.partitionBy(group).orderBy(*order)
    marked = items.withColumns({"_n": F.row_number().over(place), "_ready": ready})
    ahead = place.rowsBetween(0, Window.unboundedFollowing)
    stop = F.first(F.when(~F.col("_ready"), F.col("_n")), ignorenulls=True).over(ahead)
    end = F.coalesce(stop, F.max("_n").over(Window.partitionBy(group)) + 1)
    return marked.withColumn("run", F.least(F.lit(most), end - F.col("_n")).cast("int")).drop("_n", "_ready")


def rotated_order(items: DataFrame, group: str, position: str, start: Column) -> DataFrame:
    """items with turn: from the start position to the end, then those before it."""
    order = Window.partitionBy(group).orderBy((F.col(position) < start).cast("int"), position)
    return items.withColumn("turn", F.row_number().over(order) - 1)


# ---- work that can be kept


def reusable(items: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Complete items that are still wanted, with the same keys and signature."""
    return items.filter(F.col("status") == "complete").join(wanted, [*keys, "signature"], "left_semi")


def missing_vectors(passages: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """Passages without a vector of the same keys, such as id, hash and model."""
    return passages.join(vectors, list(keys), "left_anti")


def stale_rows(stored: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Stored rows whose keys no longer exist: vectors, or files that nobody refers to."""
    return stored.join(current, list(keys), "left_anti")


def shared_sources(rows: DataFrame, key: str, source: str) -> DataFrame:
    """rows with shared: whether another key has the same source. Counts are made before the join, so a source of very
    many rows costs one row."""
    counts = rows.filter(F.col(source).isNotNull()).groupBy(source).agg((F.min(key) != F.max(key)).alias("shared"))
    return rows.join(counts, source, "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def collectible(sources: DataFrame, references: DataFrame, source: str) -> DataFrame:
    return sources.join(references.select(source).distinct(), source, "left_anti")


def with_override(inferred: DataFrame, manual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """inferred with what manual (keys, value) says instead, where it isn't null."""
    return inferred.join(manual.select(*keys, F.col(value).alias("_manual")), keys, "left").withColumn(value, F.coalesce("_manual", value)).drop("_manual")


def with_latest(items: DataFrame, jobs: DataFrame, key: str, order: list[str], *facts: str) -> DataFrame:
    """items with the facts of the latest of their jobs."""
    last = jobs.groupBy(key).agg(F.max(F.struct(*order, *facts)).alias("_last")).select(key, *[F.col(f"_last.{f}").alias(f) for f in facts])
    return items.join(last, key, "left")


def latest_by_key(rows: DataFrame, key: list[str], order: list[str], *facts: str) -> DataFrame:
    """(key, order, facts) of each key's last row. One partial aggregate; no sort of a key's rows."""
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *facts)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in (*order, *facts)])


def toggled(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that were toggled an odd number of times: marks that are set now."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("toggles")).filter("toggles % 2 = 1")

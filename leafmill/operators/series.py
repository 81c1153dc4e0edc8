"""Series of values and events over time or place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signal_stats(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n, rms, peak)."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.round(F.sqrt(F.coalesce(F.sum(value * value), F.lit(0.0)) / F.greatest(F.lit(1), F.count(value))), 6).alias("rms"), F.max(F.abs(value)).alias("peak"))


def active_bounds(rows: DataFrame, key: str, position: str, value: Column, threshold: float, guard: int) -> DataFrame:
    """(key, first, last): positions from the first to the last value above the threshold, a guard further each way and
    within the series; the whole series if all are below."""
    loud = F.abs(value) > threshold
    sums = rows.groupBy(key).agg(F.min(position).alias("low"), F.max(position).alias("high"), F.min(F.when(loud, F.col(position))).alias("a"), F.max(F.when(loud, F.col(position))).alias("b"))
    return sums.select(key, F.coalesce(F.greatest("low", F.col("a") - guard), "low").alias("first"), F.coalesce(F.least("high", F.col("b") + guard), "high").alias("last"))


def rolling_eta(rows: DataFrame, key: str, order: list[str], duration: Column, remaining: Column, rows_back: int = 10) -> DataFrame:
    """rows with rate, the mean of the last durations, and eta, the rate times what remains."""
    recent = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows_back - 1), 0)
    return rows.withColumn("rate", F.round(F.avg(duration).over(recent), 6)).withColumn("eta", F.round(F.avg(duration).over(recent) * remaining, 4))


def rate_limit(rows: DataFrame, key: str, time: Column, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, order, limited): whether a limiter rejects each of a key's requests.

    A request passes if fewer than `limit` passed within the last seconds, both ends included; rejected ones don't count, as
    in streaming.rate_limited. Requests of a key are taken by time, then by `order`.

    A key's requests are cut where it is calm: with at most `limit` requests in the last two spans, all those of the last
    span have passed, whatever came before. A part starts from these and is replayed by itself, so the history of a busy key
    is spread over as many rows as it has parts. Only a key that asks for more than its limit all the time is one part.
    """
    span = seconds * 1_000_000
    kind = rows.schema[order].dataType.simpleString()
    ordered = Window.partitionBy(key).orderBy("_t", order)
    within = lambda low, high: Window.partitionBy(key).orderBy("_t").rangeBetween(low, high)
    timed = rows.select(key, order, F.unix_micros(time).alias("_t"))
    calm = F.coalesce(F.lag("_t").over(ordered) != F.col("_t"), F.lit(True)) & (F.count(F.lit(1)).over(within(-2 * span, 0)) <= limit)
    parts = timed.withColumn("_calm", calm).withColumn("_part", F.sum(F.col("_calm").cast("int")).over(ordered))
    # A request also stands ahead of each part that begins within a span after it.
    ahead = F.collect_list(F.when(F.col("_calm"), F.col("_part"))).over(within(1, span))
    roles = F.concat(F.array(F.struct(F.col("_part").alias("part"), F.lit(True).alias("own"))), F.transform("_ahead", lambda p: F.struct(p.alias("part"), F.lit(False).alias("own"))))
    spread = parts.withColumn("_ahead", ahead).select(key, order, "_t", F.explode(roles).alias("_r"))
    own = F.col("_r.own")
    lists = spread.groupBy(key, F.col("_r.part").alias("_part")).agg(F.sort_array(F.collect_list(F.when(own, F.struct("_t", order)))).alias("_own"), F.collect_list(F.when(~own, F.col("_t"))).alias("_before"))
    state = "struct<passed:array<bigint>,out:string>"

    def step(done: Column, t: Column) -> Column:
        recent = F.filter(done["passed"], lambda p: p >= t - span)
        full = F.size(recent) >= limit
        return F.struct(F.when(full, recent).otherwise(F.concat(recent, F.array(t))).alias("passed"), F.concat(done["out"], F.when(full, "1").otherwise("0")).alias("out")).cast(state)

    start = F.struct(F.col("_before").alias("passed"), F.lit("").alias("out")).cast(state)
    told = lists.withColumn("_told", F.aggregate(F.transform("_own", lambda x: x["_t"]), start, step, lambda done: done["out"]))
    out = told.select(key, "_told", F.posexplode("_own").alias("_i", "_x"))
    return out.select(key, F.col(f"_x.{order}").cast(kind).alias(order), (F.substring("_told", F.col("_i") + 1, F.lit(1)) == "1").alias("limited"))


def change_snapshots(rows: DataFrame, key: str, order: list[str], *payload: Column) -> DataFrame:
    """rows whose payload isn't that of the key's row before; the first one of a key counts as changed."""
    digest = F.xxhash64(*payload)
    before = F.lag("_digest").over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_digest", digest).withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_digest"))).drop("_digest", "_before")


def undo_outcomes(rows: DataFrame, key: str, time: Column, order: str, kind: Column, seconds: int = 8) -> DataFrame:
    """(key, order, outcome) of each delete among rows whose kind is delete or restore.

    A delete opens a window of so many seconds. A restore in it makes the delete restored and closes the window, without
    one it is purged; a delete in an open window is repeated and changes nothing. Rows of a key are replayed in order,
    apart from those before a longer silence, as no window spans one.
    """
    limit = seconds * 1_000_000
    w = Window.partitionBy(key).orderBy("_micros", order)
    marked = rows.withColumns({"_micros": F.unix_micros(time), "_kind": kind}).filter(F.col("_kind").isin("delete", "restore"))
    marked = marked.withColumn("_silent", (F.col("_micros") - F.lag("_micros").over(w) > limit).cast("int")).withColumn("_burst", F.coalesce(F.sum("_silent").over(w), F.lit(0)))
    bursts = marked.groupBy(key, "_burst").agg(F.sort_array(F.collect_list(F.struct("_micros", order, "_kind"))).alias("_rows"))
    id_ = rows.schema[order].dataType.simpleString()
    state = f"struct<at:bigint,id:{id_},out:array<struct<id:{id_},outcome:string>>>"
    outcome = lambda id_, what: F.array(F.struct(id_.alias("id"), F.lit(what).alias("outcome")))

    def step(s: Column, x: Column) -> Column:
        open_ = s["at"].isNotNull()
        live = open_ & (x["_micros"] - s["at"] <= limit)
        closed = F.when(open_ & ~live, F.concat(s["out"], outcome(s["id"], "purged"))).otherwise(s["out"])
        deleted = F.when(live, F.struct(s["at"], s["id"], F.concat(s["out"], outcome(x[order], "repeated"))).cast(state)).otherwise(F.struct(x["_micros"], x[order], closed).cast(state))
        out = F.when(live, F.concat(s["out"], outcome(s["id"], "restored"))).otherwise(closed)
        return F.when(x["_kind"] == "delete", deleted).otherwise(F.struct(F.lit(None), F.lit(None), out).cast(state))

    start = F.struct(F.lit(None), F.lit(None), F.array()).cast(state)
    done = F.aggregate("_rows", start, step, lambda s: F.when(s["at"].isNotNull(), F.concat(s["out"], outcome(s["id"], "purged"))).otherwise(s["out"]))
    return bursts.select(key, F.explode(done).alias("_o")).select(key, F.col("_o.id").alias(order), "_o.outcome")


def without_late(updates: DataFrame, deletes: DataFrame, key: str, time: str) -> DataFrame:
    """Updates of keys that weren't deleted before: what comes late for a deleted key is dropped."""
    gone = deletes.groupBy(key).agg(F.min(time).alias("_gone"))
    return updates.join(gone, key, "left").filter(F.col("_gone").isNull() | (F.col(time) < F.col("_gone"))).drop("_gone")


def deduplicated(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")

"""Streams of documents and events: what each micro-batch changes in a table, and what state decides.

Tables are logs of batches in the shared file system: a batch writes its rows under its own number, so one that runs
again after a failure writes the same rows again, and nothing else is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_files(spark: SparkSession, folder: str, schema: T.StructType | str, form: str = "parquet", per_batch: int = 1_000, clean: str = "off") -> DataFrame:
    """A stream of the files that arrive in a folder: each is read once, also after a restart from the checkpoint. With
    clean="delete" files go when the batch after theirs begins."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_batch).option("cleanSource", clean).load(folder)


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream until all that is there now has been worked on."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@contextmanager
def without_shuffle_files(*sessions: SparkSession) -> Iterator[None]:
    """Inside, shuffle files of each action in these sessions go when it is done, not when the driver collects its garbage."""
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    for spark in sessions:
        before.append((spark, spark.conf.get(name, None)))
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for spark, value in before:
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class BatchLog:
    """Rows of a table as batches left them, in folders v=0, v=1, ...; s=N holds what is current after batch N.

    A batch writes its own rows only, however large the table is. What is current is worked out when it is read; every
    `fold` batches it is written as a whole, so that a read has that and fewer than `fold` batches to go through.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, fold: int = 64):
        self.spark, self.folder, self.fold = spark, folder.rstrip("/"), fold
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, as the file system that Spark reads has them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[2:]) for n in names if n.startswith(f"{kind}=")]
        return sorted(v for v in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}={v}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with v, the batch that wrote them, of batches below `before`, if given."""
        ok = lambda v: before is None or v < before
        folded = max(filter(ok, self.complete("s")), default=-1)
        kinds = T.StructType([*self.schema.fields, T.StructField("v", T.IntegerType())])
        out = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])  # known to be empty, so joins are planned by the files
        if folded >= 0:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/s={folded}").withColumn("v", F.lit(folded)))
        if paths := [f"{self.folder}/v={v}" for v in self.complete("v") if v > folded and ok(v)]:
            out = out.unionByName(self.spark.read.option("basePath", self.folder).schema(kinds).parquet(*paths))
        return out

    def batch(self, version: int) -> DataFrame:
        """The rows that one batch has written."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={version}")

    def write(self, version: int, rows: DataFrame, current: Callable[[DataFrame], DataFrame]) -> None:
        """What batch `version` adds; current picks the rows that count from those of read()."""
        self._put(f"v={version}", rows)
        if (version + 1) % self.fold == 0 and version not in self.complete("s"):
            self._put(f"s={version}", current(self.read(before=version + 1)))

    def _put(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")


def of_last_batch(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key, the rows of the last batch that has it."""
    last = F.max("v").over(Window.partitionBy(*key))
    return rows.withColumn("_last", last).filter(F.col("v") == F.col("_last")).drop("_last")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by order."""
    facts = [c for c in rows.columns if c not in (*key, *order)]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *facts)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in (*order, *facts)])


def upsert_latest(table: BatchLog, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last row of each key of the batch; latest(table.read(), ...) has that of all batches."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.write(batch_id, latest(batch.select(*table.schema.names), key, order), lambda rows: latest(rows.drop("v"), key, order))

    return run


def add_vectors(table: BatchLog, embed: Callable[[DataFrame], DataFrame], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on texts: only vectors that aren't current for the same keys are added; those that
    of_last_batch(table.read(), keys[0]) has are current."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh, old = embed(batch), of_last_batch(table.read(before=batch_id), keys[0])
        table.write(batch_id, fresh.join(old.select(*keys), keys, "left_anti"), lambda rows: of_last_batch(rows, keys[0]))

    return run


def drop_deleted(table: BatchLog, tombstones: Callable[[], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of the batch are added, but for keys that have been deleted."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*table.schema.names).join(tombstones().select(key).distinct(), key, "left_anti")
        table.write(batch_id, fresh, lambda rows: rows)

    return run


def once_each(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key, within what may come late: a request that is sent again isn't applied again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def use_state_store(spark: SparkSession) -> None:
    """Timers and lists in state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class UndoProcessor(StatefulProcessor):
    """Deletes that wait: a restore within the time undoes one, a timer makes it final, another delete changes nothing."""

    def __init__(self, seconds: int = 8):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "event_id long, micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        out = []
        for e in events.itertuples():
            held = self.open.get() if self.open.exists() else None
            if held and e.micros - held[1] > self.millis * 1000:
                out.append((key[0], held[0], "purged"))
                self._close(held)
                held = None
            if e.kind == "delete" and held is None:
                self.open.update((int(e.event_id), int(e.micros)))
                self.handle.registerTimer(self._due(int(e.micros)))
            elif e.kind == "delete":
                out.append((key[0], int(e.event_id), "repeated"))
            elif held is not None:
                out.append((key[0], held[0], "restored"))
                self._close(held)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    def _due(self, micros: int) -> int:
        return micros // 1000 + self.millis + 1

    def _close(self, held) -> None:
        self.handle.deleteTimer(self._due(held[1]))
        self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            held = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(key[0], held[0], "purged")], columns=["user_id", "event_id", "outcome"])

    def close(self) -> None:
        pass


def undoable_deletes(stream: DataFrame, seconds: int = 8, late: str = "10 seconds") -> DataFrame:
    """(user_id, event_id, outcome) from a stream (user_id, event_id, ts, micros, kind: delete or restore), micros being
    ts in microseconds."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(UndoProcessor(seconds), "user_id long, event_id long, outcome string", "Append", "EventTime")


class LimitProcessor(StatefulProcessor):
    """A sliding limit: a request is let through if fewer than the limit were in the last seconds. Rejected ones don't count."""

    def __init__(self, limit: int, seconds: int = 60):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = sorted(r[0] for r in self.passed.get()) if self.passed.exists() else []
        out = []
        for e in pd.concat(list(rows)).sort_values(["micros", "event_id"]).itertuples():
            recent = [m for m in recent if m >= e.micros - self.span]
            limited = len(recent) >= self.limit
            if not limited:
                recent.append(int(e.micros))
            out.append((key[0], int(e.event_id), limited))
        self.passed.put([(m,) for m in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent:
            self.handle.registerTimer((recent[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "limited"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()  # the key has been idle for the whole span
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, limit: int, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """(user_id, event_id, limited) from a stream (user_id, event_id, ts, micros)."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(LimitProcessor(limit, seconds), "user_id long, event_id long, limited boolean", "Append", "EventTime")


class ChangeProcessor(StatefulProcessor):
    """A change feed: rows of a key whose payload isn't the last one; a deleted event ends the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = self.last.get()[0] if self.last.exists() else None
        for e in pd.concat(list(rows)).sort_values(["micros", "event_id"]).itertuples():
            if e.payload != held:
                out.append((key[0], int(e.event_id), e.payload))
                held = e.payload
        if held is None or held == "deleted":
            self.last.clear()
        else:
            self.last.update((held,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "payload"])

    def close(self) -> None:
        pass


def change_feed(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, payload) of changes in a stream (user_id, event_id, ts, micros, payload)."""
    return stream.groupBy("user_id").transformWithStateInPandas(ChangeProcessor(), "user_id long, event_id long, payload string", "Append", "None")


def windowed_counts(stream: DataFrame, key: str, time: str = "ts", width: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(start, key, n): rows of each key in sliding windows: an approximate limiter with bounded state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")

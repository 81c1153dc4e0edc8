"""Tables that batches leave: replaced, emptied and repeated documents, batches that run twice, and folded batches."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import library
from leafmill.operators.index import document_frequencies, postings, statistics, with_hash
from leafmill.operators.passages import passages_of
from leafmill.streaming import jobs
from leafmill.streaming.incremental import IncrementalIndex


TEXTS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("fold", [1, 2, 64])
def test_an_index_is_that_of_the_last_texts(spark, tmp_path, fold):
    batches = [{1: "One is here. It stays.", 2: "Two is here.", 3: "Three goes."}, {2: "Two was changed. And grew.", 3: ""}, {4: None, 1: "One again. One title."}, {3: "Three is back.", 2: "Two was changed. And grew."}]
    index, now = IncrementalIndex(spark, str(tmp_path / "index"), fold), {}
    for i, texts in enumerate(batches):
        batch = spark.createDataFrame([(k, v, "en") for k, v in texts.items()], TEXTS)
        for _ in range(2):  # as after a failure
            index.update()(batch, i)
        now |= texts
        want = with_hash(passages_of(spark.createDataFrame([(k, v, "en") for k, v in now.items()], TEXTS)))
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
        assert same(index.passages(), want)
        assert same(index.postings(), postings(want))
        assert same(index.frequencies(), document_frequencies(postings(want)))
        assert same(index.statistics(), statistics(want))
    assert {tuple(r) for r in index.changes().collect()} == {(0, "insert", 4), (1, "update", 1), (1, "insert", 1), (1, "delete", 1), (2, "update", 2), (3, "insert", 1)}
    written = lambda v: spark.read.parquet(str(tmp_path / "index" / "passages" / f"v={v}"))
    assert {r["doc_id"] for r in written(3).collect()} == {3}  # an unchanged document isn't written again


def test_one_row_of_a_document_counts_in_a_batch(spark, tmp_path):
    rows = [(1, "First text. More.", "en", 5), (1, "A later one.", "en", 7), (None, "No id.", "en", 1), (1, "First text. More.", "en", 6)]
    batch = spark.createDataFrame(rows, f"{TEXTS}, at long")
    index = IncrementalIndex(spark, str(tmp_path / "index"))
    index.update(order=[F.col("at")])(batch, 0)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in index.passages().collect()) == [(0, "No id."), (1, "A later one.")]
    index.update()(batch.filter("doc_id IS NULL"), 1)
    assert [r for r in index.changes().collect() if r["batch"] == 1] == []


def test_upserts_and_additions(spark, tmp_path):
    schema = "k long, at long, x string"
    table, log = jobs.BatchLog(spark, str(tmp_path / "latest"), schema, 2), jobs.BatchLog(spark, str(tmp_path / "all"), schema, 2)
    gone = spark.createDataFrame([(3,), (3,)], "k long")
    for i, rows in enumerate([[(1, 5, "a"), (1, 6, "b"), (3, 1, "c")], [(1, 4, "late"), (2, 1, "d")], [(2, 1, "e"), (None, 1, "f")]]):
        batch = spark.createDataFrame(rows, schema)
        jobs.upsert_latest(table, ["k"], ["at"])(batch, i)
        jobs.drop_deleted(log, lambda: gone, "k")(batch, i)
    rows = {tuple(r) for r in jobs.latest(table.read().drop("v"), ["k"], ["at"]).collect()}
    assert rows == {(1, 6, "b"), (2, 1, "e"), (3, 1, "c"), (None, 1, "f")}
    assert sorted(r["x"] for r in log.read().collect()) == ["a", "b", "d", "e", "f", "late"]


def test_vectors_that_are_current_stay(spark, tmp_path):
    table = jobs.BatchLog(spark, str(tmp_path / "vectors"), "doc_id long, hash string, made long", 2)
    for i, texts in enumerate([{1: "a", 2: "b"}, {1: "a", 2: "c"}, {2: "b", 1: "a"}]):
        batch = spark.createDataFrame(list(texts.items()), "doc_id long, hash string")
        jobs.add_vectors(table, lambda rows, i=i: rows.withColumn("made", F.lit(i).cast("long")), ["doc_id", "hash"])(batch, i)
    assert {tuple(r)[:3] for r in jobs.of_last_batch(table.read(), "doc_id").collect()} == {(1, "a", 0), (2, "b", 2)}


def test_a_timeline_over_blocks_is_a_running_sum(spark):
    rows = [(k, i, (7 * i) % 5) for k in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, n long")
    got = library.timeline(df, ["k"], ["i"], F.col("n"), F.floor(F.col("i") / 6)).collect()
    assert {(r["k"], r["i"]): r["end"] for r in got} == {(k, i): sum(n for q, j, n in rows if q == k and j <= i) for k, i, _ in rows}
    assert all(r["start"] == r["end"] - r["n"] for r in got)

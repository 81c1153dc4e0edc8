"""Corrected terms against the standard library's matching blocks, and the batch limiter against a plain replay."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import index, series
from leafmill.operators.stored import bm25, hits_of, store_lists, term_lists


def test_similarity_is_that_of_matching_blocks(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcñé") for _ in range(rnd.randrange(1, 12)))
    pairs = [(word(), word()) for _ in range(400)] + [("abab", "baba"), ("aaaa", "aa"), ("a", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", index.block_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r["s"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio(), abs=1e-12), r


def test_closest_term_of_many(spark):
    rnd = random.Random(6)
    known = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randrange(4, 9))) for _ in range(300)})
    asked = [w[:2] + "x" + w[3:] for w in known[::3]]
    blocks = [(a, k) for a in asked for k in known if (a[0] == k[0] or a[-1] == k[-1]) and abs(len(a) - len(k)) <= 2]
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "term string")
    found = index.fuzzy_blocks(frame(asked), frame(known))
    assert sorted(map(tuple, found.collect())) == sorted(set(blocks))
    got = {r["term"]: (r["candidate"], r["similarity"]) for r in index.closest_terms(found).collect()}
    for a in asked:
        near = difflib.get_close_matches(a, [k for t, k in set(blocks) if t == a], n=1, cutoff=0.78)
        assert got.get(a) == ((near[0], round(difflib.SequenceMatcher(None, near[0], a).ratio(), 6)) if near else None)


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_rejected_requests_do_not_count(spark, limit):
    rnd, rows, want = random.Random(limit), [], {}
    for user, pause in ((1, 40), (2, 15), (3, 200), (None, 30)):
        at, passed = 0, []
        for i in range(200):
            at += rnd.choice([0, 1, pause, 3 * pause]) if rnd.random() < 0.9 else 500
            rows.append((user, i, at))
            recent = [p for p in passed if p >= at - 60]
            want[user, i] = len(recent) >= limit
            passed = recent if want[user, i] else [*recent, at]
    df = spark.createDataFrame(rows, "user long, id long, at long")
    got = series.rate_limit(df.repartition(5), "user", F.timestamp_seconds("at"), "id", limit).collect()
    assert {(r["user"], r["id"]): r["limited"] for r in got} == want and len(got) == len(rows)
    assert 0 < sum(want.values()) < len(want)


def test_stored_lists_answer_as_those_made_at_once(spark, tmp_path):
    rnd = random.Random(8)
    words = "alpha beta gamma delta the of eta".split()
    rows = [(k, s, i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(8))), words[k % 5]) for k in range(30) for s in range(2) for i in range(3)]
    passages = spark.createDataFrame(rows, "doc_id long, section int, sentence int, text string, title string")
    queries = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "delta"), (3, "the"), (4, "none")], "query_id long, term string")
    lists = term_lists(passages, buckets=4)
    saved = store_lists(lists, str(tmp_path), buckets=4)
    assert sorted(map(tuple, bm25(saved, queries).collect())) == sorted(map(tuple, bm25(lists, queries).collect()))
    hits = hits_of(saved, F.broadcast(queries))
    plan = hits.groupBy("bucket", "query_id", "doc_id", "section", "sentence").agg(F.sum("impact").alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" not in plan and "hashpartitioning(query_id" not in plan  # hits are summed up where they are
    assert {r["query_id"] for r in hits.collect()} == {1, 2}
    impacts = [[h["impact"] for h in r["hits"]] for r in saved.collect()]
    assert all(x == sorted(x, reverse=True) for x in impacts)

"""Plans that go over the passages once, and move little of them."""

from pyspark.sql import functions as F

from leafmill.operators.features import summaries
from leafmill.operators.search import search_tiered
from leafmill.operators.stored import term_lists

FIELDS = "doc_id long, section int, sentence int, text string, title string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summaries_deal_sections_once(spark):
    rows = [(1, 0, 0, "The red river runs through the old town.", "t"), (1, 0, 1, "Red red river banks are often red.", "t"), (1, 0, 2, "Too short.", "t"), (1, 0, 3, "The red river runs through the old town.", "t"), (1, 1, 0, "of the and in on at to", "t")]
    got = summaries(spark.createDataFrame(rows, FIELDS))
    assert _plan(got).count("Exchange ") == 1 and "Join" not in _plan(got)
    assert sorted((r["section"], r["sentence"]) for r in got.collect()) == [(0, 0), (0, 1), (1, 0)]  # of equal texts the first
    assert [r["score"] for r in got.filter("section = 1").collect()] == [0.0]  # stopwords only


def test_only_sections_with_picks_get_context(spark):
    rows = [(1, s, i, f"apple number w{s}x{i}" if s == 0 else f"pear w{s}x{i}", "t") for s in range(3) for i in range(3)]
    passages = spark.createDataFrame(rows, FIELDS).withColumns({"citation": F.concat_ws("-", "section", "sentence"), "source": F.lit("s")})
    queries = spark.createDataFrame([(1, ["apple"])], "query_id long, terms array<string>")
    picked = search_tiered(passages, queries, most=2, lists=term_lists(passages))
    assert "LeftSemi" in _plan(picked)
    assert {(r["sentence"], r["context"]) for r in picked.collect()} == {(0, "apple number w0x0 apple number w0x1"), (2, "apple number w0x1 apple number w0x2")}

"""What an index that follows its documents keeps and moves: postings are read as they lie, and null ids are compared too."""

from leafmill.operators.index import postings
from leafmill.operators.passages import passages_of
from leafmill.streaming.incremental import IncrementalIndex

TEXTS = "doc_id long, text string, lang string"


def test_postings_and_passages_are_read_without_a_shuffle(spark, tmp_path):
    index = IncrementalIndex(spark, str(tmp_path / "index"))
    text = "red blue red the red blue green. " + "red " * 300 + "\nThe of and.\nRed Año año."
    for i, texts in enumerate([[(1, text, "en"), (2, "One stays. One goes.", "en")], [(2, "One stays. Two goes. Three.", "en"), (None, "No id.", "en")], [(None, "No id. And more.", "en")]]):
        batch = spark.createDataFrame(texts, TEXTS)
        index.update()(batch, i)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(index.postings()) and "Exchange hashpartitioning" not in plan(index.passages())
    now = spark.createDataFrame([(1, text, "en"), (2, "One stays. Two goes. Three.", "en"), (None, "No id. And more.", "en")], TEXTS)
    want = postings(passages_of(now))
    assert sorted(map(str, index.postings().collect())) == sorted(map(str, want.select(*index.postings().columns).collect()))
    assert {tuple(r) for r in index.changes().collect() if r["batch"] == 2} == {(2, "update", 1), (2, "insert", 1)}  # its title grew

"""op3_url_filters: the model learns from its own table, and from both labels however often a url occurs."""

import pandas as pd
from pyspark.sql import functions as F

from leafmill.llm.queries import QUERIES
from leafmill.llm.urls import judge, train

SPAM = ["m.casino-win.example.net", "free-bets.example.net", "www.cheap-pills.example.net", "spam-farm.example.net", "ads-track.example.net"]
CLEAN = ["tionsh.example.net", "blog.therhe.example.net", "www.ththon.example.net", "m.tiontion.example.net", "uni-bern.example.net"]


def test_the_host_decides_where_no_rule_fits(spark, tmp_path):
    paths = ["/en/7817?page=2", "/de/8423", "/fr/12#top", "/es/5.html"]
    urls = [f"https://{h}{p}" for h in SPAM + CLEAN for p in paths]
    pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": ""}).to_parquet(tmp_path / "pages.parquet")
    rows = QUERIES["op3_url_filters"](spark, str(tmp_path)).collect()
    assert len(rows) == len(urls) and all(r["rule"] is None for r in rows)
    blocked = [r["host"] for r in rows if r["verdict"] == "block"]
    assert all(blocked.count(h) == len(paths) for h in SPAM)
    assert sum(blocked.count(h) for h in CLEAN) <= len(CLEAN) * len(paths) // 5  # a small table; the README has the rates


def test_copies_of_one_url_do_not_fill_the_sample(spark):
    rows = [(f"h{i}.casino.net", "/x", 1.0) for i in range(20)] + [(f"h{i}.library.net", "/x", 0.0) for i in range(20)]
    table = spark.createDataFrame(rows, "host string, path string, label double")
    first = table.orderBy(F.xxhash64("host", "path")).first()
    model = train(table.union(spark.createDataFrame([tuple(first)] * 200, table.schema)), max_rows=20)
    urls = spark.createDataFrame([("http://a.casino.net/x",), ("http://a.library.net/x",)], "url string")
    assert [r["verdict"] for r in judge(urls, model=model).orderBy("url").collect()] == ["block", "allow"]

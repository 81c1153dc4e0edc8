"""layout_lines gives back all words of the documents, line by line and page by page."""

from collections import defaultdict

import pandas as pd

from leafmill import registry


def test_every_word_stands_on_its_page(spark, sf_dir):
    rows = registry.QUERIES["layout_lines"](spark, sf_dir).collect()
    found, heights = defaultdict(dict), set()
    for r in rows:
        found[r["doc_id"]][r["page"], r["line_no"]] = r["line"]
        heights.add((r["line_no"] % 2, r["height"]))
    assert len(rows) == sum(map(len, found.values())) and heights <= {(0, 10.0), (1, 11.0)}
    table = pd.read_parquet(f"{sf_dir}/documents.parquet")
    texts = {i: [" ".join(x.split()) for x in (t or "").replace("\xad", "").split("\n") if x.split()] for i, t in zip(table.doc_id, table.text)}
    assert max(map(len, texts.values())) > 20
    assert found == {i: {(k // 20 + 1, k % 20): x for k, x in enumerate(held)} for i, held in texts.items() if held}

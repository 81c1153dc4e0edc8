"""Removing shared strings: against all windows of small texts made of few letters, so that much repeats in every way."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm.suffixes import Places, remove_shared


def removed(texts, size):
    """For each text its bytes, and which of them a window covers that starts elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append((d, gone))
    return out


def texts_of(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "abc é", "abcdefghij \n"])
    parts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(6)]
    out = [None, "", "a" * 300, "ab" * 200, "a" * 300, "xyz" * 7, "".join(parts), "".join(parts)]
    for _ in range(40):
        pick = [rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(1, 6))]
        cut = "".join(pick)
        out.append(cut[rnd.randrange(len(cut)) :] if rnd.random() < 0.3 else cut)
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 24), (2, 31), (3, 48), (4, 100)])
def test_removes_every_covered_byte_and_no_other(spark, seed, size):
    texts = texts_of(seed)
    docs = spark.createDataFrame([(f"k{i % 30}", i, t, "x", 1) for i, t in enumerate(texts)], "doc_id string, at long, text string, block string, id int")
    rows = remove_shared(docs.repartition(3).selectExpr("struct(doc_id, at) AS doc_id", "text", "block", "id"), size=size, block_chars=500).collect()
    got = {r["doc_id"]["at"]: r for r in rows}
    assert len(rows) == len(texts) and set(got) == set(range(len(texts)))
    for i, (data, gone) in enumerate(removed(texts, size)):
        r, edges = got[i], np.flatnonzero(np.diff([0, *map(int, gone), 0]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(gone), len(edges) // 2), i
        assert [(s["start"], s["end"]) for s in r["spans"]] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        assert bytes(r["kept"]) == bytes(b for b, g in zip(data, gone, strict=True) if not g)


def test_places_depend_on_what_is_around_them_only():
    rnd = random.Random(7)
    inner = "".join(rnd.choice("abcdef ") for _ in range(2000))
    found = []
    for before, after in (("", ""), ("qq" * 50, "zz"), ("x" * 999, "y" * 200)):
        p = Places(pa.array([before + inner + after]), 400)
        at = p.at - len(before)
        found.append(at[(at >= p.radius) & (at <= len(inner) - p.radius - p.gram)].tolist())
        assert np.diff(p.at).min() > p.radius
    assert found[0] and found[0] == found[1] == found[2]


def test_tables_without_a_window(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "short"), (None, "short")]):
        out = remove_shared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out) == sorted((len(t or ""), 0, 0) for _, t in rows)

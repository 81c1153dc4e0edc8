"""Source divergence and tokenizer alignment on small and empty tables, and their parts against plain Python."""

import numpy as np
import public_tokenizers

from leafmill.llm.alignment import align
from leafmill.llm.divergence import divergences, run_sum, runs, share

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_runs_and_sums_of_their_intersections():
    rnd = np.random.default_rng(5)
    for length in (1, 7, 50):
        columns = [rnd.integers(0, 3, length) for _ in range(2)]
        coded = []
        for x in columns:
            ends, value = runs(np.flatnonzero(x), x[x > 0], length)
            assert np.repeat(value, np.diff(ends, prepend=0)).tolist() == x.tolist()
            assert (value[1:] != value[:-1]).all()
            coded.append((ends, share(value + 2, int(x.sum()) + 2 * length)))
        p, q = ([1 + 10**9 * (int(n) + 2) // (int(x.sum()) + 2 * length) for n in x] for x in columns)
        assert run_sum(*coded) == sum((a - b) ** 2 // (a + b) for a, b in zip(p, q))


def test_shares_of_large_counts_are_exact():
    for n, of in ((8 * 10**15, 8_999_999_999_999_999), (3, 7), (10**12, 10**12), (0, 5)):
        assert share(np.array([n]), of)[0] == 1 + 10**9 * n // of


def test_sources_without_terms(spark):
    rows = [("en", "a", None), ("en", "b", "one two"), (None, None, "x"), ("de", "a", "only"), ("de", None, ""), ("de", "c", "1 2 3")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, total long, term string")
    got = sorted(map(tuple, divergences(docs).collect()))
    names = {"en": ["a", "b"], "de": ["", "a", "c"]}
    want = [(lang, s, "pair", o, 0, 1 + [x for x in own if x != s].index(o)) for lang, own in names.items() for s in own for o in own if o != s]
    assert got == sorted(want)
    assert divergences(docs.limit(0)).collect() == []


def test_many_pieces_and_tiles_give_the_same_rows(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(["en", "fr"][i % 2], f"s{i % 7}", " ".join(rnd.choice(words, 40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    once = sorted(map(tuple, divergences(docs).collect()))
    assert len({r[3] for r in once}) > 20
    assert sorted(map(tuple, divergences(docs.repartition(5), piece=9, tile=2).collect())) == once


def test_alignment_of_odd_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "▁"), (4, "x" * 5000)]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, block long, count string")
    got = sorted(align(docs, *FILES).collect(), key=lambda r: (r["doc_id"] or 0, r["n_a"]))
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4]
    assert [(r["n_a"], r["n_links"], r["groups"]) for r in got if r["doc_id"] in (None, 2, 3)] == [(0, 0, "")] * 3
    assert got[1] == got[2] and got[1]["count_sum"] == 2 * got[1]["n_links"] == 2 * got[1]["n_best"] > 0
    small = sorted(align(docs.repartition(4), *FILES, block_bytes=1).collect(), key=lambda r: (r["doc_id"] or 0, r["n_a"]))
    assert small == got
    assert align(docs.limit(0), *FILES).collect() == []

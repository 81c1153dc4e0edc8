"""Tables of no or few rows, keys of other types, and columns whose names clash with those of the results."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import brown, decontam, licenses, minhash, packing, quality, secrets, substring

TEXTS = ["the cat sat on the mat " * 5, "", None, "one two three four five six seven eight nine", "the cat sat on the mat " * 5]


def table(spark, keys, kind, texts=TEXTS):
    return spark.createDataFrame(list(zip(keys, texts, strict=True)), f"doc_id {kind}, text string")


KEYS = {"bigint": [1, 2, 3, 4, 5], "string": ["b", "a", "c", None, "aa"], "int": [None, None, 1, 1, 2]}


@pytest.mark.parametrize("kind", KEYS)
def test_scores_need_no_many_documents(spark, kind):
    docs = table(spark, KEYS[kind], kind)
    rows = brown.score(docs, F.lit(False)).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, KEYS[kind]))
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 10, 31, 31]
    assert brown.score(docs.limit(0), F.lit(False)).collect() == []


@pytest.mark.parametrize("kind", KEYS)
def test_repeats_go_for_keys_of_any_type(spark, kind):
    rows = substring.remove_repeats(table(spark, KEYS[kind], kind), size=20).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, KEYS[kind]))
    whole = [r for r in rows if r["n_words"] == 30]
    first = min(whole, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert {r["n_removed"] for r in whole if r is not first} == {30} and 0 < first["n_removed"] < 30
    assert substring.remove_repeats(table(spark, KEYS[kind], kind).limit(0), size=20).collect() == []


@pytest.mark.parametrize("kind", KEYS)
def test_copies_join_for_keys_of_any_type(spark, kind):
    rows = minhash.near_duplicates(table(spark, KEYS[kind], kind), n=2).collect()
    long = [r for r in rows if r["n_shingles"] == 6 and r["doc_id"] is not None]
    assert len({r["component_id"] for r in long}) <= 1 and all(r["component_id"] == min(x["doc_id"] for x in long) for r in long)
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if not r["n_shingles"])
    assert minhash.near_duplicates(table(spark, KEYS[kind], kind).limit(0), n=2).collect() == []


def test_columns_of_the_results_names_are_replaced(spark):
    docs = table(spark, KEYS["bigint"], "bigint")
    for column, run in {
        "license": licenses.with_licenses,
        "secrets": secrets.with_secrets,
        "stats": quality.with_statistics,
        "contamination": lambda d: decontam.with_matches(d, spark.createDataFrame([("x", "cat sat on"), (None, "a"), ("y", None), ("z", "")], "item_id string, text string")),
    }.items():
        clashing = docs.withColumn(column, F.lit("old"))
        got = run(clashing)
        assert got.columns.count(column) == 1 and got.filter(F.col(column).isNull()).count() == 0
        assert got.select(f"{column}.*").count() == 5 if column != "secrets" else got.count() == 5
    parts = spark.createDataFrame([(1, 600), (2, 500), (3, 400)], "doc_id long, length long")
    packed = packing.pack(parts.withColumn("sequence_id", F.lit("old")).withColumn("offset", F.lit("old"))).collect()
    assert {r["doc_id"]: r["offset"] for r in packed if r["doc_id"] == 2} == {2: 0} and len({r["sequence_id"] for r in packed}) == 2


def test_shared_wording_counts_for_every_template():
    shared = " ".join(f"s{i}" for i in range(20))
    templates = {"a": shared + " " + " ".join(f"a{i}" for i in range(30)), "b": shared + " " + " ".join(f"b{i}" for i in range(5))}
    scan = licenses.Scanner(templates, {}, least=4, gap=12, share=0.2)
    found = {label: (start, end, part) for label, start, end, part in scan.spans(licenses.words_of("x y " + shared))}
    assert found == {"a": (2, 22, 0.4), "b": (2, 22, 0.8)}
    longer = {label: part for label, _, _, part in scan.spans(licenses.words_of(templates["a"]))}
    assert longer == {"a": 1.0, "b": 0.8}


def test_matching_statistics_equal_brute_force():
    words = [[b"a", b"b", b"a", b"b", b"c"], [b"b", b"c", b"a", b"b"], [b"c", b"c"]]
    auto = licenses.Automaton(words)
    text = [b"a", b"b", b"c", b"c", b"a", b"b", b"a", b"b", b"c", b"a"]
    has = lambda run, seq: any(seq[i : i + len(run)] == run for i in range(len(seq)))
    for k, (size, state) in enumerate(auto.statistics(text)):
        for s, seq in enumerate(words):
            longest = max(n for n in range(k + 2) if not n or has(text[k + 1 - n : k + 1], seq))
            n, _ = auto.reach[state].get(s, (0, 0))
            assert (size if n is None else n) == longest


def test_rows_that_repeat_a_key_are_one_document_whatever_its_type(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("b", text), ("b", text), ("c", f"x {text}"), (None, text), (None, text)]
    for kind, keys in (("string", "bbc"), ("bigint", (2, 2, 3))):
        docs = spark.createDataFrame([(k, t) for k, (_, t) in zip([*keys, None, None], rows, strict=True)], f"doc_id {kind}, text string")
        got = sorted((r["doc_id"] is None, str(r["doc_id"]), r["n_removed"]) for r in substring.remove_repeats(docs, size=20).collect())
        assert [n for *_, n in got] == [0, 0, 30, 30, 30]


def test_windows_that_items_share_make_no_product(spark):
    items = spark.createDataFrame([(f"i{k:03}", "same") for k in range(300)] + [("z", "same same"), ("q", "other")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "same " * 300), (2, "an other one"), (3, None)], "doc_id long, text string")
    for part_bytes in (32 << 20, 200):
        got = {r["doc_id"]: r["contamination"] for r in decontam.with_matches(docs, items, part_bytes=part_bytes).collect()}
        assert got[1]["n_hit"] == 300 and got[1]["items"] == sorted([*(f"i{k:03}" for k in range(300)), "z"])
        assert got[2]["items"] == ["q"] and [tuple(m) for m in got[2]["matches"]] == [("q", 0, 1, 1)] and got[3]["n_hit"] == 0
    one = decontam.with_matches(docs, items).filter("doc_id = 1").first()["contamination"]
    assert len(one["matches"]) <= 600


def test_pieces_have_the_columns_asked_for(spark):
    import public_tokenizers

    out = packing.pack_documents(table(spark, KEYS["bigint"], "bigint"), public_tokenizers.path("byte_bpe_50k.json"))
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}


def test_wording_that_a_template_repeats_is_laid_where_the_chain_goes_on():
    """The second half of a template begins with words that its first half has too."""
    again = "as is without any warranty"
    template = f"alpha beta gamma {again} delta epsilon zeta eta {again} theta iota kappa lambda mu nu"
    n = len(template.split())
    scan = licenses.Scanner({"t": template}, {}, least=4, gap=12, share=0.2)
    text = f"x {again} theta iota kappa lambda y"
    assert scan.spans(licenses.words_of(text)) == [("t", 1, 10, 9 / n)]
    parted = f"x {again} z theta iota kappa lambda y"
    assert scan.spans(licenses.words_of(parted)) == [("t", 1, 11, 9 / n)]
    twice = f"{template} {'far ' * 20} {template}"
    assert [s[1:] for s in scan.spans(licenses.words_of(twice))] == [(0, n, 1.0), (n + 20, 2 * n + 20, 1.0)]

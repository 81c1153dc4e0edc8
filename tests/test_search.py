"""Tiers, operators and picks of searches on a few passages, all questions in one table."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators.search import as_queries, question_checks, rank_hits, search_tiered, tier_candidates
from leafmill.operators.stored import term_lists

PASSAGES = [
    (1, 0, 0, "The hidden garden opens at dawn.", "Garden"),
    (1, 0, 1, "Nobody walked in the garden after the hidden storm.", "Garden"),
    (1, 0, 2, "They were walking along the river.", "Garden"),
    (1, 1, 0, "A year of rain, a night of lightning.", "Weather"),
    (1, 1, 1, "The lightning struck the tower.", "Weather"),
    (2, 0, 0, "El año pasado cantaron las niñas.", "Canciones"),
    (2, 0, 1, "La niña canta cada mañana.", "Canciones"),
    (2, 0, 2, "Ano is another word.", "Canciones"),
]
QUERIES = {  # id: (terms, required, excluded, prefixes, phrases)
    1: (["hidden", "garden"], [], [], [], []),
    2: (["hidden", "garden"], [], [], [], ["hidden garden"]),
    3: (["walk"], [], [], [], []),
    4: (["lightnin"], [], [], [], []),
    5: (["light"], [], [], ["light"], []),
    6: (["garden"], ["storm"], [], [], []),
    7: (["garden"], [], ["storm"], [], []),
    8: (["año"], [], [], [], []),
    9: (["ano"], [], [], [], []),
    10: (["zzzz"], [], [], [], []),
    11: (["cantando"], [], [], [], []),
}


@pytest.fixture(scope="module")
def hits(spark):
    passages = spark.createDataFrame(PASSAGES, "doc_id long, section int, sentence int, text string, title string")
    queries = spark.createDataFrame([(i, *q) for i, q in QUERIES.items()], "query_id long, terms array<string>, required array<string>, excluded array<string>, prefixes array<string>, phrases array<string>")
    rows = tier_candidates(passages, queries, language=F.when(F.col("term").isin("cantando", "canta", "cantaron"), "es").otherwise("en")).collect()
    out = {i: {} for i in QUERIES}
    for r in rows:
        out[r["query_id"]][r["doc_id"], r["section"], r["sentence"]] = (r["match_type"], sorted(r["matched"]), r["coverage"], r["tier"])
    return out


def test_all_terms_beat_some(hits):
    both = ("exact", ["garden", "hidden"], 1.0, 40)
    assert hits[1][1, 0, 0] == both and hits[1][1, 0, 1] == both
    assert hits[1][1, 0, 2] == ("partial", ["garden"], 0.5, 20)  # by its title


def test_phrases_and_excluded_terms_are_looked_up(hits):
    assert set(hits[2]) == {(1, 0, 0)} and hits[2][1, 0, 0][0] == "phrase"
    assert set(hits[7]) == {(1, 0, 0), (1, 0, 2)}


def test_required_terms_must_be_there(hits):
    assert set(hits[6]) == {(1, 0, 1)} and hits[6][1, 0, 1] == ("exact", ["garden"], 1.0, 40)


def test_stems_answer_where_the_word_does_not(hits):
    assert hits[3] == {(1, 0, 1): ("stem", ["walk"], 1.0, 30), (1, 0, 2): ("stem", ["walk"], 1.0, 30)}
    assert set(hits[11]) == {(2, 0, 0), (2, 0, 1)} and {h[0] for h in hits[11].values()} == {"stem"}


def test_typing_errors_and_beginnings(hits):
    assert hits[4] == {k: ("fuzzy", ["lightnin"], 1.0, 10) for k in [(1, 1, 0), (1, 1, 1)]}
    assert hits[5] == {k: ("exact", ["light"], 1.0, 40) for k in [(1, 1, 0), (1, 1, 1)]}
    assert hits[10] == {}


def test_enye_is_a_letter_of_its_own(hits):
    assert set(hits[8]) == {(2, 0, 0)} and set(hits[9]) == {(2, 0, 2)}


def test_picks_skip_neighbours(spark):
    passages = spark.createDataFrame([(1, s, i, f"apple number w{s}x{i}", "t") for s in range(2) for i in range(5)], "doc_id long, section int, sentence int, text string, title string").withColumns({"citation": F.concat_ws("-", "section", "sentence"), "source": F.lit("s")})
    queries = spark.createDataFrame([(1, ["apple"])], "query_id long, terms array<string>")
    picked = search_tiered(passages, queries, most=3, lists=term_lists(passages)).orderBy("pick").collect()
    assert [(r["section"], r["sentence"]) for r in picked] == [(0, 0), (1, 0), (0, 2)]  # section 0 costs more after its first pick
    assert picked[0]["context"] == "apple number w0x0 apple number w0x1"
    assert rank_hits(tier_candidates(passages, queries), most=2).count() == 2


def test_long_questions_are_refused_and_not_cut(spark):
    rows = spark.createDataFrame([(1, "tell me about rivers"), (2, "river " * 100), (3, "the of"), (4, None)], "item_id long, text string")
    assert {r["query_id"]: r["status"] for r in question_checks(rows, "item_id", "text").collect()} == {1: "asked", 2: "refused", 3: "without terms", 4: "without terms"}
    assert [r["query_id"] for r in as_queries(rows, "item_id", "text").collect()] == [1]

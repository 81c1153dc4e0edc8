"""Chunks and halves against plain Python, over texts of short and long words, wide characters and white space of any kind."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import segment

GAP = "[\t-\r    -     　]+"


def words(text):
    return [w for w in re.split(GAP, text) if w]


def chunked(text, most):
    left, out = words(text), []
    while left:
        rest = " ".join(left)
        head = rest.encode()[:most].decode(errors="ignore")
        if head == rest:
            return [*out, rest]
        behind = [i + 1 for i in range(1, len(head)) if head[i] == " " and head[i - 1] in ",;:—" and i + 1 > len(head) // 2]
        taken = head[: max(behind, default=head.rfind(" ") + 1)].split()
        if not taken:
            return None
        out.append(" ".join(taken))
        left = left[len(taken) :]
    return out


def halved(text, most):
    bare = lambda x: re.sub(f"^{GAP}|{GAP}$", "", x)
    level = [bare(text)]
    for _ in range(8):
        grown = []
        for part in level:
            n = len(part)
            clauses = [m.end() for m in re.finditer(f"[,:;—–]{GAP}", part) if n < 4 * m.end() < 3 * n]
            ranked = sorted(clauses or [m.start() for m in re.finditer(GAP, part)], key=lambda at: (abs(2 * at - n), at))
            grown += [part] if len(words(part)) <= most or not ranked else [bare(part[: ranked[0]]), bare(part[ranked[0] :])]
        level = grown
    return [p for p in level if p] if all(len(words(p)) <= most for p in level) else None


@pytest.fixture(scope="module")
def texts():
    rnd, out = random.Random(3), [None, "", " \n ", "x" * 500, "a, b"]
    for _ in range(250):
        pick = lambda: rnd.choice(["a", "bb", "é", "ñandú", "漢字", "\U0001f600", "word", "x" * rnd.choice([1, 5, 30])]) + rnd.choice([" ", " ", " ", "  ", ", ", "; ", "—", ": \n", "　", "– "])
        out.append("".join(pick() for _ in range(rnd.choice([3, 20, 80, 300]))))
    return out


def rows(spark, texts, column):
    return dict(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column).collect())


@pytest.mark.parametrize("most", [16, 40, 100])
def test_chunks_lose_no_word_and_keep_the_bound(spark, texts, most):
    got = rows(spark, texts, segment.chunks(F.col("t"), most))
    for i, text in enumerate(texts):
        assert got[i] == (None if text is None else chunked(text, most)), i
        if got[i]:
            assert " ".join(got[i]) == " ".join(words(text)) and max(len(c.encode()) for c in got[i]) <= most


@pytest.mark.parametrize("most", [1, 3, 20])
def test_halves_grow_level_by_level(spark, texts, most):
    got = rows(spark, texts, segment.halves(F.col("t"), most))
    for i, text in enumerate(texts):
        assert got[i] == (None if text is None else halved(text, most)), i
    assert any(got[i] for i in range(len(texts)))

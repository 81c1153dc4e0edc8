"""The clustering of op5: its likelihood against a sum over tokens, and what exchange gains on texts with word classes."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm.brown import likelihood, score


def test_likelihood_is_that_of_all_tokens():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    of, end = {w: rng.randrange(6) for w in words}, 6
    texts = [[rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(40)]
    grid, counts, sizes, before = np.zeros((7, 7)), Counter(), Counter(), Counter()
    pairs = []
    for text in texts:
        last = end
        for w in [*text, None]:
            own = of.get(w, end)
            grid[last, own] += 1
            pairs.append((last, own, w))
            last = own
    for last, own, w in pairs:
        counts[w] += 1
        sizes[own] += 1
        before[last] += 1
    direct = sum(math.log(grid[a, b] / before[a]) + math.log(counts[w] / sizes[b]) for a, b, w in pairs)
    assert math.isclose(likelihood(grid) + sum(n * math.log(n) for n in counts.values()), direct, rel_tol=1e-9)


def test_exchange_finds_classes(spark):
    """Words of four kinds follow one another in turn: held-out texts gain from exchange, and more rounds lose nothing."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"k{(i + j) % 4}x{rng.randrange(150)}" for j in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r: score(docs, F.col("doc_id") % 5 == 0, classes=8, rounds=r).cache() for r in (0, 2, 5)}
    sums = {r: {x["held_out"]: x["s"] for x in df.groupBy("held_out").agg(F.sum("score").alias("s")).collect()} for r, df in got.items()}
    assert sums[2][False] > sums[0][False] and sums[2][True] > sums[0][True]
    assert sums[5][False] >= sums[2][False]

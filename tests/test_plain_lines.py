"""Lines that hold none of HARD are cut without the rules; both ways cut lines made of odd parts alike."""

import random

from pyspark.sql import functions as F

from leafmill.functions import segment
from leafmill.functions.text import SPACES, clean_text


def test_plain_lines_are_cut_as_by_the_rules(spark, monkeypatch):
    parts = ["word", "Word", "Año", "Mr", "dra", "NO", "etc", "sep", "A", "É", "x", "e", "g", "p", "ej", "EE", "UU", "12", "3", "IV", "XII", "www", "com", "es", "a@b", "http://", ":", "-", "_", "«", '"', "(", "", "", "\u0085", "—"]
    marks = [".", ".", ".", "!", "?", "...", "?!", '."', ".)", ".’”", ",", ";", ":", ")", "." + ")" * 33, ".]"]
    rng = random.Random(7)
    line = lambda: "".join(rng.choice((rng.choice(parts), rng.choice(marks), " ", " ")) for _ in range(rng.randint(1, 14))).strip()
    rows = [(i, " ".join(x.split(" ")), rng.choice(("en", "es", None))) for i, x in enumerate(line() for _ in range(20_000))]
    df = spark.createDataFrame(rows, "i int, line string, lang string")
    cut = lambda: {r["i"]: r["s"] for r in df.select("i", segment.sentences(F.trim(F.regexp_replace("line", " +", " ")), F.col("lang")).alias("s")).collect()}
    quick = cut()
    plain = df.filter(~F.col("line").rlike(segment.HARD[0]) & ~F.col("line").rlike(segment.HARD[1]) & F.col("line").rlike(r"[.!?].*[a-z]")).count()
    monkeypatch.setattr(segment, "HARD", ("", ""))  # all of them by the rules
    assert plain > 1_000 and quick == cut()


def test_spaces_are_made_single_as_before(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice(["a", " ", " ", "\t", " ", " ", "\r", "\u0085", "­"]) for _ in range(9)),) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "x string")
    before = F.trim(F.regexp_replace(F.regexp_replace("x", "­", ""), SPACES, " "))
    assert df.filter(~clean_text(F.col("x"), compose=False).eqNullSafe(before)).count() == 0

"""Where sentences end, by language."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions.segment import sentences

CASES = [
    ("en", "The train left at 5 p.m. on Monday. Nobody, e.g. the guard, saw it.", ["The train left at 5 p.m. on Monday.", "Nobody, e.g. the guard, saw it."]),
    ("es", "Vive en EE. UU. desde mayo. La Dra. Ruiz lo sabe.", ["Vive en EE. UU. desde mayo.", "La Dra. Ruiz lo sabe."]),
    ("en", "It rained on Jan. 5 again. J. R. Smith stayed.", ["It rained on Jan. 5 again.", "J. R. Smith stayed."]),
    ("en", "The U.S. army won. It was 3.5 to one.", ["The U.S. army won.", "It was 3.5 to one."]),
    ("en", "Ask ann.lee@post.site.org. Or see www.a.b/c.d?e=f. Fine.", ["Ask ann.lee@post.site.org.", "Or see www.a.b/c.d?e=f.", "Fine."]),
    ("en", "Wait... what? Apples, pears etc. and more. “Go!” !!! Then", ["Wait... what?", "Apples, pears etc. and more.", "“Go!”!!!", "Then"]),
    ("en", "1. 2. 3. IV. Last.", ["1. 2.", "3. IV.", "Last."]),
    ("en", "Well?, yes.No", ["Well?, yes.", "No"]),
    (None, "", []),
    ("fr", None, None),
    ("en", "...", ["..."]),
]


@pytest.mark.parametrize(("language", "text", "expected"), CASES)
def test_sentences(spark, language, text, expected):
    row = spark.createDataFrame([(text, language)], "t string, l string").select(sentences(F.col("t"), F.col("l")).alias("s")).first()
    assert row["s"] == expected

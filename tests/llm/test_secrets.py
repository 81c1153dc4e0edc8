"""Credential values after names of any form are found and redacted; words of prose after them aren't."""

import random
import string
import time

import pytest

from leafmill.llm import secrets
from leafmill.llm.secrets import LEAST_COST, guess_cost, known_words, redact, with_secrets

FOUND = [
    ("export AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG"), ("aws_access_key: ", "wJalrXUtnFEMI7MDENG"), ("DB_PWD=", "Tr0ub4!dor&3x9Zq"), ("DB_PASSWORD=", "p@7!xQ9#vLw2$kR"), ("dbPass: ", "p@7!xQ9#vLw2$kR"),
    ("password_hash = '", "p@7!xQ9#vLw2$kR"), ("MYSQLPASSWORD_2=", "p@7!xQ9#vLw2$kR"), ("mypass=", "p@7!xQ9#vLw2$kR"), ("pwd=", "qzjxkvwpfbghtr"), ("pwd=", "QZJXKVWPFBGHTR"), ("Authorization: Bearer ", "p@7!xQ9#vLw2$kR"), ("x-auth-token: ", "p@7!xQ9#vLw2$kR"),
]
LEFT = ["author: Wojciechowska-Zelenskyj", "Passage: Wojciechowska-Zelenskyj", "secretary: Wojciechowska-Zelenskyj", "authority: Wojciechowska-Zelenskyj", "db_pwd: documentation", "credentials: required", "pwd: Universität", "pwd=gobierno", "no_name=p@7!xQ9#vLw2$kR"]


@pytest.mark.parametrize("trained", [with_secrets, redact])
def test_names_with_more_around_the_credential_word(spark, trained):
    texts = [f"x {name}{value}\nend" for name, value in FOUND] + [f"x {t}\nend" for t in LEFT]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r for r in sorted(trained(rows).collect(), key=lambda r: r["doc_id"])]
    for (_, value), text, r in zip(FOUND, texts, out):
        if trained is redact:
            assert value not in r["text"] and "[SECRET]" in r["text"], text
        else:
            assert ("guess", text.index(value), text.index(value) + len(value)) in [tuple(s) for s in r["secrets"]], text
    for text, r in zip(texts[len(FOUND) :], out[len(FOUND) :]):
        assert (r["text"] == text) if trained is redact else r["secrets"] == [], text


def test_long_names_take_time_in_proportion():
    from leafmill.llm.secrets import CONTEXT

    start = time.monotonic()
    for text in ("a" * 200_000, "pass" * 50_000, "a_token-" * 25_000, "token " * 30_000):
        assert not CONTEXT.search(text)
    assert time.monotonic() - start < 5


def cheapest(value, words):
    """The least cost over all segmentations, each part being a letter, a known word, a date, a repeat or a walk."""
    single = secrets._single_costs(value)

    def part(a, b):
        x, out = value[a:b], [sum(single[a:b])] if b - a == 1 else []
        if secrets._PROSE.fullmatch(x) and len(x) >= 3 and x.lower() in words and (x[1:].islower() or x.isupper()):
            whole = (a == 0 or not secrets._PROSE.fullmatch(value[a - 1])) and (b == len(value) or not secrets._PROSE.fullmatch(value[b]))
            out += [secrets.log10(max(100, words[x.lower()]))] if len(x) >= 4 or whole else []
        for w in (x.lower(), x.lower().translate(secrets.LEET)):
            out += [secrets.log10(2 * secrets._RANK[w] + 10)] if w in secrets._RANK and len(w) >= 3 else []
        return out

    best = {0: 0.0}
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + c for a in range(b) for c in part(a, b))
    return best[len(value)]


def test_cost_is_that_of_the_cheapest_segmentation():
    rnd, words = random.Random(2), {"orange": 40, "table": 900, "stone": 3000, "tab": 5000, "one": 60}
    for _ in range(300):  # no dates, repeats or walks among these
        value = "".join(rnd.choice(["orange", "TABLE", "Stone", "pass", "p4ss", "x", "Q", "7", "#", "tab", "one"]) for _ in range(rnd.randrange(1, 6)))
        got = guess_cost(value, words)
        if not secrets._DATE.search(value) and all(value[i] != value[i + 1] or value[i] != value[i + 2] for i in range(len(value) - 2)) and not any(value[i : i + 2].lower() in secrets._NEXT and value[i + 1 : i + 3].lower() in secrets._NEXT for i in range(len(value) - 2)):
            assert got == pytest.approx(cheapest(value, words)), value


def test_random_values_of_eight_characters_are_found_and_two_words_are_not():
    rnd, words = random.Random(4), known_words()
    found = lambda make, n=400: sum(guess_cost(make(), words) >= LEAST_COST for _ in range(n)) / n
    of = lambda letters, n: lambda: "".join(rnd.choice(letters) for _ in range(n))
    assert found(of(string.ascii_letters + string.digits + string.punctuation, 8)) > 0.95
    assert found(of(string.ascii_letters + string.digits, 8)) > 0.8
    assert found(of(string.ascii_lowercase + string.digits, 10)) > 0.95
    common = [w for w, rank in words.items() if rank < 15_000 and len(w) > 3 and w.isascii()]
    assert found(lambda: rnd.choice(common) + rnd.choice(common)) == 0
    assert found(lambda: rnd.choice(common) + rnd.choice("._-/") + rnd.choice(common)) == 0

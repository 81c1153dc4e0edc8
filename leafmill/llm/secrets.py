"""Secret scans: fixed patterns, and values next to a credential word that would be costly to guess.

The cost of a value is the least product of guesses over all ways to cut it into common words, dates, repeats, keyboard
walks and spans that only brute force finds, by dynamic programming over its places. A value that costs more than a
threshold is a secret; words of ordinary prose cost less.
"""

from __future__ import annotations

import json
import re
from base64 import b64decode
from collections.abc import Iterator, Mapping
from functools import cache
from math import log10
from pathlib import Path
from types import MappingProxyType

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: log10 of the guesses that make a value a secret: more than two words of the vocabularies take, and less than eight
#: characters of all kinds.
LEAST_COST = 9.0
#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the three base kinds. Upper and lower case count as equal in the credential word only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# What makes the text after it a credential value, for the method: a name that holds a credential word at any place, but not
# as the start of another word, as in author, passage or secretary. The name is taken as a whole, so each is read once.
_CREDENTIAL = r"""pass(?:word|wd|phrase|code|key)|pass(?-i:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))|pwd|secret(?!ar[iy]|ion|ive)|token(?!i[sz])|api[_-]?key|access[_-]?key|auth(?:ori[sz]ation)?(?!or|ent)|credential|private[_-]?key|bearer"""
CONTEXT = re.compile(rf"""(?<![A-Za-z0-9_-])(?ai:(?=[a-z0-9_-]*?(?:{_CREDENTIAL}))[a-z0-9_-]++)["']?\s{{0,4}}(?:[:=]|:=|=>)\s{{0,4}}["']?(?:(?ai:bearer|basic)\s)?([^\s"'<>,;]{{6,}})""")

# Words that guessers try first, in the order in which they try them.
COMMON = ("password", "123456", "qwerty", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "abc", "iloveyou", "sunshine", "princess", "football", "baseball", "shadow", "superman", "trustno", "hello", "freedom", "whatever", "secret", "token", "changeme", "default", "example", "test", "user", "root", "guest", "pass", "key", "api", "none", "null", "true", "false", "your", "here", "placeholder", "redacted", "unknown", "required", "missing", "string", "value", "field", "reset", "the", "and", "for", "with", "that", "this", "from", "of", "to", "in", "is", "it", "on", "or", "be", "are", "was", "not", "you", "der", "die", "und", "les", "des", "que", "los", "las", "una")
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0987654321", "poiuytrewq", "lkjhgfdsa", "mnbvcxz", "zyxwvutsrqponmlkjihgfedcba")
LEET = str.maketrans("430157$@", "aeoistsa")

_RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
_LONGEST = max(map(len, COMMON))
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._](?:0[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
#: Where words of prose can stand.
_PROSE = re.compile(r"[a-zA-ZÀ-￿]+")
#: Letters of the longest and, as a part of a run of letters, of the shortest word that is looked up.
_WORD_MOST, _PART_LEAST = 24, 4


@cache
def known_words() -> dict[str, int]:
    """Ranks of words of three letters and more that the tokenizers' vocabularies, English and multilingual, hold with a
    space before them, that is the frequent words of large corpora; in lower case. A vocabulary lists the more frequent
    ones first, and a word has the better of its ranks. No value of the scanned texts gets in."""
    vocabulary = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text("utf-8"))["model"]["vocab"]
    english = [" " + t[1:] for t in sorted(vocabulary, key=vocabulary.get) if t[0] == "Ġ" and t[1:].isascii()]
    lines = (line.split() for line in Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_text("ascii").splitlines())
    every = [b64decode(token).decode("utf-8", "replace") for token, _ in sorted(lines, key=lambda x: int(x[1]))]
    ranks: dict[str, int] = {}
    for tokens in (english, every):
        words = [t[1:].lower() for t in tokens if 3 < len(t) <= _WORD_MOST + 1 and t[0] == " " and _PROSE.fullmatch(t, 1) and "\ufffd" not in t]
        for rank, word in enumerate(dict.fromkeys(words), 1):
            ranks[word] = min(rank, ranks.get(word, rank))
    return ranks


def _single_costs(value: str) -> list[float]:
    """log10 of the guesses for each character on its own: as many as its kind has, marks that join words being one. A letter
    that goes on in the case of the one before takes ten, as runs of letters can mostly be spoken."""
    sizes, out, before = {"lower": 26, "upper": 26, "digit": 10, "joint": 4, "other": 29}, [], ""
    for c in value:
        kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "joint" if c in "._-/" else "other"
        out.append(1.0 if kind == before and kind in ("lower", "upper") else log10(sizes[kind]))
        before = kind
    return out


def guess_cost(value: str, words: Mapping[str, int] = MappingProxyType({})) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes. Linear in its length but for short words.

    A word of `words` in one case takes as many guesses as its rank, a hundred at least. Other runs of letters are brute force.
    """
    n, low = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, single = low.translate(LEET), _single_costs(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by start: (end, cost)
    for m in _DATE.finditer(value):
        ends[m.start()].append((m.end(), log10(365 * 120)))
    for m in _PROSE.finditer(value):
        a, b = m.span()
        for i in range(a, b):
            for j in range(i + 3, min(b, i + _WORD_MOST) + 1):
                if (j - i >= _PART_LEAST or (i, j) == (a, b)) and (rank := words.get(low[i:j])) and (value[i + 1 : j].islower() or value[i:j].isupper()):
                    ends[i].append((j, log10(max(100, rank))))
    i = 0
    while i < n:  # repeats of one character, and walks
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            ends[i].append((j, log10(90 * (j - i))))
        k = i + 1
        while k < n and low[k - 1 : k + 1] in _NEXT:
            k += 1
        if k - i >= 3:
            ends[i].append((k, log10(20 * (k - i))))
        i = max(j, k - 1, i + 1)
    for i in range(n):
        for m in range(3, min(_LONGEST, n - i) + 1):
            if rank := _RANK.get(low[i : i + m]) or _RANK.get(plain[i : i + m]):
                ends[i].append((i + m, log10(2 * rank + 10)))
    best = [float("inf")] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] + single[i] < best[i + 1]:  # brute force
            best[i + 1] = best[i] + single[i]
        for end, cost in ends[i]:
            if best[i] + cost < best[end]:
                best[end] = best[i] + cost
    return best[n]


def find_spans(text: str, least_cost: float, words: Mapping[str, int] = MappingProxyType({})) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], words) >= least_cost]
    return sorted(found)


_ITEM = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def with_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", least_cost: float = LEAST_COST) -> DataFrame:
    """docs with an array of (kind, start, end) in one more column: code points from 0, end exclusive, by start and kind.

    assign, access and hex are fixed patterns; guess is a credential value that takes 10**least_cost guesses or more.
    Null and empty texts have no spans. Whole texts are scanned, whatever their length. A column of the new one's name is
    replaced.
    """
    docs = docs.drop(into)
    at = docs.columns.index(text)
    words = docs.sparkSession.sparkContext.broadcast(known_words())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(KINDS[k], a, b) for a, k, b in find_spans(x, least_cost, words.value)] if x else [] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, _ITEM)]))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least_cost: float = LEAST_COST) -> DataFrame:
    """docs with each secret in text replaced by mark. Overlapping spans become one. Texts without secrets stay as they are."""
    at = docs.columns.index(text)
    words = docs.sparkSession.sparkContext.broadcast(known_words())

    def clean(x: str) -> str:
        out, done, last = [], 0, -1
        for a, _, b in find_spans(x, least_cost, words.value):
            if a < last:
                last = max(last, b)
            else:
                if last >= 0:
                    out.append(mark)
                    done = last
                out.append(x[done:a])
                last = b
        return "".join([*out, mark, x[last:]]) if last >= 0 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(x) if x else x for x in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

"""Quality rules: statistics of whole texts, and decision lists learned from labelled ones.

Rules are learned by sequential covering: on two thirds of the labelled rows a conjunction of thresholds is grown by
information gain, on the last third it is pruned from its end, and rows that it covers leave before the next one is
grown. The list becomes one Spark conditional expression, so applying it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.words import SPACE, covered, find_words, sizes, slices, whole, windows

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_BASE = 0x9E3779B97F4A7C15


def free_name(docs: DataFrame, name: str) -> str:
    """name, or a longer one that docs has no column of, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text, from arrays over all bytes of the batch; lines are compared text by text."""
    n = len(texts)
    words = find_words(texts)
    bytes_at = np.concatenate([[0], np.cumsum(sizes(texts))])
    size = int(bytes_at[-1])
    data = words.data[:size]

    def per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])

    def table(chars: bytes) -> np.ndarray:
        out = np.zeros(256, dtype=bool)
        out[list(chars)] = True
        return out[data]

    begins = (data & 0xC0) != 0x80  # of a code point
    total = len(words)
    owner, h = words.texts(), words.hashes()
    at = np.flatnonzero(whole(words.first, 3))
    keys = windows(h, 3, _BASE)[at] + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1] if len(keys) else same[1:-1]
    repeated = at[order[same[:-1] | same[1:]]] if len(keys) else at
    raw, lines, again = data.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist(), strict=True)):
        full = [x for x in raw[a:b].split(b"\n") if x.strip(SPACE)]
        lines[i], again[i] = len(full), len(full) - len(set(full))
    return {
        "n_words": words.counts(), "word_chars": per_text(begins & ~table(SPACE), bytes_at), "n_symbols": per_text(table(SYMBOLS), bytes_at), "n_dup_lines": again,
        "n_repeat_words": per_text(covered(repeated, 3, total), words.first), "n_lines": lines, "n_upper": per_text(table(bytes(range(65, 91))), bytes_at),
        "n_marks": per_text(table(b"!?.,;:"), bytes_at),
    }


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """docs with one more column, a struct of COUNTS. Words are runs of anything but ASCII white space.

    word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in three-word windows found twice or more in the text. Null texts count as empty.
    A column of the new one's name is replaced.
    """
    docs = docs.drop(into)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                counts = _statistics(part.column(at))
                struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], names=list(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.mapInArrow(run, schema)


#: What rules may test: only shares that depend neither on the length of a text nor on its language.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def features(stats: str) -> list[Column]:
    s = lambda c: F.col(f"{stats}.{c}").cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    values = (share(s("n_symbols"), s("n_words")), share(s("n_dup_lines"), s("n_lines")), share(s("n_repeat_words"), s("n_words")), share(s("n_upper"), s("word_chars")), share(s("n_marks"), s("n_words")))
    return [v.alias(n) for n, v in zip(FEATURES, values, strict=True)]


@dataclass(frozen=True)
class Test:
    """feature <= at, or feature > at."""

    feature: int
    at: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.at if self.above else x[:, self.feature] <= self.at


def _grow(x: np.ndarray, y: np.ndarray, longest: int) -> list[Test]:
    """Tests that, one after the other, gain most for the positive rows that they keep."""
    rule: list[Test] = []
    while len(rule) < longest and 0 < y.sum() < len(y):
        before = np.log2(y.mean())
        best: tuple[float, Test | None] = (1e-9, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, p = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            for above in (False, True):
                pos = (p[-1] - p[cut]) if above else p[cut]
                n = (len(v) - cut - 1) if above else cut + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / n) - before), 0)
                if len(gain) and gain.max() > best[0]:
                    k = cut[gain.argmax()]
                    best = (float(gain.max()), Test(j, float((v[k] + v[k + 1]) / 2), above))
        if best[1] is None:
            break
        rule.append(best[1])
        keep = best[1].holds(x)
        x, y = x[keep], y[keep]
    return rule


def _hit(rule: list[Test], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule], initial=True) if rule else np.zeros(len(x), bool)


def learn(x: np.ndarray, y: np.ndarray, max_rules: int = 16, longest: int = 4, precision: float = 0.98) -> list[list[Test]]:
    """An ordered list of rules for the rows where y is true. A rule that is less precise on the pruning rows ends it."""
    third = np.arange(len(y)) % 3 == 2
    rules: list[list[Test]] = []
    while len(rules) < max_rules and y[~third].any() and y[third].any():
        rule = _grow(x[~third], y[~third].astype(float), longest)
        worth = []
        for n in range(1, len(rule) + 1):
            hit = y[third][_hit(rule[:n], x[third])]
            worth.append((2 * hit.sum() - len(hit)) / len(hit) if len(hit) else -1.0)
        if not worth:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = _hit(rule, x)
        held = y[third & hit]
        if not len(held) or held.mean() < precision:
            break
        rules.append(rule)
        x, y, third = x[~hit], y[~hit], third[~hit]
    return rules


def verdict(rules: list[list[Test]], stats: str) -> Column:
    """False where a rule holds, true elsewhere: the rules in order, as one conditional expression."""
    cols = {n: c for n, c in zip(FEATURES, features(stats), strict=True)}
    out = None
    for rule in rules:
        cond = F.lit(True)
        for t in rule:
            c = cols[FEATURES[t.feature]]
            cond = cond & ((c > t.at) if t.above else (c <= t.at))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str) -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col(f"{stats}.n_words") < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * F.col(f"{stats}.n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> list[list[Test]]:
    """Rules for documents labelled 0. At most max_rows labelled rows are used, those with the least hashes of their keys,
    and of these only documents that pass the base rules.

    Rows without key or label are left out. With no rows of either kind the list is empty and keeps every document.
    """
    known = labels.select(F.col(key).alias("key"), (F.col(label) == 0).alias("bad")).dropna().orderBy(F.xxhash64("key"), "key").limit(max_rows)
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = with_statistics(held).filter(~base_failed("stats")).select("key", "bad", *features("stats")).orderBy(F.xxhash64("key"), "key", *FEATURES).limit(max_rows).toPandas()
    return learn(rows[list(FEATURES)].to_numpy(float), rows["bad"].to_numpy(bool)) if len(rows) else []


def judge(docs: DataFrame, rules: list[list[Test]], text: str = "text", into: str = "kept", stats: str = "stats", failed: str = "base_failed") -> DataFrame:
    """docs with their statistics, whether the base rules fail, and the verdict, in three more columns of these names."""
    fails = base_failed(stats)
    return with_statistics(docs, text, stats).withColumns({failed: fails, into: ~fails & verdict(rules, stats)})

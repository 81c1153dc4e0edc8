"""Benchmark decontamination: suffix arrays of the training texts, searched for every suffix of the test items.

Each task cuts its texts into shards of bounded size and builds a suffix array of each, at the level of words. A suffix
ends at the first word that no test item has, since no match reaches beyond it, and suffixes too short for any window
are left out; both lose nothing. Every test suffix is searched in every shard by bisection, all at once: the range of
training suffixes that begin with its window gives all places where the window stands, and places that continue one
another make a longest verbatim match. Nothing is shuffled: the test items travel to the texts, in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.words import NOT_ALNUM, find_words, slices

#: Words of an item that make a window.
SIZE = 10


@dataclass
class Tests:
    """Test items as numbers of words, from 1. suffix[k] is (item, start) of the first of all windows with the same words and
    size[k] is their number; owners[edges[k]:edges[k + 1]] are the items that have such a window."""

    names: list[str]
    vocabulary: np.ndarray
    items: list[np.ndarray]
    suffix: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    edges: np.ndarray

    @property
    def bits(self) -> int:
        """Of a word's number in a key."""
        return max(1, int(len(self.vocabulary)).bit_length())


def prepare(names: list[str], texts: list[str | None], size: int = SIZE) -> Tests:
    words = find_words(pa.array(texts, pa.large_string()), NOT_ALNUM, lower=True)
    h = words.hashes()
    vocabulary = np.unique(h)
    number = np.searchsorted(vocabulary, h) + 1
    items = [number[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    pairs = [(i, j) for i, item in enumerate(items) for j in range(max(1, len(item) - size + 1) if len(item) else 0)]
    suffix = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    sizes = np.array([min(size, len(items[i])) for i, _ in pairs], dtype=np.int64)
    flat = np.concatenate([*items, np.zeros(1, np.int64)])
    base = np.concatenate([[0], np.cumsum([len(x) for x in items])])[suffix[:, 0]] + suffix[:, 1]
    windows = np.stack([np.where(j < sizes, flat[np.minimum(base + j, len(flat) - 1)], 0).astype(np.int32) for j in range(size)])
    order = np.lexsort(windows[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (windows[:, order[1:]] != windows[:, order[:-1]]).any(axis=0)
    owned = np.unique((np.cumsum(new) - 1) * max(1, len(items)) + suffix[order, 0])
    edges = np.searchsorted(owned, np.arange(int(new.sum()) + 1) * max(1, len(items)))
    first = order[new]  # the order is stable, so it is the first item of each that has the window
    return Tests(names, vocabulary, items, suffix[first], sizes[first], owned % max(1, len(items)), edges)


def _keys(sequence: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """As many words from each place on as fit into 64 bits, in order; all zero after the first zero."""
    key, alive = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for j in range(64 // bits):
        w = sequence[np.minimum(at + j, len(sequence) - 1)]
        alive &= w > 0
        key = (key << np.uint64(bits)) | np.where(alive, w, 0).astype(np.uint64)
    return key


def suffix_array(sequence: np.ndarray, places: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """places in the order of what follows them, up to a zero or `longest` words. The sequence ends with a zero."""
    step, order = 64 // bits, places
    group, open_ = np.zeros(len(places), np.int64), np.ones(len(places), bool)
    for depth in range(0, longest, step):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        keys = _keys(sequence, order[at] + depth, bits)
        by = np.lexsort((keys, group[at]))
        order[at], keys = order[at][by], keys[by]  # groups are ranges, so this moves places within theirs only
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (group[at][1:] != group[at][:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(at))
        group[at] = at[np.repeat(first, sizes)]
        open_[at] = np.repeat(sizes > 1, sizes) & ((keys & np.uint64((1 << bits) - 1)) > 0)
    return order


def search(sequence: np.ndarray, array: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix, the range of the array whose suffixes begin with its window."""
    bits, n = tests.bits, len(tests.suffix)
    step = 64 // bits
    items = np.concatenate([*tests.items, np.zeros(1, np.int64)])
    base = np.concatenate([[0], np.cumsum([len(x) for x in tests.items])])[tests.suffix[:, 0]] + tests.suffix[:, 1]
    low, high = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    for depth in range(0, int(tests.size.max(initial=0)), step):
        held = np.clip(tests.size - depth, 0, step)  # words of the window in this key
        at = np.flatnonzero((held > 0) & (low < high))
        key = np.zeros(len(at), np.uint64)
        for j in range(step):
            w = np.where(j < held[at], items[np.minimum(base[at] + depth + j, len(items) - 1)], 0)
            key = (key << np.uint64(bits)) | w.astype(np.uint64)
        rest = ((step - held[at]) * bits).astype(np.uint64)
        for bound, top in ((low, False), (high, True)):
            want = key | ((np.uint64(1) << rest) - np.uint64(1)) if top else key
            a, b = low[at].copy(), high[at].copy()
            while (going := np.flatnonzero(a < b)).size:
                mid = (a[going] + b[going]) // 2
                here = _keys(sequence, array[mid] + depth, bits)
                right = here <= want[going] if top else here < want[going]
                a[going] = np.where(right, mid + 1, a[going])
                b[going] = np.where(right, b[going], mid)
            if top:
                high[at] = a
            else:
                found = a
        low[at] = found
    return low, high


def match(texts: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Words of each text, rows (text, start, item, start there, words) of longest verbatim matches, sorted, and the items
    of each text. A window of several items makes matches of the first one only, so a place has one for each size at most."""
    words = find_words(texts, NOT_ALNUM, lower=True)
    h, n = words.hashes(), len(texts)
    at = np.minimum(np.searchsorted(tests.vocabulary, h), max(0, len(tests.vocabulary) - 1))
    number = np.where(tests.vocabulary[at] == h, at + 1, 0) if len(tests.vocabulary) else np.zeros(len(h), np.int64)
    sequence = np.zeros(len(h) + n + 1, np.int64)  # a zero after each text
    place = np.arange(len(h)) + words.texts()
    sequence[place] = number
    ends = np.flatnonzero(sequence == 0)
    run = ends[np.searchsorted(ends, place)] - place
    least = int(tests.size.min(initial=1 << 30))
    array = suffix_array(sequence, place[run >= least], tests.bits, max(map(len, tests.items), default=0))
    low, high = search(sequence, array, tests)
    hits = high - low
    k = np.repeat(np.arange(len(hits)), hits)
    p = array[np.repeat(low, hits) + np.arange(len(k)) - np.repeat(np.cumsum(hits) - hits, hits)]
    item, there = tests.suffix[k, 0], tests.suffix[k, 1]
    starts = words.first[:-1] + np.arange(n)  # of texts in the sequence
    pairs = np.unique((np.searchsorted(starts, p, side="right") - 1) * max(1, len(tests.suffix)) + k)
    owners = [[] for _ in range(n)]
    for text, window in zip((pairs // max(1, len(tests.suffix))).tolist(), (pairs % max(1, len(tests.suffix))).tolist(), strict=True):
        owners[text].append(tests.owners[tests.edges[window] : tests.edges[window + 1]])
    found = [np.unique(np.concatenate(x)).tolist() if x else [] for x in owners]
    order = np.lexsort((there, p - there, item))
    item, there, p, size = item[order], there[order], p[order], tests.size[k][order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (there[1:] != there[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    text = np.searchsorted(starts, p[first], side="right") - 1
    rows = np.stack([text, p[first] - starts[text] if n else text, item[first], there[first], last - first + size[first]], axis=1)
    return words.counts(), rows[np.lexsort(rows.T[::-1])], found


_MATCH = ("item", "item_start", "start", "words")
_OUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *(T.StructField(c, T.LongType()) for c in _MATCH[1:])]))),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item", pa.string()), *((c, pa.int64()) for c in _MATCH[1:])])))])


def with_matches(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "contamination", size: int = SIZE, part_bytes: int = 32 << 20) -> DataFrame:
    """docs with a struct in one more column: n_words, n_hit, items and matches.

    A window is `size` consecutive words of an item, or all words of a shorter one. n_hit counts the words inside any
    place where a window stands, items lists the items that own these windows, as distinct sorted strings, and matches
    has the longest verbatim matches as (item, item_start, start, words), counted in words from 0; of items that share a
    window the first one of a part is named there, so a text has no more of them than places times sizes. Words are runs of
    ASCII letters and digits and of characters outside ASCII, A-Z in lower case. Null texts and items have none; items
    without a name or words match nothing. Test texts of more than part_bytes are searched for in several parts.
    A column of the new one's name is replaced.
    """
    docs = docs.drop(into)
    rows = tests.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text")).dropna()
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("name")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // part_bytes))
    out, spark = docs, docs.sparkSession
    for part in range(parts):
        held = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part).toPandas()
        shared = spark.sparkContext.broadcast(vars(prepare(held["name"].tolist(), held["text"].tolist(), size)))
        out = _with_part(out, shared, text, into, first=part == 0)
    return out


def _with_part(docs: DataFrame, shared, text: str, into: str, first: bool) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(**shared.value)
        for whole in batches:
            for a, b in slices(whole.column(at), 1 << 22):
                batch = whole.slice(a, b - a)
                counts, rows, owners = match(batch.column(at), tests)
                before = [] if first else batch.column(batch.schema.names.index(into)).to_pylist()
                found: list[list[dict]] = [x["matches"] for x in before] or [[] for _ in counts]
                items = [{tests.names[k] for k in x} for x in owners]
                for i, start, item, there, size in rows.tolist():
                    found[i].append({"item": tests.names[item], "item_start": there, "start": start, "words": size})
                items = [x.union(y["items"]) for x, y in zip(items, before, strict=True)] if before else items
                values = [{"n_words": n, "n_hit": _union([(m["start"], m["words"]) for m in f]), "items": sorted(x), "matches": f} for n, f, x in zip(counts.tolist(), found, items, strict=True)]
                kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if first or n != into]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(values, _ARROW)], names=[*(n for _, n in kept), into])

    fields = [f for f in docs.schema.fields if first or f.name != into]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(into, _OUT)]))


def _union(spans: list[tuple[int, int]]) -> int:
    """Places in any span (start, length)."""
    total = end = 0
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def decontaminate(docs: DataFrame, tests: DataFrame, into: str = "contamination", **options) -> DataFrame:
    """docs without those in which a window of a test item stands; options as with_matches has them."""
    return with_matches(docs, tests, into=into, **options).filter(F.col(f"{into}.n_hit") == 0).drop(into)

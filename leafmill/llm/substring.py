"""Removing passages that repeat across documents.

A count-min sketch finds the windows that may occur more than once; only those are then grouped exactly:

1. each block of documents sends its sketch, as sorted cells with a bit for "twice or more here", to the shards of
   the sketch;
2. each shard adds up its counters over all blocks and answers with a bit a cell: "twice or more in all". Counters
   can only be too high, so no repeated window is lost;
3. a block keeps the windows whose cells are all marked, and sends the first place of each distinct one, under a
   96-bit hash, to the shards of the windows;
4. each shard finds the first place over all blocks and answers with a bit a window: "starts earlier elsewhere";
5. a block now knows which of its windows start earlier, and removes the words that these cover.

The texts are shuffled once, as blocks; what steps 1 to 4 exchange is about two bytes a window and sketch row, and
some 18 bytes for a repeated window and block. Nothing passes through the driver but the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.blocks import block_count, in_blocks, text_size
from leafmill.llm.store import stored
from leafmill.llm.words import covered, find_words, mix, slices, whole, windows

_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_LAST = np.int64(2**63 - 1)
_SIDE = "block int, kind int, shard int, bits binary"


class _Block:
    """The windows of a block, in the order of (document, start)."""

    def __init__(self, table: pa.Table, size: int):
        keys = table["key"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.texts = table["text"].combine_chunks().take(pa.array(self.order))
        hashes, seconds, starts, docs, counts, valid = [], [], [], [], [], []
        base = 0
        for a, b in slices(self.texts):
            words = find_words(self.texts.slice(a, b - a))
            ok = np.flatnonzero(whole(words.first, size))
            hashes.append(windows(words.hashes(1), size, _BASES[0])[ok])
            seconds.append((windows(words.hashes(2), size, _BASES[1])[ok] >> np.uint64(32)).astype(np.uint32))
            owner = words.texts()[ok]
            docs.append((owner + a).astype(np.int32))
            starts.append((ok - words.first[owner]).astype(np.int32))
            valid.append(ok + base)
            counts.append(words.counts())
            base += len(words)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.hash, self.second = mix(join(hashes, np.uint64)), join(seconds, np.uint32)
        self.doc, self.start, self.place = join(docs, np.int32), join(starts, np.int32), join(valid, np.int64)
        self.counts = join(counts, np.int64)

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the windows in a row of the sketch, sorted, and the windows in that order."""
        n = np.uint64(max(1, len(self.hash)).bit_length())
        cell = (self.hash if not row else mix(self.hash + np.uint64(row))) >> np.uint64(64 - bits)
        both = np.sort((cell << n) | np.arange(len(cell), dtype=np.uint64))
        return both >> n, (both & ((np.uint64(1) << n) - np.uint64(1))).astype(np.int64)

    def candidates(self, side: dict[tuple[int, int], bytes], depth: int, bits: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that may repeat, sorted by hash, place; where each distinct one begins among them; its number for each."""
        may = np.ones(len(self.hash), dtype=bool)
        for row in range(depth):
            cells, order = self.cells(row, bits)
            new, shard = _new(cells), cells >> np.uint64(bits - shard_bits)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(shard[new].astype(np.int64), minlength=1 << shard_bits))])
            marked = [np.unpackbits(np.frombuffer(side[row, s], np.uint8), count=int(n)) for s, n in enumerate(np.diff(cuts)) if n]
            here = np.concatenate([np.zeros(0, np.uint8), *marked]).astype(bool)[np.cumsum(new) - 1]
            may[order[~here]] = False
        at = np.flatnonzero(may)
        at = at[np.lexsort((self.second[at], self.hash[at]))]
        new = _new(self.hash[at]) | _new(self.second[at])
        return at, np.flatnonzero(new), np.cumsum(new) - 1


def _new(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in as few bytes each as the largest needs."""
    d = np.diff(x, prepend=x[:1] * 0).astype(np.uint64)
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if not len(d) or int(d.max()) <= np.iinfo(k).max)
    return kind[-1].encode() + d.astype(kind).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, dtype=f"<u{x[:1].decode()}", offset=1).astype(np.uint64)).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from the least one on, in as few bytes each as the largest needs."""
    low = int(x.min()) if len(x) else 0
    high = int(x.max()) - low if len(x) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if high <= np.iinfo(k).max)
    return kind[-1].encode() + np.int64(low).tobytes() + (x.astype(np.uint64) - np.uint64(low & (2**64 - 1))).astype(kind).tobytes()


def _widen(x: bytes) -> np.ndarray:
    low = int(np.frombuffer(x, np.int64, 1, 1)[0])
    return (np.frombuffer(x, dtype=f"<u{x[:1].decode()}", offset=9).astype(np.uint64) + np.uint64(low & (2**64 - 1))).astype(np.int64)


def _table(columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    return pa.table({k: pa.array(v, kind) for k, (kind, v) in columns.items()})


def remove_repeats(docs: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text", depth: int = 2, load: float = 0.25, block_chars: int = 8_000_000) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_text): each text without the words of windows that start earlier.

    A window is `size` consecutive words (runs of anything but ASCII white space) of one document. It starts earlier if
    the same words begin in a document with a smaller key, or further ahead in the same one. Words in such a window go;
    the others are joined by one space. depth and load are the rows of the sketch and its windows a cell.

    Null or empty texts have no words and give an empty text; texts shorter than a window stay whole. Rows with a null
    key come after all others. Rows that repeat a key count as one document written again: they don't make each other's
    windows earlier at the same start. Keys that aren't whole numbers are first ranked, each once, by a sort. Other columns
    are ignored.
    """
    if not isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        keys = stored(docs.select(F.col(key).alias("_key")).distinct().orderBy(F.col("_key").asc_nulls_last()).withColumn("_rank", F.monotonically_increasing_id()), "ranked")
        numbered = docs.select(F.col(key).alias("_own"), F.col(text).alias("text")).join(keys, F.col("_own").eqNullSafe(F.col("_key"))).select("_rank", "text")
        out = remove_repeats(numbered, size, "_rank", "text", depth, load, block_chars)
        return out.join(keys, "_rank").select(F.col("_key").alias(key), "n_words", "n_removed", "kept_text")
    chars = text_size(docs, text)
    blocks = block_count(chars, block_chars)
    shard_bits = max(5, (blocks - 1).bit_length())
    bits = max(shard_bits + 8, int(max(1, chars / 6) / load).bit_length())
    kind = docs.schema[key].dataType
    texts = in_blocks(docs.withColumn(key, F.col(key).cast("long")), blocks, key, text)

    def sketch(table: pa.Table) -> pa.Table:
        block, name = _Block(table, size), table["block"][0].as_py()
        out: list[tuple] = []
        for row in range(depth):
            cells, _ = block.cells(row, bits)
            at = np.flatnonzero(_new(cells))
            twice = np.diff(at, append=len(cells)) > 1
            cells = cells[at]
            cuts = np.searchsorted(cells, np.arange((1 << shard_bits) + 1, dtype=np.uint64) << np.uint64(bits - shard_bits))
            low = np.uint64((1 << bits - shard_bits) - 1)
            out += [(row, s, name, _pack(cells[a:b] & low), np.packbits(twice[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return _table({k: (t, [x[i] for x in out]) for i, (k, t) in enumerate((("row", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary())))})

    def merge(table: pa.Table) -> pa.Table:
        """Adds up one shard of one row; counters stop at 2."""
        counters = np.zeros(1 << bits - shard_bits, dtype=np.uint8)
        names, cells, twice = (table[k].to_pylist() for k in ("block", "cells", "twice"))
        for c, t in zip(cells, twice, strict=True):
            at = _unpack(c)
            counters[at] = np.minimum(2, counters[at] + 1 + np.unpackbits(np.frombuffer(t, np.uint8), count=len(at)))
        bitmaps = [np.packbits(counters[_unpack(c)] > 1).tobytes() for c in cells]
        n = len(names)
        return _table({"block": (pa.int32(), names), "kind": (pa.int32(), table["row"].to_pylist()), "shard": (pa.int32(), table["shard"].to_pylist()), "bits": (pa.binary(), bitmaps)}) if n else None

    def sides(table: pa.Table) -> dict[tuple[int, int], bytes]:
        return dict(zip(zip(table["kind"].to_pylist(), table["shard"].to_pylist(), strict=True), table["bits"].to_pylist(), strict=True))

    def firsts(table: pa.Table, marks: pa.Table) -> pa.Table:
        columns = ("shard", pa.int32()), ("block", pa.int32()), ("hash", pa.binary()), ("second", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())
        out: list[tuple] = []
        if table.num_rows:
            block, name = _Block(table, size), table["block"][0].as_py()
            at, new, _ = block.candidates(sides(marks), depth, bits, shard_bits)
            at = at[new]
            h = block.hash[at]
            cuts = np.searchsorted(h, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)).tolist() + [len(h)]
            doc, start = block.keys[block.doc[at]], block.start[at]
            out = [(s, name, h[a:b].tobytes(), block.second[at[a:b]].tobytes(), _narrow(doc[a:b]), _narrow(start[a:b].astype(np.int64))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return _table({k: (t, [x[i] for x in out]) for i, (k, t) in enumerate(columns)})

    def group(table: pa.Table) -> pa.Table:
        """For each block's windows in one shard: whether the first place of all is another block's."""
        names = table["block"].to_pylist()
        h = [np.frombuffer(x, np.uint64) for x in table["hash"].to_pylist()]
        cuts = np.cumsum([0, *map(len, h)])
        h = np.concatenate(h)
        second = np.concatenate([np.frombuffer(x, np.uint32) for x in table["second"].to_pylist()])
        doc, start = (np.concatenate([_widen(x) for x in table[k].to_pylist()]) for k in ("doc", "start"))
        order = np.lexsort((start, doc, second, h))
        earlier = np.zeros(len(h), dtype=bool)
        earlier[order] = ~(_new(h[order]) | _new(second[order]))
        n = len(names)
        return _table({"block": (pa.int32(), names), "kind": (pa.int32(), [-1] * n), "shard": (pa.int32(), table["shard"].to_pylist()), "bits": (pa.binary(), [np.packbits(earlier[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])})

    def clean(table: pa.Table, marks: pa.Table) -> pa.Table:
        n_words, n_removed, kept, keys = [], [], [], []
        if table.num_rows:
            block, side = _Block(table, size), sides(marks)
            at, new, number = block.candidates(side, depth, bits, shard_bits)
            h = block.hash[at[new]]
            cuts = np.searchsorted(h, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)).tolist() + [len(h)]
            bitmaps = [np.unpackbits(np.frombuffer(side[-1, s], np.uint8), count=b - a) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            elsewhere = np.concatenate([np.zeros(0, np.uint8), *bitmaps]).astype(bool)
            first = at[new][number] if len(at) else at
            later = (block.keys[block.doc[at]] > block.keys[block.doc[first]]) | (block.start[at] > block.start[first]) & (block.keys[block.doc[at]] == block.keys[block.doc[first]])
            gone = covered(block.place[at[elsewhere[number] | later]], size, int(block.counts.sum()))
            ends = np.cumsum(block.counts)
            keys = table["key"].combine_chunks().take(pa.array(block.order))
            n_words = block.counts
            n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
            for text, out, a, b in zip(block.texts, n_removed.tolist(), (ends - block.counts).tolist(), ends.tolist(), strict=True):
                all_words = (text.as_py() or "").encode().split()
                kept.append(b" ".join([w for w, g in zip(all_words, gone[a:b].tolist(), strict=True) if not g] if out else all_words).decode())
        return pa.table({"key": pa.array(keys, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    marks = texts.groupBy("block").applyInArrow(sketch, "row int, shard int, block int, cells binary, twice binary").groupBy("row", "shard").applyInArrow(merge, _SIDE)
    places = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(firsts, "shard int, block int, hash binary, second binary, doc binary, start binary")
    answers = marks.unionByName(places.groupBy("shard").applyInArrow(group, _SIDE))
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(clean, "key long, n_words long, n_removed long, kept_text string")
    return out.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "kept_text")

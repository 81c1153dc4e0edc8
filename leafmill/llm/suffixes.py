"""Removing every byte of a string that occurs twice or more, by merging the Burrows-Wheeler transforms of shards.

Texts are parsed at places that their content alone chooses (a hash of the bytes there is the least around), so equal
strings are parsed alike. A phrase runs from one place to the next; the suffixes are those of the sequences of phrases, and
a symbol is the hash of a phrase. A shard is a block of documents. It sorts its own suffixes once and keeps the transform:
for each rank the first symbol and the rank of the suffix after it.

The transforms are merged by refining their interleave one symbol at a time. After h rounds each suffix of a shard carries
the number of its interval, in the merged order by h symbols. For one more, the shard walks its ranks in order and sends
(first symbol, interval of the suffix after it), once for each that differs, to the bucket of the symbol; streams arrive
sorted as the local order is, the bucket merges them, numbers the intervals that result and answers with the numbers. An
interval of one suffix ends there: its depth is the common prefix of this suffix with any other, in phrases, and it is not
sent again. So no suffix is sorted but in its own shard, and only repeated intervals travel. Rounds go on until no repeated
interval is shorter than what the smallest window shares.

Common prefixes bound which windows of `size` bytes may repeat. Each window belongs to the first place in its inner part;
all windows of a place make an extent. Extents are grouped by the bytes around their place: where all extents of a group
are the same, its count settles them. Else one holder of each sends its windows one by one, as 96-bit hashes, which settles
those at the edges of what repeats. Windows without a place in their inner part are sent likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blocks import block_count, text_size
from leafmill.llm.store import stored
from leafmill.llm.words import covered, mix, slices

_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FAR = np.int64(1) << np.int64(40)
_SENT = "bucket int, block int, a binary, b binary, c binary, many binary"
_SIDE = "block int, kind int, bucket int, bits binary"
_STATE = "block int, open long, depth binary, place binary, after binary, gap binary, reach binary, first binary, interval binary"


class Bytes:
    """The bytes of texts, one after another, and hashes of any of their substrings."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.edges = offsets - offsets[0]
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of data[start:end]: differences of running sums of letters times powers of a base, brought to one power."""
        while len(self.sums) <= which:
            base = _BASES[len(self.sums)]
            up, down = (np.full(len(self.data) + 1, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_LETTERS[self.data] * np.cumprod(up)[:-1], out=sums[1:])
            self.sums.append((sums, np.cumprod(down)))
        sums, down = self.sums[which]
        return mix((sums[ends] - sums[starts]) * down[starts])


class Places:
    """Places of texts: where the hash of `gram` bytes is less than all others within `radius`, all of it inside the text."""

    def __init__(self, texts: pa.Array, size: int):
        self.size, self.radius = size, max(1, size // 12)
        self.gram = min(16, self.radius)
        #: A window's place is at most so far from its start.
        self.inner = size - self.gram - self.radius
        self.bytes = Bytes(texts)
        n, r, k = len(self.bytes.data), self.radius, self.gram
        self.at = np.zeros(0, np.int64)
        if n >= 2 * r + k:
            grams = np.arange(n - k + 1)
            h = (self.bytes.hashes(grams, grams + k) >> np.uint64(32)).astype(np.uint32)
            least, width = h, 1
            while 2 * width <= r:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            if width < r:
                least = np.minimum(least[: len(h) - r + 1], least[r - width :])
            mid = h[r : len(h) - r]
            self.at = np.flatnonzero((mid < least[: len(mid)]) & (mid < least[r + 1 : r + 1 + len(mid)])) + r
        edges = self.bytes.edges
        self.text = np.searchsorted(edges, self.at, side="right") - 1
        whole = (self.at - r >= edges[self.text]) & (self.at + r + k <= edges[self.text + 1]) & (edges[self.text + 1] - edges[self.text] >= size)
        self.at, self.text = self.at[whole], self.text[whole]
        #: Bytes to the next place of the same text; none follows the last.
        same = np.append(self.text[1:] == self.text[:-1], False) if len(self.at) else np.zeros(0, bool)
        self.gap = np.where(same, np.append(self.at[1:], 0)[: len(self.at)] - self.at, 0)

    def symbols(self) -> np.ndarray:
        """A hash for each phrase; 0 where no phrase ends in the text."""
        found = self.bytes.hashes(self.at, self.at + self.gap) | np.uint64(1)
        return np.where(self.gap > 0, found, np.uint64(0))

    def spans(self, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows of each place that may repeat: depth phrases from it occur once (0: never)."""
        edges, n = self.bytes.edges, len(self.at)
        before = np.where(np.append(False, self.text[1:] == self.text[:-1])[:n], np.append(0, self.at[:-1])[:n], -_FAR)
        low = np.maximum.reduce([edges[self.text], before - self.radius + 1, self.at - self.inner])
        high = np.minimum(self.at - self.radius, edges[self.text + 1] - self.size)
        last = np.searchsorted(self.text, self.text, side="right") - 1  # last place of the same text
        end = np.arange(n) + depth
        once = (depth > 0) & (end <= last)
        shared = np.where(once, self.at[np.where(once, end, 0)] - self.at, _FAR)
        return low, np.minimum(high, self.at - self.inner + shared - 1)

    def without_place(self) -> np.ndarray:
        """Starts of windows in whose inner part no place lies."""
        edges = self.bytes.edges
        n = len(self.bytes.data)
        if n < self.size:
            return np.zeros(0, np.int64)
        change = np.zeros(n + 2, np.int32)
        keep = np.flatnonzero(np.diff(edges) >= self.size)
        np.add.at(change, edges[keep], 1)
        np.add.at(change, edges[keep + 1] - self.size + 1, -1)
        low, high = self.spans(np.zeros(len(self.at), np.int64))
        some = high >= low
        np.add.at(change, low[some], -1)
        np.add.at(change, high[some] + 1, 1)
        return np.flatnonzero(np.cumsum(change[:n]) > 0)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, the first one foremost, and where each new one begins in it."""
    order = np.lexsort(keys[::-1])
    return order, _new(*(k[order] for k in keys))


def _new(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _numbers(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, kind)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind[-1].encode() + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[:1].decode()}", offset=1)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _send(block: int, bits: int, many: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, c: np.ndarray | None = None) -> list[tuple]:
    """Ascending distinct entries of a block, for the buckets of their first 64-bit key; many: whether the block has two or more."""
    cuts = _cuts(a, bits)
    part = lambda x, i, j: x[i:j].tobytes() if x is not None else b""
    return [(k, block, part(a, i, j), part(b, i, j), part(c, i, j), np.packbits(many[i:j]).tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]


def _cuts(a: np.ndarray, bits: int) -> list[int]:
    return [*np.searchsorted(a, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(a)]


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries that a bucket has got: three keys (zeros for those not sent), whether there are many, and cuts between blocks."""
    a = [_numbers(x, "<u8") for x in table["a"].to_pylist()]
    cuts = np.cumsum([0, *map(len, a)])
    join = lambda column, kind: np.concatenate([_numbers(x, kind) if x else np.zeros(len(k), kind) for x, k in zip(table[column].to_pylist(), a, strict=True)])
    many = np.concatenate([np.unpackbits(_numbers(x, np.uint8), count=len(k)) for x, k in zip(table["many"].to_pylist(), a, strict=True)])
    return np.concatenate(a), join("b", "<u8"), join("c", "<u4"), many, cuts


def _answers(table: pa.Table, kind: int, bits: list[bytes]) -> pa.Table:
    return _rows(_SIDE, [(block, kind, bucket, x) for block, bucket, x in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), bits, strict=True)])


def _merge_intervals(bits: int):
    """A bucket's part of a round: intervals of the merged order that hold two suffixes or more, numbered in order."""

    def run(table: pa.Table) -> pa.Table:
        a, b, _, many, cuts = _received(table)
        order, new = _distinct(a, b)
        group = np.cumsum(new) - 1
        shared = np.bincount(group, 1 + many[order], len(order)) >= 2
        number = np.where(shared, np.cumsum(shared), 0)
        out = np.zeros(len(a), np.uint64)
        out[order] = number[group].astype(np.uint64)
        return _answers(table, 1, [_narrow(out[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def _decide_extents(table: pa.Table) -> pa.Table:
    """Bit 0: the extent occurs twice or more. Bit 1: this block sends its windows, as others of the group differ."""
    a, b, c, many, cuts = _received(table)
    block = np.repeat(np.array(table["block"].to_pylist()), np.diff(cuts))
    order, new = _distinct(a, b, c, block)
    first = _new(a[order], b[order], c[order])  # entries are distinct in a block, so all are new in that order
    extent, group = np.cumsum(first) - 1, np.cumsum(_new(a[order])) - 1
    twice = (np.bincount(extent, 1 + many[order]) >= 2)[extent]
    differ = (np.bincount(group, first) >= 2)[group]
    out = np.zeros(len(a), np.uint8)
    out[order] = twice + 2 * (differ & first)
    return _answers(table, 2, [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _decide_windows(table: pa.Table) -> pa.Table:
    a, _, c, many, cuts = _received(table)
    order, new = _distinct(a, c)
    group = np.cumsum(new) - 1
    out = np.zeros(len(a), np.uint8)
    out[order] = (np.bincount(group, 1 + many[order]) >= 2)[group]
    return _answers(table, 3, [np.packbits(out[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _local_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of a block in the order of their symbols; a text's last one, which has no symbol, is unlike all others."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    rank[ends] = n + np.arange(int(ends.sum()))
    step = 1
    while step < n:
        after = np.append(rank[step:], np.zeros(min(step, n), np.int64))
        new = np.unique(rank * (2 * n + 1) + after, return_inverse=True)[1]
        if int(new.max()) + 1 == n or np.array_equal(new, rank):
            return np.argsort(new, kind="stable")
        rank, step = new, 2 * step
    return np.argsort(rank, kind="stable")


class _Shard:
    """The transform of a block. By rank: first symbol, rank of the suffix after it, bytes of its first phrase."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        rows = table.select(["symbols", "gaps"]).take(pa.array(order)).to_pylist()
        symbols = np.concatenate([np.zeros(0, np.uint64), *(_numbers(r["symbols"], "<u8") for r in rows)])
        gaps = np.concatenate([np.zeros(0, np.int64), *(_numbers(r["gaps"], "<i4").astype(np.int64) for r in rows)])
        self.place = _local_order(symbols)
        rank = np.empty(len(symbols), np.int64)
        rank[self.place] = np.arange(len(symbols))
        self.symbol, self.gap = symbols[self.place], gaps[self.place]
        self.after = np.append(rank, -1)[self.place + 1]
        self.some = np.flatnonzero(self.symbol)  # all but the texts' last ones; their ranks ascend by symbol

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct symbol begins among `some`, and its number for each of them."""
        new = _new(self.symbol[self.some])
        return np.flatnonzero(new), np.cumsum(new) - 1


def _ids(numbers: list[tuple[int, np.ndarray]], bits: int) -> np.ndarray:
    """Intervals as one number: the bucket in the top bits, then the number there. 0 stays 0: a suffix by itself."""
    return np.concatenate([np.zeros(0, np.uint64), *(np.where(x > 0, (np.uint64(k) << np.uint64(64 - bits)) + x.astype(np.uint64), np.uint64(0)) for k, x in numbers)])


def _state(block: int, rounds: int, limit: int, depth: np.ndarray, keep: np.ndarray, place: np.ndarray, after: np.ndarray, gap: np.ndarray, reach: np.ndarray, first: np.ndarray, interval: np.ndarray) -> tuple:
    """A block's row: the suffixes that are not alone, in order. after is the next one's place among them, or -1 where it is alone."""
    depth[place[~keep]] = rounds
    renumbered = np.append(np.where(keep, np.cumsum(keep) - 1, -1), -1)
    arrays = place.astype("<i4"), renumbered[after].astype("<i4"), gap.astype("<i4"), reach.astype("<i4"), first, interval
    return (block, int((reach[keep] <= limit).sum()), depth.tobytes(), *(x[keep].tobytes() for x in arrays))


def _parts(row: dict) -> dict[str, np.ndarray]:
    kinds = {"place": "<i4", "after": "<i4", "gap": "<i4", "reach": "<i4", "first": "<u8", "interval": "<u8"}
    return {k: _numbers(row[k], t).astype(np.int64) if t == "<i4" else _numbers(row[k], t) for k, t in kinds.items()}


def _round_entries(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step through the transform: suffixes whose next one isn't alone, their keys (ascending as ranks are), and new ones."""
    at = np.flatnonzero(p["after"] >= 0)
    a, b = p["first"][at], p["interval"][p["after"][at]]
    return at, a, b, _new(a, b)


def shared_prefixes(docs: DataFrame, size: int, blocks: int, bits: int) -> DataFrame:
    """(block, depth) of (block, id, text): for each place of a block's texts, in the order of (id, place), one byte: the
    number of phrases from which on its suffix is alone in the corpus, or 0 if it never is as far as windows reach."""
    probe = Places(pa.array([""]), size)
    limit = probe.inner - 2 * probe.radius - 1  # a phrase more would not be shared by any window's inner part

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(2)):
                part = batch.slice(first, last - first)
                found = Places(part.column(2), size)
                symbols, gaps = found.symbols(), found.gap.astype("<i4")
                cuts = np.searchsorted(found.text, np.arange(part.num_rows + 1))
                rows = [i for i in range(part.num_rows) if cuts[i + 1] > cuts[i]]
                own = [(cuts[i], cuts[i + 1]) for i in rows]
                columns = [*(part.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)), pa.array([symbols[i:j].tobytes() for i, j in own], pa.binary()), pa.array([gaps[i:j].tobytes() for i, j in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "symbols", "gaps"])

    def begin(table: pa.Table) -> pa.Table:
        shard = _Shard(table)
        at, number = shard.entries()
        return _rows(_SENT, _send(table["block"][0].as_py(), bits, np.bincount(number, minlength=len(at)) > 1, shard.symbol[shard.some][at]))

    def start(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_STATE, [])
        shard = _Shard(table)
        _, number = shard.entries()
        interval = np.zeros(len(shard.symbol), np.uint64)
        interval[shard.some] = _ids(sorted((k, _wide(x)) for k, x in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True)), bits)[number]
        return _rows(_STATE, [_state(table["block"][0].as_py(), 1, limit, np.zeros(len(interval), np.uint8), interval > 0, shard.place, shard.after, shard.gap, shard.gap, interval, interval)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, a, b, new = _round_entries(_parts(row))
                at = np.flatnonzero(new)
                yield from _rows(_SENT, _send(row["block"], bits, np.diff(at, append=len(a)) > 1, a[at], b[at])).to_batches()

    def refine(rounds: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    p = _parts(row)
                    at, _, _, new = _round_entries(p)
                    found = _ids([(x["bucket"], _wide(x["bits"])) for x in row["answers"] or []], bits)
                    interval = np.zeros(len(p["place"]), np.uint64)
                    interval[at] = found[np.cumsum(new) - 1]
                    reach = p["gap"] + np.where(p["after"] >= 0, p["reach"][p["after"]], 0) if len(at) else p["gap"]
                    yield from _rows(_STATE, [_state(row["block"], rounds, limit, _numbers(row["depth"], np.uint8).copy(), interval > 0, p["place"], p["after"], p["gap"], reach, p["first"], interval)]).to_batches()

        return run

    parsed = docs.mapInArrow(parse, "block int, id long, symbols binary, gaps binary").repartition("block")
    merged = parsed.groupBy("block").applyInArrow(begin, _SENT).groupBy("bucket").applyInArrow(_merge_intervals(bits), _SIDE)
    state, rounds = stored(parsed.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(start, _STATE), "intervals"), 1
    while (state.agg(F.sum("open").alias("n")).first()["n"] or 0) > 0:
        rounds += 1
        merged = state.select(*(c for c in state.columns if c != "depth")).mapInArrow(step, _SENT).groupBy("bucket").applyInArrow(_merge_intervals(bits), _SIDE)
        answers = merged.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))
        state = stored(state.join(answers, "block", "left").mapInArrow(refine(rounds), _STATE), "intervals")
    return state.select("block", "depth")


class _Block:
    """The texts of a block in the order of their ids, a slice at a time, with the extents and windows of each slice."""

    def __init__(self, table: pa.Table, side: pa.Table, size: int):
        self.size, self.order = size, np.argsort(table["id"].to_numpy(), kind="stable")
        self.name = table["block"][0].as_py()
        self.texts = table["text"].combine_chunks().take(pa.array(self.order))
        self.answers: dict[int, list[tuple[int, bytes]]] = {}
        for kind, bucket, bits in zip(side["kind"].to_pylist(), side["bucket"].to_pylist(), side["bits"].to_pylist(), strict=True):
            self.answers.setdefault(kind, []).append((bucket, bits))
        self.depth = np.frombuffer(self.answers.get(0, [(0, b"")])[0][1], np.uint8).astype(np.int64)

        self.slices: list[tuple[Places, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def __iter__(self) -> Iterator[tuple[Places, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Places of each slice; of those with windows that may repeat which, first and last start; windows without a place.
        Places are looked for once; the sums behind their hashes are kept for one slice at a time."""
        if self.slices:
            for part in self.slices:
                yield part
                part[0].bytes.sums.clear()
            return
        done = 0
        for i, j in slices(self.texts):
            found = Places(self.texts.slice(i, j - i), self.size)
            low, high = found.spans(self.depth[done : done + len(found.at)])
            done += len(found.at)
            at = np.flatnonzero(high >= low)
            part = found, at, low[at], high[at], found.without_place()
            yield part
            found.bytes.sums.clear()
            self.slices.append(part)
        if done != len(self.depth):
            raise ValueError("a block's texts are not those that were parsed")

    def extents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group and 96-bit hash of each extent of the block."""
        out = []
        for found, at, low, high, _ in self:
            place, r = found.at[at], found.radius
            group = found.bytes.hashes(place - r, place + found.gram + r)
            ends = high + self.size
            shape = mix(((place - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64))
            second = found.bytes.hashes(low, ends, 1) if len(at) else np.zeros(0, np.uint64)
            out.append((group, mix(found.bytes.hashes(low, ends) + shape), (second >> np.uint64(32)).astype(np.uint32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))

    def verdicts(self, extents: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """What the buckets say of each extent."""
        order, new = _distinct(*extents)
        bits = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in sorted(self.answers.get(2, [])))])
        out = np.zeros(len(order), np.uint8)
        out[order] = bits[np.cumsum(new) - 1]
        return out

    def windows(self, verdicts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """96-bit hashes of the windows that this block sends, and their starts for each slice."""
        hashes, seconds, starts, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [], 0
        for found, at, low, high, free in self:
            own = verdicts[done : done + len(at)] >= 2
            done += len(at)
            n = (high - low + 1)[own]
            each = np.repeat(low[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            each = np.concatenate([each, free])
            starts.append(each)
            if len(each):
                hashes.append(found.bytes.hashes(each, each + self.size))
                seconds.append((found.bytes.hashes(each, each + self.size, 1) >> np.uint64(32)).astype(np.uint32))
        return np.concatenate(hashes), np.concatenate(seconds), starts


def remove_shared(docs: DataFrame, size: int = 400, key: str = "doc_id", text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, spans, kept): each text as UTF-8 bytes, without those in shared strings.

    A byte is removed if a string of `size` bytes covers it that also starts anywhere else, in the same text (overlapping or
    not) or in another. Strings do not run over the ends of texts and are judged on the input. spans are the maximal removed
    runs, as (start, end) in bytes; kept are the other bytes, which need not be UTF-8 any more.

    Null and empty texts have no bytes; texts shorter than size stay whole. Keys are of any type and only passed on; rows
    that repeat a key or all of their columns are texts like any others. Other columns are ignored. A block holds about
    block_chars characters, or one longer text, of which a task needs some 60 bytes a byte.
    """
    if size < 24:
        raise ValueError("size must be 24 at least")
    kind = docs.schema[key].dataType
    blocks = block_count(text_size(docs, text), block_chars)
    bits = max(5, (blocks - 1).bit_length())
    identity = F.xxhash64(F.col(key), F.col(text))
    named = docs.select(F.pmod(identity, F.lit(blocks)).cast("int").alias("block"), identity.alias("id"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    depths = shared_prefixes(named.select("block", "id", "text"), size, blocks, bits).select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("depth").alias("bits"))
    texts = named.repartition("block")

    def send_extents(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_SENT, [])
        block = _Block(table, side, size)
        extents = block.extents()
        order, new = _distinct(*extents)
        at = np.flatnonzero(new)
        return _rows(_SENT, _send(block.name, bits, np.diff(at, append=len(order)) > 1, *(x[order[at]] for x in extents)))

    def send_windows(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_SENT, [])
        block = _Block(table, side, size)
        first, second, _ = block.windows(block.verdicts(block.extents()))
        order, new = _distinct(first, second)
        at = np.flatnonzero(new)
        return _rows(_SENT, _send(block.name, bits, np.diff(at, append=len(order)) > 1, first[order[at]], None, second[order[at]]))

    def clean(table: pa.Table, side: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "starts", "ends", "kept")}
        keys = table["key"]
        if table.num_rows:
            block = _Block(table, side, size)
            keys = table["key"].combine_chunks().take(pa.array(block.order))
            verdicts = block.verdicts(block.extents())
            first, second, starts = block.windows(verdicts)
            order, new = _distinct(first, second)
            at = np.flatnonzero(new)
            cuts = _cuts(first[order[at]], bits)
            told = dict(block.answers.get(3, []))
            marked = [np.unpackbits(np.frombuffer(told[k], np.uint8), count=j - i) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            repeated = np.zeros(len(first), bool)
            repeated[order] = np.concatenate([np.zeros(0, np.uint8), *marked]).astype(bool)[np.cumsum(new) - 1]
            seen, sent = 0, 0
            for (found, at, low, high, _), each in zip(block, starts, strict=True):
                data, edges = found.bytes.data, found.bytes.edges
                twice = verdicts[seen : seen + len(at)] & 1 == 1
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, low[twice], 1)
                np.add.at(change, high[twice] + size, -1)
                gone = (np.cumsum(change)[: len(data)] > 0) | covered(each[repeated[sent : sent + len(each)]], size, len(data))
                seen, sent = seen + len(at), sent + len(each)
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    mine = gone[i:j]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    columns["n_bytes"].append(j - i)
                    columns["n_removed"].append(int(mine.sum()))
                    columns["n_spans"].append(len(turns) // 2)
                    columns["starts"].append(turns[::2])
                    columns["ends"].append(turns[1::2])
                    columns["kept"].append(data[i:j][~mine].tobytes() if len(turns) else data[i:j].tobytes())
        kinds = {"starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()}
        return pa.table({"key": keys, **{c: pa.array(x, kinds.get(c, pa.int64())) for c, x in columns.items()}})

    asked = lambda fn, side: texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(fn, _SENT)
    side = depths.unionByName(asked(send_extents, depths).groupBy("bucket").applyInArrow(_decide_extents, _SIDE))
    side = side.unionByName(asked(send_windows, side).groupBy("bucket").applyInArrow(_decide_windows, _SIDE))
    out = texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(clean, f"key {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary")
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")))
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", spans.alias("spans"), "kept")

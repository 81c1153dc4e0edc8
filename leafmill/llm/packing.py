"""Best-fit packing: documents as token ids, cut into pieces and packed into sequences of one length.

Packing sees lengths only, and there are no more of these than a sequence has places. So the plan is made from the
counts by length, on the driver, for any number of pieces: Martello-Toth dominance fixes sets of lengths that are at
least as good as all alternatives, and best-fit decreasing places the rest. The plan says which ranks of each length go
where; pieces are ranked by length in slices of bounded size, so no task sees all pieces of a length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.store import stored

# Fixed value: how the vocabulary's tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Coarser cuts that fall on places where PATTERN always cuts: before a word, with the space ahead of it, and around white space.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to one of the two and not to the other.
_ODD = re.compile("[\x1c-\x1f\x85]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizer(dict):
    """Token ids of texts as little-endian 32-bit numbers. Keeps the ids of each word it has met, up to a bound.

    With special=False the strings of special tokens are plain text.
    """

    def __init__(self, vocabulary: bytes, most: int = 1 << 20, special: bool = True):
        super().__init__()
        model = json.loads(vocabulary)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special and self.special else None
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(chunk), dtype="<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))

    def ids(self, text: str) -> bytes:
        """Strings of special tokens in a text become their ids."""
        if self.split is None or "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split.split(text) if x)


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", room: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, and ids if asked for): the ids of each text and `end`, in pieces.

    Only documents of more than `room` ids are cut: into pieces of `room`, of which the first may be shorter. Null and
    empty texts give the one id `end`. vocabulary is the path of a byte-level BPE file; the driver reads it once.
    """
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = Tokenizer(held.value), np.array([end], "<u4").tobytes()
        for batch in batches:
            owner, rows = [], []
            for i, x in enumerate(batch.column(1)):
                data = tokenizer.ids(x.as_py() or "") + last
                n = len(data) // 4
                begin = 0
                for piece in range(-(-n // room)):
                    stop = min(n, room) if n <= room else (n - 1) % room + 1 + piece * room
                    part = data[4 * begin : 4 * stop]
                    owner.append(i)
                    rows.append((piece, begin, stop - begin, zlib.crc32(part), part))
                    begin = stop
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[k] for r in rows], pa.int64() if k else pa.int32()) for k in range(4))]
            if ids:
                columns.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    return docs.select(key, text).mapInArrow(run, T.StructType([*fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids]))


class Plan:
    """Places for pieces by length: rows (length, from rank, to rank, sequence of the first, offset), and sequences used."""

    def __init__(self, counts: dict[int, int], room: int):
        self.room, self.rows, self.sequences = room, [], 0
        self.left = {n: c for n, c in counts.items() if c}
        self.used: dict[int, int] = defaultdict(int)
        self._reduce()
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next n ranks of a length go to as many sequences, at the same offset."""
        self.rows.append((length, self.used[length], self.used[length] + n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self._take(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _smallest(self, without: int, n: int) -> list[int]:
        """The n smallest lengths that are left besides one piece of a length; a length counts as often as it is left."""
        out: list[int] = []
        for length in sorted(self.left):
            out += [length] * min(n - len(out), self.left[length] - (length == without))
            if len(out) == n:
                break
        return out

    def _dominating(self, length: int) -> list[int] | None:
        """Lengths to put beside one piece of this length so that no other choice can be better; None if that isn't known."""
        rest = self.room - length
        fits = [n for n in self.left if n <= rest and self.left[n] > (n == length)]
        if not fits:
            return []
        largest = max(fits)
        small = self._smallest(length, 3)
        if largest == rest or len(small) < 2 or sum(small[:2]) > rest:
            return [largest]  # it fills the sequence, or only one more piece can ever stand there
        if len(small) < 3 or sum(small) > rest:  # at most two more can
            pairs = [(a, b) for a in fits for b in fits if b <= a and a + b <= rest and (a != b or self.left[a] - (a == length) > 1)]
            a, b = max(pairs, key=lambda p: (sum(p), p))
            if largest >= a + b:
                return [largest]
            most = max(p[1] for p in pairs)
            both = [p for p in pairs if p[0] == largest and p[1] == most]
            if both:  # each piece of any other pair is no larger than one of these
                return list(both[0])
        return None

    def _reduce(self) -> None:
        """Fixes dominating sets, from the longest pieces on, until none is known."""
        again = True
        while again:
            again = False
            for length in sorted(self.left, reverse=True):
                while length in self.left and (beside := self._dominating(length)) is not None:
                    lengths = [length, *beside]
                    self._fix(lengths, min(self.left[n] // lengths.count(n) for n in set(lengths)))
                    again = True

    def _best_fit(self) -> None:
        """Longest pieces first, each into the fullest sequence that has room; sequences filled alike are one entry."""
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room that is left: (first, how many)
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                rest = min((r for r, runs in open_.items() if r >= length and runs), default=None)
                n = self.left[length]
                if rest is None:
                    n = -(-n // (self.room // length))
                    open_[self.room].append((self.sequences, n))
                    self.sequences += n
                    continue
                first, many = open_[rest].pop()
                n = min(n, many)
                if many > n:
                    open_[rest].append((first + n, many - n))
                self._take(length, n, first, self.room - rest)
                if rest > length:
                    open_[rest - length].append((first, n))


def pack(parts: DataFrame, room: int = 1024, slice_rows: int = 100_000) -> DataFrame:
    """parts, which have a column length from 1 to room, with sequence_id and offset of each.

    The pieces of a sequence stand gapless from offset 0. Null lengths and lengths out of range give nulls. parts are
    read three times, so they should be a written table. Columns of parts with the results' names are replaced.
    """
    parts = parts.drop("sequence_id", "offset")
    counts = parts.filter(F.col("length").between(1, room)).groupBy("length").count().collect()  # at most `room` rows
    slices = max(32, -(-sum(r["count"] for r in counts) // slice_rows))
    by_length = {int(r["length"]): r["count"] for r in counts}
    plan = Plan(by_length, room)
    order = [F.col(c) for c in parts.columns if c != "length" and not isinstance(parts.schema[c].dataType, T.MapType)]
    sliced = parts.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    ahead = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_slice", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)) - 1)
    ranked = ranked.join(ahead, ["length", "_slice"], "left").withColumn("_rank", F.col("_rank") + F.col("_ahead"))
    lengths, low, high, first, offset = (np.array([r[k] for r in plan.rows], dtype=np.int64) for k in range(5))
    by = np.lexsort((low, lengths))
    spark = parts.sparkSession
    held = spark.sparkContext.broadcast([x[by] for x in (lengths, low, high, first, offset)])
    at, rank_at = ranked.columns.index("length"), ranked.columns.index("_rank")
    names = [*parts.columns, "sequence_id", "offset"]
    keep = [ranked.columns.index(c) for c in parts.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, low, high, first, offset = held.value
        starts = lengths << 44 | low
        for batch in batches:
            length, rank = (batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, rank_at))
            ok = (length >= 1) & (length <= room)
            i = np.searchsorted(starts, np.where(ok, length << 44 | rank, 0), side="right") - 1
            out = [pa.array(v[i] if len(v) else np.zeros(len(i), np.int64), pa.int64(), mask=~ok) for v in (first, offset)]
            if len(first):
                out[0] = pa.array(first[i] + rank - low[i], pa.int64(), mask=~ok)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *out], names=names)

    fields = [*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields))


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", room: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """pieces() of docs, packed. The pieces are written once to the shared folder, so texts are tokenised once."""
    return pack(stored(pieces(docs, vocabulary, key, text, room, end, ids), "pieces"), room)

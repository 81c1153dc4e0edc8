"""Aligning two tokenizers: which tokens of the one lie over which of the other, and how often each pair does so.

Each task encodes blocks of documents with both tokenizers and lays the tokens of a block out over its bytes. Two as-of
joins, keyed by document, find for the start of each token the other side's token that covers it; the union of both
directions is all pairs that overlap, as of two tokens that overlap the later start lies in the other token. A block keeps
its distinct pairs of ids once, with their counts, and each document refers to them by number.

Counts over the corpus come from one row for each block and distinct pair, summed and joined back by pair of ids, so a pair
that every document has costs a row a block. The largest count of each id of the second tokenizer is one row for an entry of
its vocabulary at most, and is broadcast. Encoding happens once; its result is a stored table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.packing import Tokenizer
from leafmill.llm.store import stored
from leafmill.llm.words import slices

_COUNTS = "n_a", "n_b", "n_groups", "n_links"


class ByteTokens:
    """A byte-level BPE vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, vocabulary: bytes):
        self.coder = Tokenizer(vocabulary, most=1 << 18, special=False)
        entries = {i: bytes(b) for b, i in self.coder.encoding._mergeable_ranks.items()}
        entries |= {i: s.encode() for s, i in self.coder.special.items()}
        self.bytes = _table(entries)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.coder.ids(" " + x), "<u4").astype(np.int64) if x else np.zeros(0, np.int64) for x in texts]


class PieceTokens:
    """A sentencepiece vocabulary, which puts a space ahead of texts: ids of texts, and the bytes of each id."""

    def __init__(self, model: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = self.coder.id_to_piece
        self.bytes = _table({i: bytes([int(piece(i)[3:5], 16)]) if self.coder.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.coder.get_piece_size())})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.coder.encode(texts, num_threads=1)]


def _joined(entries: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of tokens, one after another."""
    found = entries.take(pa.array(ids))
    return found.buffers()[2].to_pybytes()[: np.frombuffer(found.buffers()[1], np.int64)[len(ids)]] if len(ids) else b""


def _table(entries: dict[int, bytes]) -> pa.Array:
    return pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())


class _Side:
    """All tokens of a block on one side: ids, documents, and byte offsets that run through the block."""

    def __init__(self, ids: list[np.ndarray], kept: list[int], sizes: np.ndarray):
        own = [ids[i] for i in kept]
        self.ids = np.concatenate([np.zeros(0, np.int64), *own])
        self.doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.ends = np.cumsum(sizes[self.ids])
        self.starts = self.ends - sizes[self.ids]

    def covering(self, other: _Side) -> np.ndarray:
        """For the start of each token the other side's token that covers it."""
        mine = pd.DataFrame({"at": self.starts, "doc": self.doc})
        theirs = pd.DataFrame({"at": other.starts, "doc": other.doc, "token": np.arange(len(other.ids))})
        return pd.merge_asof(mine, theirs, on="at", by="doc")["token"].to_numpy(np.int64)


def links(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens, by number, whose byte ranges overlap: the union of both directions, each pair once."""
    over_b, over_a = a.covering(b), b.covering(a)
    new = a.starts[over_a] != b.starts  # equal starts were found from the other side
    return np.concatenate([np.arange(len(a.ids)), over_a[new]]), np.concatenate([over_b, np.flatnonzero(new)])


def _spelled(a: _Side, b: _Side, common: np.ndarray, docs: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for each document: its groups in order, the ids of each side."""
    in_a, in_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    n = len(common)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(in_b, minlength=n))])
    before_a = np.cumsum(np.bincount(in_a, minlength=n))
    place_a, place_b = np.arange(len(a.ids)) + before_b[in_a], np.arange(len(b.ids)) + before_a[in_b]
    ids, marks = np.zeros(len(place_a) + len(place_b), np.int64), np.zeros(len(place_a) + len(place_b), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    marks[place_a], marks[place_b] = np.isin(a.ends, common), 2 * np.isin(b.ends, common)
    text = pa.compute.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(marks)), pa.scalar("", pa.large_string()))
    data = text.buffers()[2].to_pybytes() if len(text) else b""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
    tokens = np.concatenate([[0], np.cumsum(np.bincount(a.doc, minlength=docs) + np.bincount(b.doc, minlength=docs))])
    return [data[offsets[i] : offsets[j] - 1] for i, j in zip(tokens[:-1], tokens[1:], strict=True)]


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind[-1].encode() + x.astype(kind).tobytes()


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[:1].decode()}", offset=1).astype(np.int64)


def align(docs: DataFrame, bytes_vocabulary: str, pieces_model: str, key: str = "doc_id", text: str = "text", digest: bool = False, block_bytes: int = 1 << 21) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): each text under two tokenizers.

    A is the byte-level BPE of bytes_vocabulary on a space and the text, B the sentencepiece model of pieces_model on the
    text, to which it adds the space itself. The driver reads both files once. Tokens are cut into groups where both sides
    end; a link is a pair of an A and a B token whose bytes overlap. The count of a pair of ids is the number of its links
    in all documents; n_best are a document's links whose count is the largest of their B id (ties included), count_sum adds
    up the counts over its links. groups spells the ids, `a1,a2|b1;a3|b2,b3`; with digest it is the SHA-256 of that in hex.

    Texts that are null or empty, and those that one of the tokenizers changes (its tokens' bytes differ from a space and
    the text), have no tokens: zeros and ''. Rows that repeat a key each give a row; their links count each time. Other
    columns are ignored. A block holds about block_bytes of text, or one longer text.
    """
    held = []
    for path in (bytes_vocabulary, pieces_model):
        with open(path, "rb") as f:
            held.append(docs.sparkSession.sparkContext.broadcast(f.read()))
    kind = docs.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = ByteTokens(held[0].value), PieceTokens(held[1].value)
        sizes = [pa.compute.binary_length(c.bytes).to_numpy() for c in coders]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last in slices(batch.column(1), block_bytes):
                texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
                ids = [c.ids(texts) for c in coders]
                kept = [k for k, x in enumerate(texts) if x and all(_joined(c.bytes, i[k]) == b" " + x.encode() for c, i in zip(coders, ids, strict=True))]
                a, b = (_Side(i, kept, s) for i, s in zip(ids, sizes, strict=True))
                left, right = links(a, b)
                common = np.intersect1d(a.ends, b.ends, assume_unique=True)
                owner = np.searchsorted(a.ends, common)  # the A token that ends there
                numbers = np.zeros((4, len(texts)), np.int64)
                for row, x in zip(numbers, (a.doc, b.doc, a.doc[owner], a.doc[left]), strict=True):
                    row[kept] = np.bincount(x, minlength=len(kept))
                pair, number, times = np.unique(a.ids[left] << 32 | b.ids[right], return_inverse=True, return_counts=True)
                held_by, n = np.unique(a.doc[left] * max(1, len(pair)) + number, return_counts=True)
                width = np.zeros(len(texts), np.int64)
                width[kept] = np.bincount(held_by // max(1, len(pair)), minlength=len(kept))
                groups = [""] * len(texts)
                for k, x in zip(kept, _spelled(a, b, common, len(kept)), strict=True):
                    groups[k] = hashlib.sha256(x).hexdigest() if digest else x.decode()
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(first, last - first)),
                    **{c: pa.array([x.tolist()], pa.list_(pa.int64())) for c, x in zip(_COUNTS, numbers, strict=True)}, "groups": pa.array([groups], pa.list_(pa.string())),
                    "width": pa.array([_small(width)], pa.binary()), "at": pa.array([_small(held_by % max(1, len(pair)))], pa.binary()), "n": pa.array([_small(n)], pa.binary()),
                    "a": pa.array([(pair >> 32).tolist()], pa.list_(pa.int32())), "b": pa.array([(pair & 0xFFFFFFFF).tolist()], pa.list_(pa.int32())), "times": pa.array([times.tolist()], pa.list_(pa.int64())),
                })
                block += 1

    many = lambda t: T.ArrayType(t)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", many(kind)), *(T.StructField(c, many(T.LongType())) for c in _COUNTS), T.StructField("groups", many(T.StringType()))])
    schema = T.StructType([*schema, *(T.StructField(c, T.BinaryType()) for c in ("width", "at", "n")), *(T.StructField(c, many(T.IntegerType())) for c in "ab"), T.StructField("times", many(T.LongType()))])
    blocks = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, schema), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "times")).alias("place", "pair")).select("block", "place", "pair.a", "pair.b", "pair.times")
    counts = pairs.groupBy("a", "b").agg(F.sum("times").alias("count"))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most one row for each entry of B's vocabulary
    counts = counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.join(counts, ["a", "b"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("all")).select("block", F.col("all.count").alias("count"), F.col("all.best").alias("best"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c).slice(r, 1).flatten() for c in ("keys", *_COUNTS, "groups", "count", "best")}
                width, at, n = (_large(batch.column(c)[r].as_py()) for c in ("width", "at", "n"))
                count, is_best = (row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("count", "best"))
                edges = np.concatenate([[0], np.cumsum(width)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([row["keys"], *(row[c] for c in _COUNTS), pa.array(total(n * is_best[at])), pa.array(total(n * count[at])), row["groups"]], names=[key, *_COUNTS, "n_best", "count_sum", "groups"])

    fields = [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")), T.StructField("groups", T.StringType())]
    return blocks.drop("a", "b", "times").join(answers, "block", "left").mapInArrow(finish, T.StructType(fields))

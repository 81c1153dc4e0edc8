"""Words of Arrow text columns as numpy arrays: where they start and end, and 64-bit hashes of them.

A batch of texts is one byte buffer with offsets; everything here is a few array operations over that buffer, so no
Python object is made for a word. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes that separate words made of ASCII letters and digits and of everything outside ASCII.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
#: Bytes that separate words made of ASCII letters and of everything outside ASCII.
NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
#: Upper-case A-Z become lower case; all other bytes stay.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, i, 2**64) for i in range(n)], dtype=np.uint64)


@dataclass
class Words:
    """Words of a batch of texts, in order. starts and ends count bytes of data; first[i]:first[i + 1] are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        size = self.ends - self.starts
        eight = np.ndarray((max(0, len(self.data) - 7),), dtype="<u8", buffer=self.data, strides=(1,))
        h = eight[self.starts] & _MASKS[np.minimum(size, 8)]
        h = mix(h ^ (size.astype(np.uint64) * _M1 + np.uint64(mix(np.array([seed + 1], np.uint64))[0])))
        at = np.flatnonzero(size > 8)
        done = 8
        while len(at):
            k = eight[self.starts[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]
            h[at] = mix((h[at] + _M1) ^ (k * _M2))
            done += 8
            at = at[size[at] > done]
        return h

    def array(self) -> pa.Array:
        """The words as an Arrow array of strings."""
        size = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = self.data[np.repeat(self.starts - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def strings(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def find_words(texts: pa.Array, separators: bytes = SPACE, lower: bool = False) -> Words:
    """Maximal runs of bytes outside separators, within each text."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:  # a null may own bytes
        texts = texts.fill_null(b"")
        return find_words(texts, separators, lower)
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, dtype=np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    if lower:
        data = np.frombuffer(LOWER, dtype=np.uint8)[data]
    offsets = offsets - offsets[0]
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    inside = is_word[data[:size]]
    before = np.zeros(size + 1, dtype=bool)  # whether the byte before belongs to the same run
    before[1:] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(size + 1, dtype=bool)
    after[:size] = inside
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1 if size else starts
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is a range of its own."""
    offsets = np.concatenate([[0], np.cumsum(sizes(texts))])
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; none of a null."""
    return pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def windows(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n values from each place on: sum of h[i + j] * base**(n - 1 - j), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    part, size, out, done = h, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            out = part.copy() if out is None else out[: len(h) - done - size + 1] * np.uint64(pow(base, size, 2**64)) + part[done : len(h) - size + 1]
            done += size
        rest >>= 1
        if rest:
            part = part[: len(h) - 2 * size + 1] * np.uint64(pow(base, size, 2**64)) + part[size : len(h) - size + 1]
            size *= 2
    return out


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place on lie in one text, for all but the last n - 1 places."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total - n + 1) + n <= ends[: total - n + 1]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether each of total places lies in a window of n places from one of starts on."""
    if not len(starts):
        return np.zeros(total, bool)
    change = np.bincount(starts, minlength=total + n + 1) - np.bincount(starts + n, minlength=total + n + 1)
    return np.cumsum(change[:total]) > 0

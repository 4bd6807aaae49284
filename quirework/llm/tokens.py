"""Words and shingles of Arrow text columns, cut and hashed by whole numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes
never occur inside a multi-byte UTF-8 character, so cutting bytes cuts text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Instead, every ASCII byte that is not a letter.
_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [2**64 - 1], dtype=U64)
_MUL = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= _MUL[0]
    x ^= x >> U64(27)
    x *= _MUL[1]
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a column: their bytes, where they start and stop, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def cut(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """The words of every text; lower: with A-Z as a-z; letters: cut at every ASCII byte but letters."""
    data, at = raw(texts)
    n = len(data)
    own = np.zeros(n + 8, np.uint8)
    own[:n] = _LOWER[data] if lower else data
    solid = ~(_NO_LETTER if letters else _SPACE)[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = at[at < n]
    begins[edge] = solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = at[at > 0] - 1
    ends[edge] = solid[edge]
    start = np.flatnonzero(begins)
    return Words(own, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    data, start = words.data, words.start
    if not len(start):
        return np.zeros(0, U64)
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = words.stop - start
    h = mix((view[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(U64) * _STEP + U64(seed)))
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        part = view[start[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]
        h[more] = mix(h[more] + part * _STEP)
        k += 8
        more = more[size[more] > k]
    return h


def windows(h: np.ndarray, doc: np.ndarray, k: int, step: int = 0xD1B54A32D192ED03) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the number of each one's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(step)
        out += h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes; no row is split."""
    _, at = raw(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, low bytes first; planes of zeros only are left out."""
    a = np.ascontiguousarray(a, dtype="<u8")
    if not len(a):
        return b""
    used = max(1, (int(a.max()).bit_length() + 7) // 8)
    return a.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    used = len(b) // n
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(b, np.uint8).reshape(used, n).T
    return out.view("<u8").reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return pack(np.diff(np.asarray(a, dtype=U64), prepend=U64(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n), dtype=U64)


class Vocabulary:
    """The distinct words of a block and, for each word of the block, its number among them."""

    def __init__(self, words: Words):
        hashed = hash_words(words)
        self.hash, first, self.of = np.unique(hashed, return_index=True, return_inverse=True)
        self.start, self.stop = words.start[first], words.stop[first]
        self._data = words.data

    def text(self, some: np.ndarray, before: str = "", after: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Code points of some distinct words, each between the marks given, and the place in some of each code point."""
        size = self.stop[some] - self.start[some]
        ends = np.cumsum(size + 1)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        which = np.repeat(np.arange(len(some)), size + 1)
        inside = at - (ends - size - 1)[which]
        data = np.full(len(at), 10, np.uint8)
        own = inside < size[which]
        data[own] = self._data[self.start[some][which[own]] + inside[own]]
        text = data.tobytes().decode("utf-8", "replace")
        if before or after:
            text = before + text[:-1].replace("\n", after + "\n" + before) + after + "\n" if text else text
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        breaks = points == 10
        return points, np.cumsum(breaks) - breaks


def char_ngrams(points: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive code points of one word, and that word's place."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = points[:m].astype(U64) + U64(n << 32)
    for j in range(1, n):
        out *= U64(0xD1B54A32D192ED03)
        out += points[j : j + m]
    fits = (word[:m] == word[n - 1 :]) & (points[n - 1 :] != 10)
    return mix(out[fits]), word[:m][fits]


def doc_sums(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums over each text of a value for each of its words."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[words.first[1:]] - total[words.first[:-1]]

"""Vectorised text primitives over Arrow string columns.

The Python-side operators never loop over words.  A batch of texts is one byte
buffer plus document offsets; word borders, word hashes, prefixes and shingles
are NumPy expressions over that buffer.  Batches are cut into slices of about
``SLICE_BYTES`` so that a worker's memory does not follow the batch size (one
document is never cut, so the bound is the larger of a slice and one text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))

#: [\x20\x09-\x0D], the separators of every word contract of this package.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII letters to lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Everything that is neither an ASCII letter or digit nor part of a
#: multi-byte character separates the tokens of the classifiers.
NOT_WORD = np.ones(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_WORD[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that all bits of a hash can be used."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * _BASE + U64(seed))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = n + 1 + SLICE_BYTES
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


@dataclass
class Slice:
    """Consecutive texts of a batch as bytes; ``first`` is the batch row of the first."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into byte slices; null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a slice: byte borders, the text each belongs to, count per text."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def words(part: Slice, separators: np.ndarray = SPACE) -> Words:
    data, offsets = part.data, part.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(len(part), dtype=np.int64))
    gap = separators[data]
    left = np.empty(n, dtype=bool)
    left[0] = True
    left[1:] = gap[:-1]
    left[offsets[:-1][offsets[:-1] < n]] = True
    right = np.empty(n, dtype=bool)
    right[-1] = True
    right[:-1] = gap[1:]
    last = offsets[1:] - 1
    right[last[last >= 0]] = True
    solid = ~gap
    starts = np.flatnonzero(solid & left)
    ends = np.flatnonzero(solid & right) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, doc, np.bincount(doc, minlength=len(part)))


class Hasher:
    """Hashes of any byte ranges of a slice from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = _Powers.of(len(data))
        self._sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self._sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """ASCII letters lower-cased; with ``latin`` also those of U+00C0 to U+00DE."""
    out = LOWER[data]
    if latin and len(out) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


SHINGLE_WORDS = 5
_PLACE = stream(SHINGLE_WORDS, 11) | U64(1)


def shingle_sets(part: Slice, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text: (text index, hash), sorted by both.

    Words are lower-cased A-Z.  A text of fewer words than ``size`` has its
    whole word sequence as one shingle; a text without words has none.
    """
    found = words(part)
    if not len(found.starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    word = Hasher(LOWER[part.data]).ranges(found.starts, found.ends)
    place = stream(size, 11) | U64(1) if size != SHINGLE_WORDS else _PLACE
    n = len(word)
    docs, hashes = [], []
    if n >= size:
        total = np.zeros(n - size + 1, dtype=U64)
        for k in range(size):
            total += word[k : n - size + 1 + k] * place[k]
        whole = found.doc[: n - size + 1] == found.doc[size - 1 :]
        docs.append(found.doc[: n - size + 1][whole])
        hashes.append(mix(total[whole]))
    short = np.flatnonzero((found.count > 0) & (found.count < size))
    if len(short):
        first = np.searchsorted(found.doc, short)
        total = stream(size, 12)[found.count[short]]
        for k in range(size - 1):
            here = k < found.count[short]
            total = np.where(here, total + word[np.minimum(first + k, n - 1)] * place[k], total)
        docs.append(short)
        hashes.append(mix(total))
    doc, hashed = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return doc[fresh], hashed[fresh]

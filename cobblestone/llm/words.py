"""Words of whole texts as flat arrays, computed for many documents at once inside Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+``: a maximal run of bytes that are not ASCII white space. UTF-8 never uses those bytes
inside a longer character, so byte and code point views agree. Texts are cut into chunks of whole documents of about
``CHUNK`` bytes; a longer document is a chunk of its own. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
LONG_WORD = 512

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when a longer chunk comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)

            def row(b):
                out = np.full(size, b, _U)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = row(self.base), row(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C55), _Powers(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of the documents ``first .. first + docs`` of a batch.

    ``begin``/``end`` are byte positions in ``data``; document ``d`` owns words ``bounds[d] .. bounds[d + 1]`` and bytes
    ``offsets[d] .. offsets[d + 1]``.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    _codes: np.ndarray | None = None
    _prefix: np.ndarray | None = None

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def codes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        if self._codes is None:
            up, down = _BYTES.get(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTE_CODE[self.data] * up[:-1], out=total[1:])
            self._codes = mix((total[self.end] - total[self.begin]) * down[self.begin] + (self.end - self.begin).astype(_U))
            # polynomials modulo 2^64 can be made to agree from 1,024 bytes on
            for i in np.flatnonzero(self.end - self.begin >= LONG_WORD).tolist():
                self._codes[i] = xxhash.xxh64_intdigest(self.data[self.begin[i] : self.end[i]].tobytes(), 42)
        return self._codes

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word sequence ``lo .. hi`` (ends excluded)."""
        n = len(self.begin)
        up, down = _WORDS.get(n + 1)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, _U)
            np.cumsum(self.codes() * up[:-1], out=self._prefix[1:])
        return mix((self._prefix[hi] - self._prefix[lo]) * down[lo])

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that lie inside one document."""
        n = len(self.begin)
        if n < size:
            return np.zeros(0, np.int64)
        at = np.arange(n - size + 1)
        last = np.repeat(self.bounds[1:], self.counts)[: n - size + 1]
        return at[at + size <= last]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def split(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    """Words of the documents whose bytes are ``data`` and whose offsets start at 0."""
    solid = ~SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    begin, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return Words(first, data, offsets, begin, end, np.searchsorted(begin, offsets))


def words_of(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string column, chunk by chunk; ``lower`` maps A-Z to a-z first."""
    data, offsets = flat(column)
    for first, last in chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        yield split(LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first], first)


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Leftmost index of the smallest value in every run of ``size`` values."""
    best, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        span += step
    return best

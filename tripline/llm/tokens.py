"""Words of whole Arrow text batches, found and hashed without a Python loop over words.

A word is a maximal run of bytes other than blank and 0x09-0x0D. None of the six can be part
of a longer UTF-8 sequence, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and the apostrophe: what is left are words without punctuation.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes worked on at a time; one longer text is still taken whole.
CHUNK = 2 << 20
#: The same words as a Spark (Java) pattern.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=4)
def _weights(n: int) -> np.ndarray:
    """Odd pseudo-random multipliers, one per position in a word."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _power_of_two(n: int) -> int:
    return 1 << max(6, int(n - 1).bit_length())


@dataclass
class Words:
    """The words of some texts: byte bounds in ``data``, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    gaps: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _values(self) -> np.ndarray:
        """What each byte from the first word on adds to its word's hash."""
        data = self.data[self.starts[0] :]
        starts = self.starts - self.starts[0]
        spans = np.diff(np.append(starts, len(data)))
        at = np.arange(len(data), dtype=np.int64) - np.repeat(starts, spans)
        with np.errstate(over="ignore"):
            value = _weights(_power_of_two(int(spans.max()) + 1))[at]
            value *= data.astype(np.uint64) + np.uint64(1)
        value[self.gaps[data]] = 0
        return value

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from all its bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(self._values(), self.starts - self.starts[0])
            return mix(total + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def prefix_hashes(self, lengths: list[int]) -> list[np.ndarray]:
        """For each length in bytes the hash of the words' beginnings; 0 for words not longer."""
        if not len(self.starts):
            return [np.zeros(0, dtype=np.uint64) for _ in lengths]
        out = []
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum(self._values()))
            starts = self.starts - self.starts[0]
            for n in lengths:
                longer = self.ends - self.starts > n
                value = mix(sums[np.where(longer, starts + n, starts)] - sums[starts] + np.uint64(n))
                out.append(np.where(longer, value, np.uint64(0)))
        return out

    def valid(self, n: int) -> np.ndarray:
        """Start positions of all runs of ``n`` words inside one text."""
        total = len(self.starts)
        if total < n:
            return np.zeros(0, dtype=np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(total)
        return np.flatnonzero(left >= n)

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, across text borders, too."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, dtype=np.uint64)
        for k, w in enumerate(_weights(64)[:n] if n <= 64 else _weights(_power_of_two(n))[:n]):
            total += words[k : k + m] * w
        return mix(total)


def words_of(texts: pa.Array, lower: bool = False, gaps: np.ndarray = SEPARATOR) -> Words:
    """Words of an Arrow string array; null and empty texts have none. ``gaps``: which bytes
    stand between words."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = LOWER[data]
    gap = gaps[data]
    n = len(data)
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:]
    before[bounds[bounds < n]] = True
    after[bounds[bounds > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), gaps)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` text bytes each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end

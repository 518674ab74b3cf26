"""Words of Arrow batches as numpy arrays, for operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked on in pieces of about so many bytes (one document at least), which bounds a task's memory.
PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        return up, down


_largest = 1 << 12


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base of the rolling hashes and of its inverse, modulo 2^64; the longest asked for so far is kept."""
    global _largest
    _largest = max(_largest, 1 << int(n).bit_length())
    up, down = _powers(_largest)
    return up[: n + 1], down[: n + 1]


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64) of each slice values[start:end], from prefix sums."""
    with np.errstate(over="ignore"):
        up, down = powers(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of some texts: bytes, word slices, and the number of the first word of each text (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        h = rolling(_TABLE[self.data], self.starts, self.ends)
        with np.errstate(over="ignore"):
            return mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def doc(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The same words with one space between neighbours of a text: bytes, starts, ends."""
        data, kept = self.data.copy(), ~SPACE[self.data]
        at = self.ends[self.ends < len(data)]
        at = at[SPACE[data[at]]]
        data[at], kept[at] = 0x20, True
        place = np.cumsum(kept)
        starts = place[self.starts] - 1
        return data[kept].tobytes(), starts, starts + (self.ends - self.starts)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words (bytes outside ASCII white space) of an array of strings; nulls have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | cut[1:-1]
    end[:-1] &= space[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece has more than about size bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        piece = (np.cumsum(length) - length) // size
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)



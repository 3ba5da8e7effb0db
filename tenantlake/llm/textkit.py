"""Word positions and hashes of many texts at once, on numpy arrays of their bytes.

Arrow batches are cut into chunks of whole texts. A chunk is one byte array in which a line
feed ends every text, so no word and no line reaches over two texts. Hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
BLOCK = 1 << 18

_ROOT = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Bytes of words that white space separates, and of words of letters and digits only.
SPACED = ~_byte_class((0x09, 0x0D), (0x20, 0x20))
ALNUM = _byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[0x41:0x5B] += 0x20
LOWER_NO_DIGITS = LOWER.copy()
LOWER_NO_DIGITS[0x30:0x3A] = 0x30


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for ascending spans that do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        part = values[low:int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(_ROOT, len(part)), out=sums[1:], dtype=np.uint64)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _powers(_INVERSE, len(part) + 1)[s]
        i = j
    return mixed(out ^ mixed((ends - starts).astype(np.uint64)))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive hashes, as many as there are windows."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _ROOT + hashes[k:k + n]
    return mixed(out)


@dataclass
class Words:
    """Words of a chunk. Word j of text i is at first[i] + j; lines likewise."""

    data: np.ndarray
    text_starts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, width: int) -> np.ndarray:
        """First word of every window that lies within one text."""
        n = max(0, len(self.starts) - width + 1)
        last = np.repeat(self.first[1:], self.counts)[:n]
        return np.flatnonzero(np.arange(n) + width <= last)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, and the first line of each text."""
        ends = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, np.searchsorted(starts, self.text_starts)


def words_of(texts: list[bytes], word_bytes: np.ndarray = SPACED,
             fold: np.ndarray = KEEP_CASE) -> Words:
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    if fold is not KEEP_CASE:
        data = fold[data]
    edges = np.diff(word_bytes[data].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text_starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_starts[1:])
    return Words(data, text_starts, starts, ends, np.searchsorted(starts, text_starts))


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, empty where null."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def chunks(batch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Slices of whole rows with about `most` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    total, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + most, side="right")))
        part = batch.slice(low, high - low)
        yield part, as_bytes(part.column(name))
        low = high

"""Words and word shingles of Arrow string batches as 64-bit hashes, by whole-buffer numpy operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WIDTH)]
_SHORT = np.uint64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Where only letters and digits count as words, all other ASCII parts them.
_NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Shingled:
    """Consecutive rows of a batch: rows first..first+n, the words and shingles of row r at [starts[r], starts[r+1])."""

    first: int
    n: int
    words: np.ndarray
    word_starts: np.ndarray
    shingles: np.ndarray
    shingle_starts: np.ndarray


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about CHUNK_BYTES; a longer text comes alone."""
    data, offsets = byte_buffer(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, parted at white space; nulls have none."""
    out = np.zeros(len(texts), np.int64)
    for first, end, data, offsets in pieces(texts):
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        limits = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[limits] = inside[limits]
        out[first:end] = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    return out


def shingled(texts: pa.Array, width: int = WIDTH, alnum: bool = False) -> Iterator[Shingled]:
    """Hashes of the words (A-Z lower-cased, parted at white space) and of width words in a row.

    A text with some but fewer words has one shingle, its whole sequence; a text without words none.
    alnum: words are runs of letters, digits and non-ASCII characters instead.
    """
    for first, end, data, offsets in pieces(texts):
        apart = (_NOT_ALNUM if alnum else _SPACE)[data]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~apart
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        limits = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begins[limits] |= inside[1:-1][limits]
        ends[limits - 1] |= inside[1:-1][limits - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _powers.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        word_starts = np.searchsorted(start, offsets)
        counts = np.diff(word_starts)
        m = max(0, len(words) - width + 1)
        mixed = np.zeros(m, np.uint64)
        for k in range(width):
            mixed += words[k : k + m] * _MIX[k % WIDTH]
        mixed = mix(mixed)
        whole = counts >= width
        keep = np.zeros(m + 1, np.int64)
        np.add.at(keep, word_starts[:-1][whole], 1)
        np.add.at(keep, word_starts[1:][whole] - width + 1, -1)
        chosen = np.flatnonzero(np.cumsum(keep)[:m])
        short = np.flatnonzero((counts > 0) & ~whole)
        sizes = np.where(whole, counts - width + 1, (counts > 0).astype(np.int64))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        if len(short):
            out = np.empty(starts[-1], np.uint64)
            full = np.ones(starts[-1], bool)
            full[starts[short]] = False
            out[full] = mixed[chosen]
            for r in short:
                w = words[word_starts[r] : word_starts[r + 1]]
                weights = np.multiply.accumulate(np.full(len(w), _MIX[0]))
                out[starts[r]] = mix((np.sum(w * weights, keepdims=True) + np.uint64(len(w))) * _SHORT)[0]
        else:
            out = mixed[chosen]
        yield Shingled(first, end - first, words, word_starts, out, starts)


def distinct(part: Shingled) -> tuple[np.ndarray, np.ndarray]:
    """The set of each row, ascending within the row, and where each begins."""
    rows = np.repeat(np.arange(part.n), np.diff(part.shingle_starts))
    order = np.lexsort((part.shingles, rows))
    values, rows = part.shingles[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(part.n + 1))


def set_digests(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes a row that depend on its set alone."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x7F4A7C159E3779B9)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt))])
        out.append(sums[starts[1:]] - sums[starts[:-1]])
    return [row.tobytes() for row in np.stack(out, 1).astype(">u8")]

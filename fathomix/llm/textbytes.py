"""Vectorised word and shingle hashing over the bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        x = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(ODD) + np.uint64(seed))
    return x | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take max_bytes together, or one row where a row takes more."""
    col = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    offsets = text_bytes(col)[1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null takes no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(word: bytes | None = None, not_word: bytes | None = None) -> np.ndarray:
    """A 256-entry table of the bytes that belong to words."""
    t = np.zeros(256, bool) if word is not None else np.ones(256, bool)
    for b in word or b"":
        t[b] = True
    for b in not_word or b"":
        t[b] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words without white space.
NON_SPACE = byte_table(not_word=SPACES)
#: Words of digits, lower-case letters and whatever is not ASCII; to be used on lower-cased bytes.
ALNUM = byte_table(word=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(ODD, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (ODD, inverse))
        return self.up, self.down


class Words:
    """The words of a text column: byte spans, 64-bit hashes, and the first word of each row."""

    def __init__(self, col: pa.Array, table: np.ndarray, powers: Powers):
        data, self.offsets = text_bytes(col)
        self.data = LOWER[data]
        n = len(data)
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        if n:
            cuts = self.offsets[:-1][self.offsets[:-1] < n]
            first[1:] &= ~inside[:-1]
            first[cuts] = inside[cuts]
            last[:-1] &= ~inside[1:]
            ends = cuts[cuts > 0] - 1
            last[ends] = inside[ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        up, down = powers.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.rows = np.searchsorted(self.starts, self.offsets)

    def count(self) -> np.ndarray:
        return np.diff(self.rows)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True)]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; row limits are the caller's to keep."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k * 0x51ED27), np.uint64)
    for i, a in enumerate(odd_numbers(k, 77)):
        out += hashes[i : i + n] * a
    return mix64(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingle hashes of all rows, repeats included, and the first shingle of each row.

    A row with fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    n = words.count()
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    limits = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(int(limits[-1]), np.uint64)
    all_windows = windows(words.hashes, k)
    if len(all_windows):
        row_of = np.repeat(np.arange(len(n)), per_row)
        at = np.arange(len(out)) - limits[row_of] + words.rows[:-1][row_of]
        whole = (n >= k)[row_of]
        out[whole] = all_windows[at[whole]]
    for r in np.flatnonzero((n > 0) & (n < k)):
        i, m = int(words.rows[r]), int(n[r])
        out[limits[r]] = windows(words.hashes[i : i + m], m)[0]
    return out, limits

"""Words and word windows of many texts at once, as NumPy arrays over an Arrow column.

A batch of texts is one byte buffer.  Words are byte ranges of it, so a word costs
a few vector operations and no Python object.  Words and windows are compared by
64-bit hashes; operators whose result must not rest on a hash compare the bytes too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20  # texts handled at once inside a task
HASH_BYTES = 1 << 20  # bytes hashed at once; an array of this many numbers takes 8 MB

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALPHANUMERIC = np.zeros(256, bool)  # ASCII other than 0-9, A-Z and a-z
NOT_ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WINDOW_MULTIPLIER = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (splitmix64's last steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers_for(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = max(HASH_BYTES, 1 << max(0, size - 1).bit_length())
    if rounded > 16 * HASH_BYTES:  # a very long word: not kept
        return _powers.__wrapped__(rounded, base)
    return _powers(rounded, base)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths.astype(np.int64)) // limit
            cuts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                yield batch.slice(int(start), int(end - start))


class Words:
    """The words of a column of texts.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text i are
    numbers ``first[i]`` to ``first[i + 1] - 1``.  ``separators`` says which bytes
    are none of a word, ``folded`` what each byte counts as.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, folded: np.ndarray = AS_IS) -> None:
        column = text_array(column)
        _, offsets, data = column.buffers()
        n = len(column)
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.raw = raw
        self.data = raw if folded is AS_IS else folded[raw]
        inside = ~separators[raw]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        filled = self.at[:-1] < self.at[1:]
        head, tail = self.at[:-1][filled], self.at[1:][filled] - 1
        begins[head] |= inside[head]
        finishes[tail] |= inside[tail]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        out = np.empty(len(self.starts), np.uint64)
        values, i, n = _byte_values(), 0, len(self.starts)
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + HASH_BYTES, "right")))
            base = self.starts[i]
            some = self.data[base : ends[j - 1]]
            up, down = _powers_for(len(some) + 1, _MULTIPLIER)
            total = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(values[some] * up[: len(some)], out=total[1:])
            s, e = self.starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, and where each starts and ends in that."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        if not len(lengths):
            return b"", starts, ends
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        out = np.full(int(ends[-1]), 0x20, np.uint8)
        place = np.ones(len(out), bool)
        place[ends[:-1]] = False
        out[place] = self.data[keep]
        return out.tobytes(), starts, ends


def windows_in(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``k`` words inside one text, and their texts."""
    each = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    texts = np.repeat(np.arange(len(counts)), each)
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return first[texts] + inside, texts


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words, text ends ignored."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, down = _powers_for(HASH_BYTES, _WINDOW_MULTIPLIER)
    step = HASH_BYTES - k
    for i in range(0, n, step):
        some = hashes[i : min(i + step, n) + k - 1]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=total[1:])
        m = len(some) - k + 1
        out[i : i + m] = mix((total[k:] - total[:m]) * down[:m])
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` words that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the slices ``first[i]:first[i + 1]``; an empty slice gives 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.float64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

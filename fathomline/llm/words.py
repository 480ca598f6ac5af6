"""Rolling 64-bit word hashes over Arrow string columns, in NumPy.

A polynomial hash modulo 2**64 with an odd base has an inverse base, so the hash of any byte or
word range comes from two prefix sums. Blocks are bounded: texts are taken together up to
``BLOCK`` bytes, and a longer text is cut at white space, carrying its last word hashes over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(_ODD)
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that near-by values give unrelated ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 2 * BLOCK:
            _POWERS[base] = have
    return have[:n]


class Prefix:
    """Prefix sums of a hashed sequence; ``of(a, b)`` hashes the ranges [a, b)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * _powers(_ODD, self.n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, self.n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all ranges of length k."""
        m = max(0, self.n - k + 1)
        return mix((self.sums[k : k + m] - self.sums[:m]) * self.inverse[:m]) if m else np.zeros(0, np.uint64)


def bounds(flat: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte block; words also break at ``doc_starts``."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[flat]
    cut = np.zeros(n + 1, bool)
    cut[doc_starts] = True
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends


def _hash_bytes(flat: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the words' hashes."""
    starts, ends = bounds(flat, doc_starts)
    return starts, ends, Prefix(_BYTES[flat]).of(starts, ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null has no bytes."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, carry: int = 0, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (row, word number in its text, hash) of all words, in order, block by block.

    A text longer than a block comes in pieces that repeat the last ``carry`` words of the piece before.
    """
    offsets, data = buffers(column)
    i, n = 0, len(column)
    while i < n:
        if offsets[i + 1] - offsets[i] > block:
            yield from _long(i, data[offsets[i] : offsets[i + 1]], carry, block)
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1
        j = min(max(j, i + 1), n)
        flat = data[offsets[i] : offsets[j]]
        local = offsets[i : j + 1] - offsets[i]
        starts, _, hashes = _hash_bytes(flat, local[:-1])
        rows = np.searchsorted(local, starts, side="right") - 1
        first = np.searchsorted(rows, np.arange(j - i))
        yield rows + i, np.arange(len(rows)) - first[rows], hashes
        i = j


def _long(row: int, flat: np.ndarray, carry: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, count, kept = 0, 0, np.zeros(0, np.uint64)
    while at < len(flat):
        end = min(at + block, len(flat))
        if end < len(flat):
            spaces = np.flatnonzero(_IS_SPACE[flat[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word fills the block: go on to its end
                while end < len(flat):
                    more = np.flatnonzero(_IS_SPACE[flat[end : end + block]])
                    end = end + int(more[0]) if len(more) else min(end + block, len(flat))
                    if len(more):
                        break
        _, _, fresh = _hash_bytes(flat[at:end], np.zeros(0, np.int64))
        hashes = np.concatenate((kept, fresh))
        base = count - len(kept)
        yield np.full(len(hashes), row), base + np.arange(len(hashes)), hashes
        count += len(fresh)
        kept = hashes[len(hashes) - carry :] if 0 < carry < len(hashes) else hashes if carry else np.zeros(0, np.uint64)
        at = end


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (the first of equals) in every window of ``width`` values."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best

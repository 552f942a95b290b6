"""Array kernels shared by the corpus operators.

Texts arrive as Arrow string columns.  A kernel looks at the UTF-8 bytes of a
bounded chunk at once, so the cost of a word is a few array passes and no Python
object is made for it.  A word is a run of bytes outside ``\\x20\\x09-\\x0D``; a
word's identity is a 64-bit polynomial hash of its bytes (wrapping arithmetic,
odd base, mixed afterwards).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Stage, *caches) -> Stage:
    """The same stage; at the end of each task its caches are cleared and free memory goes back to the system.

    Spark keeps Python workers for later tasks; what they hold would count against
    the executor all the while.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return stage


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    n = len(texts)
    if n == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  #: bytes of the chunk
    bounds: np.ndarray  #: where each text begins in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: index of each text's first word (one more entry than texts)
    hashes: np.ndarray
    trimmed: np.ndarray | None = None  #: words whose last byte was cut off (see words)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: pa.Array, lower: bool = False, trim: bool = False) -> Words:
    """The words of each text.  ``trim`` cuts a last full stop or comma off words in which a letter or digit stands before it."""
    data, bounds = raw(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~_SPACE[data]
    begin = solid.copy()
    stop = solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] = solid[cuts]
        stop[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    trimmed = None
    if trim:
        last, before, third = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
        latin = (third == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80)
        trimmed = ((last == 44) | (last == 46)) & (ends - starts > 1) & (_ALNUM[before] | (latin & (ends - starts > 2)))
        ends = ends - trimmed
    up, down = _power_tables(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts]) if n else np.empty(0, np.uint64)
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), hashes, trimmed)


def grams(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each text, and where each text's begin.

    With ``short`` a text of 1 to k-1 words has its whole sequence as one window.
    """
    n = w.counts
    total = len(w.hashes)
    many = np.maximum(n - k + 1, 0)
    value = np.zeros(max(total - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + w.hashes[j : j + len(value)])
    valid = np.zeros(len(value), dtype=bool)
    owner = w.owner()
    if len(value):
        valid = owner[: len(value)] == owner[k - 1 :]
    if not short:
        return value[valid], np.concatenate([[0], np.cumsum(many)])
    few = np.flatnonzero((n > 0) & (n < k))
    each = many.copy()
    each[few] = 1
    first = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(first[-1]), dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[first[few]] = False
    out[place] = value[valid]
    for d in few:
        seed = np.array([n[d]], dtype=np.uint64)
        for h in w.hashes[w.first[d] : w.first[d + 1]]:
            seed = mix(seed * np.uint64(0xD6E8FEB86659FD93) + h)
        out[first[d]] = seed[0]
    return out, first


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) quantity over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Add up (key, count) lists."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


class Table:
    """Open addressing from 64-bit keys to numbers, at most half full; all work is by arrays."""

    def __init__(self, room: int = 1 << 12):
        self._make(max(12, (2 * room - 1).bit_length()))

    def _make(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        keys = np.maximum(keys, np.uint64(1))  # 0 is a free place
        at = (keys & self.mask).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left, step = np.flatnonzero((there != keys) & (there != 0)), 0
        while len(left):
            step += 1
            at = ((keys[left] + np.uint64(step)) & self.mask).astype(np.int64)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are distinct and not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self._make((2 * (len(old[0]) + len(keys)) - 1).bit_length() + 1)
            self.put(*old)
        keys = np.maximum(keys, np.uint64(1))
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = ((keys[left] + np.uint64(step)) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]] = keys[left[won]]
            self.values[at[won]] = values[left[won]]
            left, step = np.delete(left, won), step + 1
        self.n += len(keys)

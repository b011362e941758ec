"""numpy views of Arrow string columns, words and rolling hashes over them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the rolling hashes (mod 2**64).
CHAR_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system; Python workers that wait for their next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over a partition, with memory given back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each; one long text is a slice of its own."""
    n = batch.num_rows
    # lengths alone, so that the texts of a whole batch are not copied
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


class Powers:
    """Powers of a base and of its inverse mod 2**64, made once and grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up, self._down = (np.ones(1, np.uint64) for _ in range(2))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 1 << 16)
            self._up, self._down = self._grow(self.base, size), self._grow(self.inverse, size)
        return self._up[:n], self._down[:n]

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base & MASK
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * np.uint64(step)
            step = step * step & MASK if take == done else step
            done += take
        return out


CHARS, WORDS = Powers(CHAR_BASE), Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(prefix: np.ndarray, powers: Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans from the prefix sums of ``value * base**position``."""
    _, down = powers.get(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=out[1:])
    return out


class Text:
    """Words of a block of texts; a word is a run of ``[^\\x20\\x09-\\x0D]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data | 0x20, data)
        self.data, self.off, self.n = data, off, len(off) - 1
        inside = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[off] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[off] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.prefix = prefix_sums(data.astype(np.uint64) + np.uint64(1), CHARS)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.prefix, CHARS, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``width`` words that stays inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return first, span_hashes(prefix_sums(hashes, WORDS), WORDS, first, first + width)


def repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: found twice or more in its text; not the first of its kind there."""
    key = mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order], later[order] = same[:-1] | same[1:], same[:-1]
    return twice, later

"""Vectorised words and rolling hashes over Arrow text; runs inside Spark tasks.

A word is a maximal run of bytes other than the six ASCII blanks. Hashes are polynomials modulo 2^64 over
random byte values, then finalised; they depend on nothing but the word's bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
BLANKS = b" \t\n\x0b\x0c\r"
IS_BLANK = np.isin(np.arange(256), list(BLANKS))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(256, dtype=np.uint64), 77)


@functools.lru_cache(4)
def powers(log_n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below 2^log_n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(1 << log_n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal content at any place."""
    up, down = powers(max(12, int(len(values) + 1).bit_length()), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """Words of a text column: data, starts, ends (byte places), doc (row of each word), first (word range of each row)."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None, blank: np.ndarray = IS_BLANK):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.raw = raw
        data = raw if table is None else table[raw]
        solid = ~blank[data]
        size = len(data)
        edge = np.zeros(size + 1, bool)  # a document begins here
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = solid[:-1]
        after = np.zeros(size, bool)
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.data = data
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def hashes(self) -> np.ndarray:
        raw = span_hash(BYTE_VALUE[self.data], self.starts, self.ends)
        return mix(raw ^ (self.ends - self.starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, width: int) -> np.ndarray:
        """Starts, as word numbers, of all runs of width words inside one document."""
        n = len(self.doc)
        if n < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])

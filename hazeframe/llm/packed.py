"""Packed key exchange: which keys of one part also occur elsewhere.

Tasks send, per hash bucket, packed arrays of (key, part); the bucket's task sorts them and answers each part
with the packed keys that matter to it. A key counts at most twice per sender and part, so a key that a third
of all documents hold costs one entry per part and batch, not one per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "bucket int, keys binary, parts binary"
ANSWER = "part int, bucket int, keys binary"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Sender:
    """Gathers (hash, part) and yields rows of SENT in bounded batches."""

    def __init__(self, buckets: int, width: str, most: int = 2, limit: int = 1_500_000):
        self.buckets, self.width, self.most, self.limit = buckets, width, most, limit
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, h: np.ndarray, part: np.ndarray):
        self.held.append((h, part.astype(np.uint32)))
        self.n += len(h)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        h, part = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.argsort(h, kind="stable")
        h, part = h[order], part[order]
        m = self.most
        if len(h) > m:
            extra = (h[m:] == h[:-m]) & (part[m:] == part[:-m]) & (part[1:][m - 1 :] == part[m - 1 : -1])
            keep = np.concatenate([np.ones(m, bool), ~extra])
            h, part = h[keep], part[keep]
        at = np.searchsorted(bucket_of(h, self.buckets), np.arange(self.buckets + 1))
        keys = h.astype(self.width)
        rows = [(b, keys[s:e].tobytes(), part[s:e].tobytes()) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
        b, k, p = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(p, pa.binary())], names=["bucket", "keys", "parts"])


def answers(sent: DataFrame, buckets: int, width: str, earlier: bool) -> DataFrame:
    """Rows of ANSWER. earlier: keys that a smaller part also has; else keys that occur twice anywhere."""
    size = np.dtype(width).itemsize

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for b, k, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(b, []).append((k, p))
        for b in sorted(by):
            k, p = zip(*by.pop(b), strict=True)
            keys, parts = np.frombuffer(b"".join(k), width), np.frombuffer(b"".join(p), np.uint32)
            order = np.lexsort((parts, keys))
            keys, parts = keys[order], parts[order]
            same = keys[1:] == keys[:-1]
            if earlier:
                new = np.concatenate([[True], ~same])
                lowest = parts[np.flatnonzero(new)][np.cumsum(new) - 1]
                hit = parts > lowest
            else:
                hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            keys, parts = keys[hit], parts[hit]
            one = np.ones(len(keys), bool)
            one[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
            keys, parts = keys[one], parts[one]
            order = np.argsort(parts, kind="stable")
            keys, parts = keys[order], parts[order]
            cut = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, int)
            if len(cut):
                to = [int(parts[i]) for i in cut]
                packed = [keys[s:e].tobytes() for s, e in zip(cut, [*cut[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([b] * len(to), pa.int32()), pa.array(packed, pa.binary())], names=["part", "bucket", "keys"])

    assert size in (4, 8)
    return sent.repartitionById(buckets, "bucket").mapInArrow(run, ANSWER)


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys

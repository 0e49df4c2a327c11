"""Runs of repeated word sequences by a harmonic grid of extension queries.

A run of period p covers at least one pair of grid places jp, (j+1)p. For every period the longest common extensions of
such pairs, forward and backward, give the whole run. They are answered in constant time from a suffix array of word
numbers, another of the reversed words, and a sparse table of range minima over each one's common prefixes.

One row is worked on at a time with a bounded batch of others: n words need about n ln n grid pairs, taken PAIRS at a
time. A run of at least `shortest` words agrees with itself on six words around the grid pair at least, so the three
words after it or before it do; pairs whose words differ there have no run, and only texts with other pairs get suffix
arrays. Those take about 100 bytes a word.

Edges: a null or empty text has no words and no runs; a null doc_id is never altered (see `altered`). Texts are whole
whatever their length. Repeated rows get equal results, an empty table no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks
from .words import IS_BLANK, Words

PAIRS = 1 << 20


def numbered(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words."""
    if not len(words.starts):
        return np.zeros(0, np.int32)
    body = np.ascontiguousarray(words.data[~IS_BLANK[words.data]])
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return column.dictionary_encode().indices.to_numpy()


class Extensions:
    """Longest common extensions between places of one document each, over several documents in a row."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        n = len(ids)
        key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
        end = np.searchsorted(doc, doc, side="right")
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        at = np.arange(n)

        def head(new):
            return np.maximum.accumulate(np.where(new, at[: len(new)], 0))

        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = head(new)
        levels, h = [], 1
        while True:
            levels.append(np.append(rank, -1).astype(np.int32))
            alone = new & np.append(new[1:], True)
            open_ = np.flatnonzero(~alone)  # places in the suffix array that are not settled
            if not len(open_):
                break
            own = order[open_]
            after = np.where(own + h < end[own], rank[np.minimum(own + h, n - 1)] + 1, 0)
            both = rank[own] * (n + 1) + after
            by = np.argsort(both, kind="stable")
            both, own = both[by], own[by]
            order[open_] = own
            fresh = np.concatenate([[True], both[1:] != both[:-1]])
            new[open_] = fresh
            rank[own] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
            h *= 2
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            step = same * (1 << k)
            common[1:] += step
            a += step
            b += step
        del levels
        self.table = [common]
        k = 1
        while 2 * k <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, inside their document; i and j differ."""
        r, s = self.rank[i], self.rank[j]
        lo, hi = np.minimum(r, s) + 1, np.maximum(r, s)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << int(k)) + 1])
        return out


def grid_pairs(ids: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places i, as word numbers of the batch, and periods p whose words at i and i + p agree well enough."""
    counts = np.diff(first)
    halves = np.where(counts >= max(2, shortest), counts // 2, 0)
    start = np.repeat(first[:-1], halves)
    stop = np.repeat(first[1:], halves)
    period = np.arange(len(start)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    many = (stop - start - 1) // np.maximum(period, 1)
    upto = np.cumsum(many)
    found_i, found_p = [], []
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        m = many[lo:hi]
        p = np.repeat(period[lo:hi], m)
        j = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        i = np.repeat(start[lo:hi], m) + j * p
        hit = np.flatnonzero(ids[i] == ids[i + p])
        i, p, a, b = i[hit], p[hit], np.repeat(start[lo:hi], m)[hit], np.repeat(stop[lo:hi], m)[hit]

        def equal(d, i=i, p=p, a=a, b=b):
            inside = (i + d >= a) & (i + d + p < b)
            x = np.where(inside, i + d, a)
            return inside & (ids[x] == ids[np.where(inside, x + p, a)])

        loose = np.maximum(shortest, 2 * p) - p < 6
        keep = loose | equal(1) & equal(2) | equal(-1) & equal(-2) & equal(-3)
        found_i.append(i[keep])
        found_p.append(p[keep])
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_p])


def runs(ids: np.ndarray, first: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end, period of all runs with their smallest period, by doc, start and period. Places are word
    numbers inside the document, end exclusive."""
    i, p = grid_pairs(ids, first, shortest)
    none = np.zeros(0, np.int64)
    if not len(i):
        return none, none, none, none
    doc = np.searchsorted(first, i, side="right") - 1
    docs = np.unique(doc)
    size = np.diff(first)[docs]
    begin = np.cumsum(size) - size  # of each document among those that are looked at
    local = np.repeat(np.arange(len(docs)), size)
    words = ids[np.repeat(first[docs] - begin, size) + np.arange(int(size.sum()))]
    at = i - first[doc] + begin[np.searchsorted(docs, doc)]
    forward = Extensions(words, local).common(at, at + p)
    n = len(words)
    back = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(i > first[doc])
    if len(inner):
        reverse = Extensions(words[::-1], local[-1] - local[::-1])
        back[inner] = reverse.common(n - at[inner], n - at[inner] - p[inner])
    good = forward + back + p >= np.maximum(shortest, 2 * p)
    doc, p = doc[good], p[good]
    start, end = (i - first[np.searchsorted(first, i, side="right") - 1] - back)[good], (i - first[np.searchsorted(first, i, side="right") - 1])[good] + p + forward[good]
    order = np.lexsort((p, end, start, doc))
    doc, start, end, p = doc[order], start[order], end[order], p[order]
    new = np.ones(len(doc), bool)  # of equal stretches the smallest period
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    doc, start, end, p = doc[new], start[new], end[new], p[new]
    order = np.lexsort((p, start, doc))
    return doc[order], start[order], end[order], p[order]


def altered(key: int | None, n: int) -> tuple[int, int] | None:
    """Place a and period p from which a tenth of all documents, by the id's CRC, is made periodic; None for the rest."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(documents: DataFrame, shortest: int = 12, plant: bool = False, id_col: str = "doc_id", text_col: str = "text", output: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256; with
    output also runs (all, as structs) and collapsed, the text without repeats. plant alters a tenth of the documents first,
    see altered()."""
    kind = dict(documents.dtypes)[id_col]
    fields = f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    fields += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if output else ""

    def run(batches):
        for c in chunks(batches, 1):
            w = Words(c.column(1))
            ids, first = numbered(w), w.first
            keys, texts = c.column(0).to_pylist(), c.column(1).to_pylist()
            maps: dict[int, np.ndarray] = {}
            if plant:
                for d, (key, n) in enumerate(zip(keys, w.counts.tolist(), strict=True)):
                    if where := altered(key, n):
                        a, p = where
                        maps[d] = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
                if maps:
                    ids = ids.copy()
                    for d, to in maps.items():
                        ids[first[d] : first[d + 1]] = ids[first[d] : first[d + 1]][to]
            doc, start, end, period = runs(ids, first, shortest)
            cut = np.searchsorted(doc, np.arange(len(keys) + 1))
            rows = []
            for d, text in enumerate(texts):
                words = (text or "").encode().split()
                if d in maps:
                    words = [words[i] for i in maps[d]]
                s, e, p = (x[cut[d] : cut[d + 1]].tolist() for x in (start, end, period))
                best: tuple = (None,) * 4
                if s:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, np.add(s, p), 1)
                    np.add.at(delta, e, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(delta[:-1]) == 0)]
                    x, b, q = min(zip(s, e, p, strict=True), key=lambda t: (t[0] - t[1], t[0], t[2]))
                    best = (x, b - x, q, 1000 * (b - x) // q)
                listed = "".join(f"{x},{b - x},{q}\n" for x, b, q in zip(s, e, p, strict=True))
                whole = b" ".join(words)
                row = [keys[d], len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()]
                if output:
                    row += [[{"start": x, "length": b - x, "period": q} for x, b, q in zip(s, e, p, strict=True)], whole.decode()]
                rows.append(row)
            columns = list(zip(*rows, strict=True))
            types = [c.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
            types += [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()] if output else []
            names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if output else [])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return documents.select(id_col, text_col).mapInArrow(run, fields)

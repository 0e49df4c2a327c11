"""Importance resampling towards a target distribution, with word tries.

Features are all runs of 1 to `longest` words. A task puts its words, at most HELD bytes of text at a time, into a trie:
the node of a run of words holds how often it occurs and the state of CRC-32 after its words, which a child's state goes
on from. So no feature is ever spelled out. Counting adds the nodes' counts to the totals of their buckets; only those
are merged between tasks, `buckets` rows for each task. Scoring builds tries again, attaches to each node the gain of
its bucket, and sums gains along the paths that a document walks.

A gain is floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) for counts s of S in all documents and t of T in the target. A
document's score is the floored mean of its gains plus Gumbel noise from its id; the highest `percent` % of documents
with at least `min_words` words are drawn. Ranks come from one range partitioning by score and the sizes of its parts,
of which one number each reaches the driver; no task sees all rows.

Edges: null and empty texts have no features and weight 0. A null doc_id has no noise of its own: it draws from the text
`null`. Rows that repeat a doc_id are scored each by its own text; equal rows take neighbouring ranks. An empty corpus or
target only has zero counts. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, partitions, staged
from .words import LOWER, Words

HELD = 4 << 20
WORD = 64
NO_WORD = np.ones(256, bool)  # bytes outside digits, letters and everything beyond ASCII
NO_WORD[48:58] = NO_WORD[97:123] = NO_WORD[128:] = False
ROW = 33  # bits that a row number takes in monotonically_increasing_id


@functools.lru_cache(1)
def byte_steps() -> np.ndarray:
    """What CRC-32 mixes into the register for each value of its lowest byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    return one


@functools.lru_cache(1)
def zero_steps() -> np.ndarray:
    """[b][k][v]: the CRC-32 register with value v in byte k, after 2^b zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [(now >> np.uint32(8)) ^ byte_steps()[now & np.uint32(255)]]
    for _ in range(31):
        out.append(through(out[-1], out[-1]))
    return np.stack(out)


def through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def advanced(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts after which `size` zero bytes come, less the part of those bytes alone."""
    crc = crc.copy()
    for bit in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> bit & 1)
        crc[at] = through(zero_steps()[bit], crc[at])
    return crc


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: bytes = b"") -> np.ndarray:
    """CRC-32 of `before` and data[start : start + size] for each pair, byte by byte over all that have one more."""
    state = np.full(len(starts), ~zlib.crc32(before) & 0xFFFFFFFF, np.uint32)
    open_ = np.flatnonzero(sizes > 0)
    for k in range(WORD):
        if not len(open_):
            break
        now = state[open_]
        state[open_] = (now >> np.uint32(8)) ^ byte_steps()[(now ^ data[starts[open_] + k]) & np.uint32(255)]
        open_ = open_[sizes[open_] > k + 1]
    out = ~state
    for i in open_.tolist():  # the few words of more than WORD bytes
        out[i] = zlib.crc32(data[starts[i] + WORD : starts[i] + sizes[i]].tobytes(), int(out[i]))
    return out


class Trie:
    """Runs of 1 to `longest` words of some texts. levels[k] has the CRC state and count of its nodes, the places in
    the texts where a run of k + 1 words begins, and each place's node."""

    def __init__(self, texts, longest: int):
        self.words = w = Words(texts, LOWER, NO_WORD)
        n = len(w.starts)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if not n:
            return
        body = np.ascontiguousarray(w.data[~NO_WORD[w.data]])
        ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
        child, names = column.indices.to_numpy().astype(np.int64), column.dictionary
        edges = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
        spelled, size = np.frombuffer(names.buffers()[2], np.uint8), np.diff(edges)
        state, suffix, grown = crcs(spelled, edges[:-1], size), crcs(spelled, edges[:-1], size, b" "), size + 1
        at, node = np.arange(n), child
        self.levels.append((state, np.bincount(child, minlength=len(names)), at, node))
        for k in range(1, longest):
            go = at + k < w.first[1:][w.doc[at]]
            at, node = at[go], node[go]
            edges, node, count = np.unique(node * len(names) + child[at + k], return_inverse=True, return_counts=True)
            parent, step = edges // len(names), edges % len(names)
            state = advanced(state[parent], grown[step]) ^ suffix[step]
            self.levels.append((state, count, at, node))

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for state, count, _, _ in self.levels:
            np.add.at(out, state % np.uint32(buckets), count)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and sum of gains of each text."""
        docs = len(self.words.counts)
        many, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for state, _, at, node in self.levels:
            upto = np.concatenate([[0], np.cumsum(gains[state % np.uint32(len(gains))][node])])
            edge = np.searchsorted(at, self.words.first)
            many += np.diff(edge)
            total += np.diff(upto[edge])
        return many, total


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for c in chunks(batches, 0, HELD):
            total += Trie(c.column(0), longest).totals(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_features, weight, score, words."""
    kind = dict(documents.dtypes)[id_col]

    def run(batches):
        for c in chunks(batches, 1, HELD):
            trie = Trie(c.column(1), longest)
            many, total = trie.walked(gain)
            weight = total // np.maximum(many, 1)
            score = weight + np.array([noise(k, seed) for k in c.column(0).to_pylist()], np.int64)
            columns = [c.column(0), *(pa.array(x, pa.int64()) for x in (many, weight, score, trie.words.counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_features", "weight", "score", "words"])

    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_features long, weight long, score long, words long")


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with rank 1, 2, 3... by falling score, then id; and how many they are."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight")]
    parts = partitions(spark)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = staged(dealt)  # places hold for good once they are written
    part = F.shiftright("place", ROW).cast("int")
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)])]).tolist()
    rank = F.get(F.lit(before), part) + F.col("place").bitwiseAND((1 << ROW) - 1) + 1
    return dealt.withColumn("rank", rank.cast("long")).drop("place"), sum(sizes.values())


def resample(documents: DataFrame, target: DataFrame, buckets: int = 10000, longest: int = 2, seed: int = 7, min_words: int = 20, percent: int = 25, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank; rank is null for documents that are not drawn."""
    gain = gains(bucket_counts(documents, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_col))
    rows = staged(scored(documents, gain, longest, seed, id_col, text_col))
    eligible, n = ranked(rows.where(F.col("words") >= min_words))
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = rows.where(F.col("words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return eligible.select(*columns, drawn.alias("rank")).unionAll(rest)

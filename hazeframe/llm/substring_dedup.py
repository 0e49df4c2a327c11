"""Substring dedup by difference-cover anchors.

The cover {0, 1, 3, 9} modulo 13 holds, for any two places i and j, an offset k < 13 that puts i + k and j + k
both on cover places. So two equal windows of 20 words share an 8-word anchor that both documents hash,
although each hashes only 4 of 13 places.

1. Every document's anchors go, packed, to hash buckets; anchors that occur twice come back to the parts
   (ranges of doc_id) that hold them.
2. Each part extends repeated anchors to the windows around them and sends those windows' fingerprints
   to hash buckets. A window that a smaller part also holds comes back.
3. Each part removes words covered by a window that an earlier part, or an earlier place in the part, holds.

Order is (doc_id, start). Rows that share a doc_id are one document: equal places are not earlier than
each other. A null doc_id stands before all others; a null text has no words; texts under 20 words lose nothing.
The result has one row per input row, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, partitions, staged
from .packed import Sender, answers, member
from .words import Words, mix, span_hash

PERIOD, COVER = 13, (0, 1, 3, 9)
LOWEST = -(1 << 63)


def with_part(rows: DataFrame, id_col: str, parts: int) -> DataFrame:
    """rows with a column part: ranges of the id by approximate quantiles, so outliers and uneven ids cost no balance.

    At most `parts` edges reach the driver. Null ids are part 0. A part grows beyond its share only where one id, or
    neighbours above 2^53 that a double cannot tell apart, hold that many rows.
    """
    place = rows.select(F.col(id_col).cast("double").alias("place"))
    edges = sorted(set(place.stat.approxQuantile("place", [i / parts for i in range(1, parts)], 1 / (16 * parts)))) if parts > 1 else []
    if not edges:
        return rows.withColumn("part", F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_place", outputCol="_part", handleInvalid="keep")
    placed = cut.transform(rows.withColumn("_place", F.col(id_col).cast("double")))
    return placed.withColumn("part", F.when(F.col("_place").isNull(), 0).otherwise(F.col("_part").cast("int"))).drop("_place", "_part")


class Scanned:
    """Word hashes and anchors of a batch of texts."""

    def __init__(self, texts, length: int):
        self.words = w = Words(texts)
        self.h = w.hashes()
        self.length, self.anchor = length, length - PERIOD + 1
        at = w.windows(self.anchor)
        inside = at - w.first[w.doc[at]]
        self.at = at[np.isin(inside % PERIOD, COVER) & (w.counts[w.doc[at]] >= length)]

    def anchors(self) -> np.ndarray:
        return mix(span_hash(self.h, self.at, self.at + self.anchor, 0xD6E8FEB86659FD93), 1)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts, as word numbers, of windows that hold a repeated anchor."""
        n = len(self.h)
        seen = np.zeros(n + PERIOD + 1, np.int32)
        seen[self.at[repeated] + 1] = 1
        np.cumsum(seen, out=seen)
        at = self.words.windows(self.length)
        return at[seen[at + PERIOD] > seen[at]]

    def windows(self, at: np.ndarray) -> np.ndarray:
        return mix(span_hash(self.h, at, at + self.length, 0xCA5A826395121157), 2)


def kept_row(text: str | None, keep: np.ndarray | None) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    kept = words if keep is None else list(compress(words, keep))
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeats(documents: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", output: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with output also kept_text."""
    if length < PERIOD + 1:
        raise ValueError(f"length must be over {PERIOD}")
    spark = documents.sparkSession
    parts = partitions(spark)
    kind = dict(documents.dtypes)[id_col]
    docs = with_part(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", parts).select("part", "id", "text")

    def send_anchors(batches):
        out = Sender(parts, "<u4")
        for c in chunks(batches, 1):
            s = Scanned(c.column(1), length)
            yield from out.add(s.anchors(), c.column(0).to_numpy()[s.words.doc[s.at]])
        yield from out.flush()

    repeated = answers(docs.select("part", "text").mapInArrow(send_anchors, "bucket int, keys binary, parts binary"), parts, "<u4", earlier=False)

    def with_answers(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of each part after the answers for it."""
        blank = found.select("part", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), "bucket", "keys", F.lit(None).cast("binary").alias("at"))
        at = F.col("at") if "at" in rows.columns else F.lit(None).cast("binary")
        full = rows.select("part", F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("keys"), at.alias("at"))
        return blank.union(full).repartitionById(parts, "part").sortWithinPartitions("part", "kind")

    def split(batches, width: str, small: int):
        """(part, sorted keys, rows) for each run of one part."""
        got, part, table = [], None, None
        for batch in batches:
            for b in runs(batch):
                p, k = b.column(0)[0].as_py(), b.column(1)[0].as_py()
                if p != part:
                    got, part, table = [], p, None
                if k == 0:
                    for bucket, keys in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                        x = np.frombuffer(keys, width).astype(np.uint64)
                        got.append(x if small == 8 else x | np.uint64(bucket << 32))
                else:
                    if table is None:
                        table = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
                        got = []
                    yield p, table, b

    def runs(batch):
        if batch.num_rows:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                yield batch.slice(s, e - s)

    columns = f"bucket int, keys binary, parts binary, part int, id {kind}, n_words long, n_removed long, kept_sha256 string, text string, at binary"
    id_type = pa.int64() if kind == "bigint" else pa.int32()

    def extend(batches):
        out = Sender(parts, "<u8", most=1)
        empty = {"bucket": pa.int32(), "keys": pa.binary(), "parts": pa.binary(), "part": pa.int32(), "id": id_type, "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "text": pa.string(), "at": pa.binary()}

        def row_batch(n: int, have: dict):
            return pa.RecordBatch.from_arrays([have[k] if k in have else pa.nulls(n, t) for k, t in empty.items()], names=list(empty))

        def sent(it):
            for b in it:
                yield row_batch(b.num_rows, dict(zip(b.schema.names, b.columns, strict=True)))

        for part, table, rows in split(batches, "<u4", 4):
            for c in chunks([rows], 3):
                s = Scanned(c.column(3), length)
                h = s.anchors()
                key = (bucket_key(h, parts) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                at = s.candidates(member(key, table))
                yield from sent(out.add(s.windows(at), np.full(len(at), part)))
                cut = np.searchsorted(at, s.words.first)
                texts, ids = c.column(3).to_pylist(), c.column(2).cast(id_type)
                has = cut[1:] > cut[:-1]
                plain = np.flatnonzero(~has)
                done = [kept_row(texts[i], None) for i in plain]
                if done:
                    n, r, sha = zip(*done, strict=True)
                    have = {"id": ids.take(pa.array(plain)), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
                    if output:
                        have["text"] = pa.array([" ".join((texts[i] or "").encode().split() and [w.decode() for w in (texts[i] or "").encode().split()]) for i in plain], pa.string())
                    yield row_batch(len(done), have)
                if has.any():
                    wait = np.flatnonzero(has)
                    starts = [(at[cut[i] : cut[i + 1]] - s.words.first[i]).astype("<u4").tobytes() for i in wait]
                    yield row_batch(len(wait), {"part": pa.array([part] * len(wait), pa.int32()), "id": ids.take(pa.array(wait)), "text": pa.array([texts[i] for i in wait], pa.string()), "at": pa.array(starts, pa.binary())})
        yield from sent(out.flush())

    mixed = staged(with_answers(docs, repeated).mapInArrow(extend, columns))
    earlier = answers(mixed.where("bucket is not null").select("bucket", "keys", "parts"), parts, "<u8", earlier=True)
    waiting = mixed.where("part is not null").select("part", "id", "text", "at")
    result = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if output else "")

    def resolve(batches):
        part, held = None, []

        def close():
            h, ids, place, doc = (np.concatenate([x[k] for x in held]) for k in range(4))
            gone = np.concatenate([x[4] for x in held])
            order = np.lexsort((place, ids, h))
            h, ids, place, doc, gone = h[order], ids[order], place[order], doc[order], gone[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            gone |= (ids > ids[lead]) | (place > place[lead])
            texts, keys = [t for x in held for t in x[5]], [i for x in held for i in x[6]]
            by = np.argsort(doc[gone], kind="stable")
            d, p = doc[gone][by], place[gone][by]
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            for lo in range(0, len(texts), 256):
                rows, kept = [], []
                for i in range(lo, min(lo + 256, len(texts))):
                    words = (texts[i] or "").encode().split()
                    delta = np.zeros(len(words) + 1, np.int32)
                    np.add.at(delta, p[cut[i] : cut[i + 1]], 1)
                    np.add.at(delta, p[cut[i] : cut[i + 1]] + length, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    rows.append(kept_row(texts[i], keep))
                    kept.append(b" ".join(compress(words, keep)).decode() if output else None)
                n, r, sha = zip(*rows, strict=True)
                cols = [pa.array(keys[lo : lo + 256], id_type), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.string())] if output else [])], names=[id_col, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if output else [])])

        count = 0
        for p, table, rows in split(batches, "<u8", 8):
            if p != part and held:
                yield from close()
                held, count = [], 0
            part = p
            for c in chunks([rows], 3):
                s = Scanned(c.column(3), length)
                starts = [np.frombuffer(x, "<u4").astype(np.int64) for x in c.column(6).to_pylist()]
                doc = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
                place = np.concatenate(starts)
                h = s.windows(place + s.words.first[doc])
                keys = c.column(2).to_pylist()
                order_id = np.array([LOWEST if k is None else k for k in keys], np.int64)
                held.append((h, order_id[doc], place, doc + count, member(h, table), c.column(3).to_pylist(), keys))
                count += len(starts)
        if held:
            yield from close()

    finished = mixed.where("kept_sha256 is not null").select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *([F.col("text").alias("kept_text")] if output else []))
    return finished.union(with_answers(waiting, earlier).mapInArrow(resolve, result))


def bucket_key(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)

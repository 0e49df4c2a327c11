"""Content-addressed store of token ids.

write_store() encodes documents, cuts every id stream where a rolling sum over hashes of its last 8 ids falls
below a bound (and after `longest` ids), stores each distinct chunk once under its BLAKE2b digest, and keeps one
recipe per document: its chunk digests in order, its start in the corpus-wide stream and a Merkle root over the
digests. Recipes lie sorted by doc_id in range-partitioned files. The manifest, a one-row JSON table, holds the Merkle
root over all recipes, their number, the ids' width and the end id.

read_store() rebuilds ids from the files; checked() re-reads every chunk, recomputes its digest and CRC, and
combines the CRCs by recipe without moving ids, after it has checked the recipes against the manifest.

A null text is empty and has only the end id. Null doc_ids come first. Rows that repeat a doc_id are ordered by
their root and each has a start of its own. An empty table gives empty files.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import chunks, partitions
from .substring_dedup import with_part
from .words import mix

DIGEST, ROLL = 16, 8


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node rises unchanged. The root of nothing is the digest of nothing."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


@functools.lru_cache(1)
def id_values() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64), 5).astype(np.uint32)


def cuts(ids: np.ndarray, ends: np.ndarray, average: int, longest: int) -> np.ndarray:
    """Ends of chunks in ids, whose documents end at ends. Depends on a document's own ids only."""
    n = len(ids)
    cut = np.zeros(n + 1, bool)
    if n >= ROLL:
        total = np.zeros(n + 1, np.uint32)
        np.cumsum(id_values()[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint32), out=total[1:], dtype=np.uint32)
        h = (total[ROLL:] - total[:-ROLL]) * np.uint32(0x9E3779B1)
        hit = np.flatnonzero(h < np.uint32((1 << 32) // average)) + ROLL  # ends of windows
        starts = np.concatenate([[0], ends[:-1]])
        cut[hit[hit - starts[np.searchsorted(ends, hit, side="left")] >= ROLL]] = True
    cut[ends] = True
    cut[0] = False
    edge = np.flatnonzero(cut)
    before = np.concatenate([[0], edge[:-1]])
    long = np.flatnonzero(edge - before > longest)
    more = [np.arange(before[i] + longest, edge[i], longest) for i in long]
    return np.sort(np.concatenate([edge, *more])).astype(np.int64)


@functools.lru_cache(1)
def shift_tables(longest: int) -> np.ndarray:
    """[n][k][b]: CRC-32 register, byte k of value b, after n ids (4n zero bytes)."""
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(longest + 1):
        out[n] = now
        for _ in range(4):
            now = (now >> np.uint32(8)) ^ table[now & np.uint32(255)]
    return out


def joined_crc(crcs: list[int], sizes: list[int], longest: int) -> int:
    tables = shift_tables(longest)
    total = 0
    for crc, n in zip(crcs, sizes, strict=True):
        t = tables[n]
        total = int(t[0, total & 255] ^ t[1, total >> 8 & 255] ^ t[2, total >> 16 & 255] ^ t[3, total >> 24]) ^ crc
    return total


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, average: int = 256, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = documents.sparkSession
    buckets = partitions(spark)
    wide = max(codec(tokenizer).tokens) > 65535 or end_id > 65535
    width = "<u4" if wide else "<u2"
    kind = dict(documents.dtypes)[id_col]
    id_type = pa.int64() if kind == "bigint" else pa.int32()

    def encode(batches):
        c = codec(tokenizer)
        held: dict[bytes, bytes] = {}
        size = 0

        def send():
            by: dict[int, list[bytes]] = {}
            for d in held:
                by.setdefault(int.from_bytes(d[:4], "big") * buckets >> 32, []).append(d)
            b, rows = [], []
            for k, ds in by.items():
                b.append(k)
                lengths = np.array([len(held[d]) for d in ds], "<u4").tobytes()
                flat = np.frombuffer(b"".join(held[d] for d in ds), np.uint8).reshape(-1, np.dtype(width).itemsize)
                body = pa.compress(np.ascontiguousarray(flat.T).tobytes(), "zstd", asbytes=True)  # by byte planes
                rows.append(np.array([len(ds), len(flat)], "<u4").tobytes() + b"".join(ds) + lengths + body)
            n = len(b)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(rows, pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["bucket", "pack", "id", "digests", "lengths"])

        for part in chunks(batches, 1):
            ids, ends = c.encode_all(part.column(1))
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
            edge = cuts(ids, ends, average, longest)
            raw, item = ids.astype(width).tobytes(), np.dtype(width).itemsize
            digests, before = [], 0
            for e in (edge * item).tolist():
                piece = raw[before:e]
                d = digest(piece)
                digests.append(d)
                if d not in held:
                    held[d] = piece
                    size += len(piece)
                before = e
            lengths = np.diff(edge, prepend=0).astype("<u4")
            at = np.searchsorted(edge, ends, side="right").tolist()
            rows = [(b"".join(digests[s:e]), lengths[s:e].tobytes()) for s, e in zip([0, *at[:-1]], at, strict=True)]
            n = len(rows)
            where = (np.arange(n) + int.from_bytes(digests[0][:4], "big")) % buckets
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.nulls(n, pa.binary()), part.column(0).cast(id_type), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "pack", "id", "digests", "lengths"])
            if size > 6 << 20:
                yield from send()
                held, size = {}, 0
        if held:
            yield from send()

    def unique(batches):
        seen: set[bytes] = set()
        item = np.dtype(width).itemsize

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string(), pa.binary(), pa.binary(), id_type, pa.binary(), pa.binary()], strict=True)], names=["kind", "digest", "ids", "id", "digests", "lengths"])

        for batch in batches:
            rows = []
            for pack, key, digests, lengths in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if pack is None:
                    rows.append(("recipe", None, None, key, digests, lengths))
                    continue
                k, n = np.frombuffer(pack, "<u4", 2).tolist()
                names = [pack[8 + i * DIGEST : 8 + (i + 1) * DIGEST] for i in range(k)]
                sizes = np.frombuffer(pack, "<u4", k, 8 + k * DIGEST).tolist()
                flat = np.frombuffer(pa.decompress(pack[8 + k * (DIGEST + 4) :], n * item, "zstd", asbytes=True), np.uint8)
                raw, at = np.ascontiguousarray(flat.reshape(item, n).T).tobytes(), 0
                for d, s in zip(names, sizes, strict=True):
                    if d not in seen:
                        seen.add(d)
                        rows.append(("chunk", d, raw[at : at + s], None, None, None))
                    at += s
                if len(rows) > 4000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    encoded = documents.select(id_col, text_col).mapInArrow(encode, f"bucket int, pack binary, id {kind}, digests binary, lengths binary")
    mixed = encoded.repartitionById(buckets, "bucket").mapInArrow(unique, f"kind string, digest binary, ids binary, id {kind}, digests binary, lengths binary")
    mixed.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    schema = f"digest binary, ids binary, id {kind}, digests binary, lengths binary"
    plain = spark.read.schema(schema + ", kind string").parquet(f"{path}/objects").where("kind = 'recipe'").select("id", "digests", "lengths")

    def rooted(batches):
        for b in batches:
            d, s = b.column(1).to_pylist(), b.column(2).to_pylist()
            n = [int(np.frombuffer(x, "<u4").sum()) for x in s]
            root = [merkle([x[i : i + DIGEST] for i in range(0, len(x), DIGEST)]) for x in d]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(root, pa.binary()), b.column(1), b.column(2), b.column(3)], names=["id", "n_tokens", "root", "digests", "lengths", "part"])

    recipes = with_part(plain, "id", buckets).mapInArrow(rooted, f"id {kind}, n_tokens long, root binary, digests binary, lengths binary, part int")
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.asc_nulls_first("id"), "root").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        recipes.withColumn("upto", F.sum("n_tokens").over(within))
        .join(F.broadcast(offsets), "part")
        .select("part", "id", (F.col("offset") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "root", "digests", "lengths")
        .repartitionById(buckets, "part")
        .sortWithinPartitions("part", F.asc_nulls_first("id"), "root")
    )
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    facts = range_root(spark.read.parquet(f"{path}/recipes"))
    facts.select("root", "documents", F.lit(width).alias("width"), F.lit(end_id).alias("end_id"), F.lit(longest).alias("longest")).write.json(f"{path}/manifest")


def range_root(recipes: DataFrame) -> DataFrame:
    """root, documents: Merkle root over id, start, length and root of all recipes, in the order of their starts.

    Each level joins what starts in one range of 2^16, 2^32, 2^48 and 2^64 ids, so no node has over 65,536 children.
    """
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("root")), 256)
    level = recipes.select(F.col("start").alias("key"), leaf.alias("hash"), F.lit(1).cast("long").alias("documents"))
    for _ in range(4):
        children = F.array_sort(F.collect_list(F.struct("key", "hash")))
        joined = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["key"], c["hash"])), ","), 256)
        level = level.groupBy(F.shiftright("key", 16).alias("up")).agg(joined.alias("hash"), F.sum("documents").alias("documents")).withColumnRenamed("up", "key")
    return level.agg(F.coalesce(F.max("hash"), F.lit("")).alias("root"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


def _opened(spark: SparkSession, path: str):
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = dict(recipes.dtypes)["id"]
    objects = spark.read.schema(f"digest binary, ids binary, id {kind}, digests binary, lengths binary, kind string").parquet(f"{path}/objects")
    facts = spark.read.schema("root string, documents long, width string, end_id int, longest int").json(f"{path}/manifest").first()
    return recipes, objects.where("kind = 'chunk'").select("digest", "ids"), facts


def _steps(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document."""
    at = F.posexplode(F.expr(f"sequence(0, cast(octet_length(digests) div {DIGEST} as int) - 1)"))
    return recipes.where("n_tokens > 0").select("start", "digests", at.alias("seq", "_i")).select("start", "seq", F.expr(f"substring(digests, seq * {DIGEST} + 1, {DIGEST})").alias("digest"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, token_ids: documents rebuilt from their chunks."""
    recipes, stored, facts = _opened(spark, path)
    width = facts["width"]

    def build(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in sorted(row, key=lambda x: x["seq"])), width).astype("<i4") for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["start", "token_ids"])

    rows = _steps(recipes).join(stored, "digest").groupBy("start").agg(F.collect_list(F.struct("seq", "ids")).alias("got"))
    return recipes.select("id", "start", "n_tokens").join(rows.mapInArrow(build, "start long, token_ids array<int>"), "start", "left")


def checked(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files; fails on recipes that don't match the manifest's root and
    count, a chunk that doesn't match its digest, a recipe that doesn't match its root and a chunk that is missing or
    stored twice."""
    recipes, stored, facts = _opened(spark, path)
    found = range_root(recipes).first()
    if (found["root"], found["documents"]) != (facts["root"], facts["documents"]):
        raise ValueError("the recipes do not match the manifest")
    width, longest = facts["width"], facts["longest"]
    kind = dict(recipes.dtypes)["id"]

    def crc(batches):
        for b in batches:
            names, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            if any(digest(i) != n for n, i in zip(names, ids, strict=True)):
                raise ValueError("a chunk does not match its digest")
            wide = [np.frombuffer(i, width).astype("<u4") for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.crc32(w) for w in wide], pa.int64()), pa.array([len(w) for w in wide], pa.int32())], names=["digest", "crc", "n"])

    def combine(batches):
        for b in batches:
            out = []
            for key, start, n_tokens, root, seq, names, crcs, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seq != list(range(len(seq))) or merkle(names) != root:
                    raise ValueError("a document does not match its recipe")
                if None in sizes or sum(sizes) != n_tokens:
                    raise ValueError("a document's chunks are missing or have other lengths")
                out.append((key, start, n_tokens, joined_crc(crcs, sizes, longest)))
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [b.column(0).type, pa.int64(), pa.int64(), pa.int64()], strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    facts_of = stored.mapInArrow(crc, "digest binary, crc long, n int")
    got = _steps(recipes).join(facts_of, "digest", "left").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "crc", "n"))).alias("got"))
    return recipes.select("id", "start", "n_tokens", "root").join(got, "start", "left").select("id", "start", "n_tokens", "root", "got.seq", "got.digest", "got.crc", "got.n").mapInArrow(combine, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")

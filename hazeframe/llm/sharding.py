"""Weighted rendezvous hashing of record keys over shards; DataFrame functions only.

Every (key, shard) pair gets a uniform draw u from a 52-bit MD5 prefix; the key goes to the shard with the
largest -weight / ln(u). A new shard competes with unchanged scores, so it takes rows only into itself and
no row moves between old shards. Weights change a shard's expected share in proportion.

Null keys form one key of their own, null texts have size 1 and CRC 0, repeated rows get the same shard and
neighbouring slots. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO52 = float(1 << 52)


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def draw(key: Column, shard: int) -> Column:
    """In (0, 1); decided by the key and the shard number alone."""
    prefix = F.substring(F.md5(F.concat_ws(":", key_text(key), F.lit(str(shard)))), 1, 13)
    return (F.conv(prefix, 16, 10).cast("long").cast("double") + 0.5) / F.lit(TWO52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard; ties, which need equal 52-bit draws, go to the larger number."""
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative and not all zero")
    best = F.greatest(*pair) if len(pair := [F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]) > 1 else pair[0]
    return best["shard"]


def shard_documents(documents: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", hex_digits: int = 2) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number each shard's rows by md5(key). Rows are numbered inside 16^hex_digits ranges of that order,
    and the ranges' offsets come from their counts, so no task sees a whole shard. The offsets table has at
    most len(weights) * 16^hex_digits rows, which bounds the broadcast.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    grown = grown or [*weights, max(weights)]
    placed = documents.select(
        key,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        F.md5(key_text(key)).alias("_order"),
    ).withColumn("_range", F.substring("_order", 1, hex_digits))
    counts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_range").orderBy("_order", id_col, "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_range"])
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_row") - 1).alias("slot"), "grown_shard")
    )

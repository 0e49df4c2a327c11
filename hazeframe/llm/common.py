"""Shared pieces: staged tables and components of the core, batching of Arrow text."""

from __future__ import annotations

import gc

import pyarrow.compute as pc
from pyspark.sql import SparkSession

from hazeframe.operators.graph import components
from hazeframe.operators.staging import clear, remove, scratch, staged, written

__all__ = ["chunks", "clear", "components", "partitions", "release", "remove", "scratch", "staged", "written"]


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of steps that are staged: it does so when their objects are collected."""
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches, text: int, max_bytes: int = 2 << 20):
    """Slices of Arrow batches that hold at most max_bytes of text, or one row."""
    for batch in batches:
        col = batch.column(text)
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)

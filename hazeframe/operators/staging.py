"""Tables written once into the shared folder, to cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 100_000
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a session in one process, as in tests, may do without that setting;
    on a cluster its absence is an error, since no other folder is known to be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    _made.append(f"{base.rstrip('/')}/hazeframe-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, *partition_by: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """df written and read back, and its folder; survives lost executors. rows, at least as many as df has, spares
    small tables a file for each shuffle partition."""
    path = scratch(df.sparkSession)
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all shuffle partitions, before steps that do much work for each small row: a table of few bytes is
    read as one split, which would leave that work to one task. Rows are dealt evenly, so no key makes a part large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, *partition_by: str, rows: int | None = None) -> DataFrame:
    return written(df, *partition_by, rows=rows)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no table still to be read depends on."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all folders this process made. Results not yet written elsewhere are lost with them."""
    remove(spark, *list(_made))

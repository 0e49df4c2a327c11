"""Streams over keyed state in files: amendments that replace originals, and polls of which only changes go on."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazeframe.operators import quality
from hazeframe.operators.snapshot import Folder


class KeyedTable:
    """The best row of each key after every batch, in hash buckets.

    A batch rewrites only the buckets it touches; a manifest per batch says which batch wrote each bucket last. A batch
    starts from the manifest before its own number, so one that is tried again, after whatever it left behind, gives the
    same table. `schema` is that of the rows, of which `key` is one column.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.key, self.schema, self.buckets = spark, key, schema, buckets
        self.folder = Folder(spark, root)
        self.columns = spark.createDataFrame([], schema).columns

    def written(self, before: int | None = None) -> dict[str, int]:
        """Bucket to the batch that wrote it, of the newest manifest, or of the newest one below `before`."""
        numbers = [int(n.split(".")[0]) for n in self.folder.names("manifests")]
        numbers = [n for n in numbers if before is None or n < before]
        return json.loads(self.folder.text(f"manifests/{numbers[-1]:010d}.json")) if numbers else {}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, after the newest batch or the one before `before`."""
        parts = [f"{self.folder.root}/data/{n:010d}/_bucket={b}" for b, n in self.written(before).items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, number: int, *order: Column) -> None:
        """Keep of each key the row that is greatest by order, of the table and the batch. order must settle all ties,
        then batches may come in any sequence."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
        base = self.written(number)
        if touched:
            rows = self.read(number, touched).select(*self.columns).unionByName(batch.select(*self.columns))
            best = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), F.struct(*order)).alias("r")).select("r.*")
            best.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.folder.root}/data/{number:010d}")
        self.folder.replace(f"manifests/{number:010d}.json", json.dumps(base | {str(b): number for b in touched}, sort_keys=True))


def _run(stream: DataFrame, checkpoint: str, write) -> StreamingQuery:
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def amended(stream: DataFrame, table: KeyedTable, checkpoint: str, *order: Column) -> StreamingQuery:
    """Keep the newest row of each key: late amendments replace originals, late originals replace nothing."""
    return _run(stream, checkpoint, lambda batch, number: table.upsert(batch, number, *order))


def changed(stream: DataFrame, table: KeyedTable, sink: str, checkpoint: str, order: str, value: str) -> StreamingQuery:
    """Write to sink/<batch> the rows whose value differs from the one their key had before, over batches and restarts.

    The state is each key's last row. Polls are taken in the order given inside a batch; one that arrives in a later
    batch than a newer poll is compared with that newer one, and does not become the key's state.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = table.read(number).select(*table.columns, F.lit(0).alias("_new"))
        rows = old.unionByName(batch.select(*table.columns, F.lit(1).alias("_new")))
        w = Window.partitionBy(table.key).orderBy("_new", order)
        before = rows.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(w))
        out = before.where((F.col("_new") == 1) & (F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))))
        out.select(*table.columns).write.mode("overwrite").parquet(f"{sink}/{number:010d}")
        table.upsert(batch, number, F.col(order))

    return _run(stream, checkpoint, write)


def last_good(stream: DataFrame, table: KeyedTable, sink: str, checkpoint: str) -> StreamingQuery:
    """Write source, run, status, payload of outcomes (source, run, ok, payload) to sink/<batch>: a failed run repeats the
    last good payload, over batches and restarts.

    The state is each source's newest good outcome, in `table` (source, run, payload). Runs are taken in order inside a
    batch; the work is quality.carried(), so a busy source is no single task's.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = table.read(number).select("source", F.lit(None).cast("long").alias("run"), F.struct("payload").alias("good"), F.lit(True).alias("_old"), F.lit(True).alias("ok"))
        now = batch.select("source", "run", F.when(F.col("ok"), F.struct("payload")).alias("good"), F.lit(False).alias("_old"), "ok")
        least = F.lit(-(1 << 63))  # the state comes before all runs
        rows = quality.carried(old.unionByName(now).withColumn("_run", F.coalesce("run", least)), "source", "_run", "good").where(~F.col("_old"))
        status = F.when(F.col("ok"), "ok").when(F.col("carried").isNull(), "unavailable").otherwise("stale")
        rows.select("source", "run", status.alias("status"), F.col("carried.payload").alias("payload")).write.mode("overwrite").parquet(f"{sink}/{number:010d}")
        table.upsert(batch.where("ok").select("source", "run", "payload"), number, F.col("run"))

    return _run(stream, checkpoint, write)

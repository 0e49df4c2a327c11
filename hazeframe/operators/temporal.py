"""Temporal operators: as-of brackets, nearest instants, stitched runs, visible windows, resident frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(queries: DataFrame, timeline: DataFrame, by: str, at: str, instant: str, most_gap: int) -> DataFrame:
    """Adds before, after, t and shown to queries: the instants around each query and how to blend them.

    One sort of both tables by (by, time) and two running values: no range join. An exact hit stands alone; a gap over
    most_gap snaps to the nearer side, ties to the earlier; beyond either end the end stands alone.
    """
    marks = timeline.select(by, F.col(instant).alias("_time"), F.lit(0).alias("_kind"))
    rows = queries.select(by, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    both = rows.unionByName(marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    up = Window.partitionBy(by).orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.desc("_time"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_kind") == 0, F.col("_time"))
    got = both.withColumn("_lo", F.last(own, ignorenulls=True).over(up)).withColumn("_hi", F.last(own, ignorenulls=True).over(down)).where("_kind = 1")
    lo, hi, x = F.coalesce("_lo", "_hi"), F.coalesce("_hi", "_lo"), F.col("_time")
    wide = hi - lo > most_gap
    snap = F.when(x - lo > hi - x, hi).otherwise(lo)
    before, after = F.when(wide, snap).otherwise(lo), F.when(wide, snap).otherwise(hi)
    return got.where(F.coalesce("_lo", "_hi").isNotNull()).select("_row.*", before.alias("before"), after.alias("after")).withColumn(
        "t", F.when(F.col("after") > F.col("before"), (F.col(at) - F.col("before")) / (F.col("after") - F.col("before"))).otherwise(0.0)
    )


def nearest_instant(brackets: DataFrame, at: str) -> Column:
    """Nearer of before and after; ties go to the earlier."""
    return F.when(F.col(at) - F.col("before") <= F.col("after") - F.col(at), F.col("before")).otherwise(F.col("after"))


def stitched(first: DataFrame, second: DataFrame, time: str) -> DataFrame:
    """All of first, and second only after first's last time."""
    last = first.agg(F.max(time).alias("_last"))  # one row
    return first.unionByName(second.crossJoin(F.broadcast(last)).where(F.col(time) > F.coalesce("_last", F.lit(-(1 << 31)))).drop("_last"))


def paired(spine: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides on a spine, rows with at least one of them; left and right bear a column of their own."""
    a, b = [next(c for c in d.columns if c != key) for d in (left, right)]
    return spine.join(left, key, "left").join(right, key, "left").where(F.col(a).isNotNull() | F.col(b).isNotNull())


def paired_fields(hours: DataFrame, first: DataFrame, second: DataFrame, first_run: str | None) -> DataFrame:
    """valid, first, second, second_run of hours (valid, second_run): the stored fields (run, valid, field) of the run of
    each model, the second one's where the hour names a run.

    A model that is off (first_run None, second_run null) gives null; a field that is due and not stored fails the read,
    so no frame is composed of half its sources.
    """
    a = first.where(F.col("run") == first_run).select("valid", F.col("field").alias("first")) if first_run is not None else first.where(F.lit(False)).select("valid", F.col("field").alias("first"))
    b = second.select(F.col("run").alias("second_run"), "valid", F.col("field").alias("second"))
    both = hours.select("valid", "second_run").join(a, "valid", "left").join(b, ["valid", "second_run"], "left")
    lost = (F.lit(first_run is not None) & F.col("first").isNull()) | (F.col("second_run").isNotNull() & F.col("second").isNull())
    fault = F.raise_error(F.concat(F.lit("a stored field disappeared: "), F.col("valid").cast("string")))
    return both.select("valid", F.when(lost, fault.cast(dict(first.dtypes)["field"])).otherwise(F.col("first")).alias("first"), "second", "second_run")


def visible(frames: DataFrame, by: str, time: str, clock: Column, horizon: int) -> DataFrame:
    """Frames from the last one at or before the clock (else the first) to the horizon after it."""
    start = frames.groupBy(by).agg(F.coalesce(F.max(F.when(F.col(time) <= clock, F.col(time))), F.min(time)).alias("_start"))
    return frames.join(start, by).where(F.col(time).between(F.col("_start"), F.col("_start") + horizon)).drop("_start")


def resident(before: Column, after: Column, blending: Column, count: Column) -> Column:
    """At most three distinct frame numbers to keep: current, next, the one after, the previous; at the end, the first two."""
    following = F.when(blending, after).otherwise(before + 1)
    at_end = (before == count - 1) & (after == count - 1) & (count > 2)
    wanted = F.when(at_end, F.array(count - 1, F.lit(0), F.lit(1))).otherwise(F.array(before, following, following + 1, before - 1))
    return F.slice(F.array_distinct(F.filter(wanted, lambda i: (i >= 0) & (i < count))), 1, 3)

"""Series operators: last write, newest with tie rules, dense hour spines, trailing frames, NowCast, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions import air

EPOCH = "1970-01-01"


def hour_index(ts: Column) -> Column:
    """Hours since the epoch; the same in every session time zone for timestamps without one."""
    return (F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date")) * 24 + F.hour(ts)).cast("int")


def minute_index(ts: Column) -> Column:
    return hour_index(ts) * 60 + F.minute(ts)


def last_write(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """One row per key: the value written last. Partial aggregation, no window."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def newest(df: DataFrame, key: str, time: str, *tie: Column) -> DataFrame:
    """One row per key: newest time, ties by the given order. Keeps all columns."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def hour_spine(df: DataFrame, key: str, hour: str) -> DataFrame:
    """Every hour between each key's first and last."""
    ends = df.groupBy(key).agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    return ends.select(key, F.explode(F.sequence("_lo", "_hi")).alias(hour))


def dense(df: DataFrame, key: str, hour: str, *values: str) -> DataFrame:
    """key, hour and values for every hour between each key's first and last; null values in the gaps.

    df has one row per key and hour. Each row fills the hours up to its successor, so there is one shuffle by key, which
    windows by key that follow use too, and no join with a spine.
    """
    w = Window.partitionBy(key).orderBy(hour)
    upto = F.coalesce(F.lead(hour).over(w) - 1, F.col(hour))
    rows = df.select(key, F.col(hour).alias("_at"), *values, upto.alias("_upto"))
    filled = rows.select(key, "_at", *values, F.explode(F.sequence("_at", "_upto")).alias(hour))
    return filled.select(key, hour, *[F.when(F.col(hour) == F.col("_at"), F.col(v)).alias(v) for v in values])


def trailing_slots(df: DataFrame, key: str, hour: str, value: str, n: int = 12) -> DataFrame:
    """Adds slots: the n values up to each hour of a dense spine, newest first, null for a gap."""
    frame = Window.partitionBy(key).orderBy(hour).rowsBetween(1 - n, 0)
    return dense(df, key, hour, value).withColumn("slots", F.reverse(F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(frame), lambda x: x["v"])))


def nowcast_series(df: DataFrame, key: str, hour: str, value: str) -> DataFrame:
    """key, hour, nowcast, index, category where there is enough data."""
    out = trailing_slots(df, key, hour, value).withColumn("nowcast", air.nowcast(F.col("slots"))).where("nowcast IS NOT NULL")
    out = out.withColumn("aqi", air.pm25_index(air.tenths(F.col("nowcast"))))
    return out.select(key, hour, "nowcast", "aqi", air.index_category(F.col("aqi")).alias("category"))


def missing_hours(df: DataFrame, key: str, hour: str) -> DataFrame:
    """Hours between a key's first and last without a row: what lies between a row and its successor."""
    after = F.lead(hour).over(Window.partitionBy(key).orderBy(hour))
    gaps = df.select(key, F.col(hour).alias("_at"), after.alias("_next")).where("_next > _at + 1")
    return gaps.select(key, F.explode(F.sequence(F.col("_at") + 1, F.col("_next") - 1)).alias(hour))


def run_lengths(df: DataFrame, key: str, order: str, good: Column) -> DataFrame:
    """Adds streak: rows since the last good one, 0 on a good row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_good", good.cast("int")).withColumn("_island", F.sum("_good").over(w))
    within = Window.partitionBy(key, "_island").orderBy(order)
    first_island = F.when(F.col("_island") == 0, F.row_number().over(within)).otherwise(F.row_number().over(within) - 1)
    return marked.withColumn("streak", first_island).drop("_good", "_island")


def is_canonical(df: DataFrame, key: str, hour: str) -> DataFrame:
    """key, n, ordered, hourly: whether a key's hours are distinct and gapless."""
    w = Window.partitionBy(key).orderBy(hour)
    steps = df.withColumn("_step", F.col(hour) - F.lag(hour).over(w))
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("ordered"), F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)).alias("hourly"))

"""File sources: provincial CSV pairs, JSON record files, raw text bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.functions import air, clock, geo
from hazeframe.operators import contract, series

HOURLY = "DATE_PST string, EMS_ID string, STATION_NAME string, PARAMETER string, RAW_VALUE string, UNITS string, LATITUDE string, LONGITUDE string"
STATIONS = "EMS_ID string, STATION_NAME string, STATION_OWNER string, LATITUDE string, LONGITUDE string"


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """value, path: whole text files."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def read_order() -> Column:
    """Place of a row of a file source: by file, then by place in the file, however the files were split and packed.

    A split of one file is read in order by one task, where the numbers rise.
    """
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def csv_stations(spark: SparkSession, path: str) -> DataFrame:
    """id, name, lon, lat: stations in bounds; the last row of an id wins, by file and place in it."""
    rows = spark.read.csv(path, header=True, schema=STATIONS)
    out = rows.select(F.col("EMS_ID").alias("id"), F.col("STATION_NAME").alias("name"), F.expr("try_cast(LONGITUDE as double)").alias("lon"), F.expr("try_cast(LATITUDE as double)").alias("lat"), read_order().alias("ord"))
    return series.last_write(out.where(geo.in_monitor_regions(F.col("lon"), F.col("lat"))).withColumn("r", F.struct("name", "lon", "lat")), ["id"], "r", "ord").select("id", "r.*")


def csv_hourly(spark: SparkSession, path: str) -> DataFrame:
    """id, hour, value, lon, lat: PM2.5 in µg/m³, not negative; the last row of a station and hour wins."""
    rows = spark.read.csv(path, header=True, schema=HOURLY)
    value = air.usable(F.expr("try_cast(RAW_VALUE as double)"))
    at = clock.pacific_standard(F.col("DATE_PST"))
    out = rows.where((F.upper("PARAMETER") == "PM25") & air.is_mass_unit(F.col("UNITS"))).select(F.col("EMS_ID").alias("id"), F.floor(F.unix_timestamp(at) / 3600).cast("int").alias("hour"), value.alias("value"), F.expr("try_cast(LONGITUDE as double)").alias("lon"), F.expr("try_cast(LATITUDE as double)").alias("lat"), read_order().alias("ord"))
    kept = out.where("value IS NOT NULL AND hour IS NOT NULL").withColumn("r", F.struct("value", "lon", "lat"))
    return series.last_write(kept, ["id", "hour"], "r", "ord").select("id", "hour", "r.*")


def located(facts: DataFrame, stations: DataFrame, key: str = "id") -> DataFrame:
    """Left join of coordinates: the station's unless missing or zero, else the fact's; out of bounds rows go."""
    dim = stations.select(key, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    pick = lambda c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(0.0)), F.col(c)).alias(c)
    out = facts.join(dim, key, "left").select(*[c for c in facts.columns if c not in ("lon", "lat")], pick("lon"), pick("lat"))
    return out.where(geo.in_monitor_regions(F.col("lon"), F.col("lat")))


def csv_monitors(spark: SparkSession, hourly: str, stations: str, now_hour: int) -> DataFrame:
    """The provincial pipeline: the last 12 hours of each station to its latest NowCast monitor."""
    facts = csv_hourly(spark, hourly).where(F.col("hour").between(now_hour - 12, now_hour))
    monitors = series.nowcast_series(facts.select("id", "hour", "value"), "id", "hour", "value")
    latest = monitors.groupBy("id").agg(F.max_by(F.struct("hour", "nowcast", "aqi", "category"), "hour").alias("m")).select("id", "m.*")
    where = facts.groupBy("id").agg(F.max_by(F.struct("lon", "lat"), "hour").alias("p")).select("id", "p.*")
    return located(latest.join(where, "id"), csv_stations(spark, stations))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def monitor_assets(spark: SparkSession, assets: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of all monitor assets (source, path) that can be read, and (source, ok) outcomes in the given order.

    A missing asset is a partial failure; if every one is missing, the load fails. An asset is a folder or file of JSON
    lines, each one monitor; rows that break the contract go, legacy rows are normalised, `precedence` keeps the order.
    """
    rows, outcomes = None, []
    for place, (source, path) in enumerate(assets):
        outcomes.append((source, exists(spark, path)))
        if outcomes[-1][1]:
            own = spark.read.schema(contract.MONITOR).json(path).where(contract.valid_monitor()).withColumn("precedence", F.lit(place))
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no monitor asset could be read")
    return contract.normalised(rows), spark.createDataFrame(outcomes, "source string, ok boolean")


def incident_assets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Incidents of all assets that can be read; of an id the last one wins, by asset and, within one, by place."""
    there = [(n, p) for n, p in enumerate(paths) if exists(spark, p)]
    if paths and not there:
        raise ValueError("no incident asset could be read")
    rows = None
    for n, path in there:
        own = spark.read.schema(contract.INCIDENT + ", place long").json(path).where(contract.valid_incident()).withColumn("precedence", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    value = [c for c in rows.columns if c not in ("id", "place", "precedence")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*value), F.struct("precedence", "place")).alias("r")).select("id", "r.*")

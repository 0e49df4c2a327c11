"""Station series of the Mexican network: responses of a day or two of hours to one NowCast monitor a station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions import air, clock
from hazeframe.sources import payloads

HOURS = "array<struct<valor:string,fecha:string,hora:string>>"
STALE_HOURS = 2


def hourly(bodies: DataFrame, stations: DataFrame, now: Column) -> DataFrame:
    """id, hour, value of bodies (id, body) and stations (id, zone): the hours that are whole, finite, not negative and
    not over 15 minutes ahead. Local hours become UTC hours; of several rows for one hour the last in the body counts."""
    rows = bodies.select("id", F.posexplode(payloads.json_literal(F.col("body"), HOURS)).alias("ord", "h")).join(stations.select("id", "zone"), "id")
    value, hour = air.usable(F.expr("try_cast(h.valor as double)")), F.expr("try_cast(h.hora as int)")
    day = F.when(F.col("h.fecha").rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.expr("try_cast(h.fecha as date)"))
    at = clock.local_hour(day.cast("string"), hour, F.col("zone"))
    good = rows.select("id", "ord", value.alias("value"), F.when(hour.between(0, 23), at).alias("at")).where(F.col("value").isNotNull() & F.col("at").isNotNull() & (F.col("at") <= now + F.expr("interval 15 minutes")))
    return good.groupBy("id", F.floor(F.unix_timestamp("at") / 3600).cast("int").alias("hour")).agg(F.max_by("value", "ord").alias("value"))


def monitors(bodies: DataFrame, stations: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Monitors (id, name, agency, lon, lat, observed, concentration, nowcast, aqi, category) and outcomes (id, outcome).

    A station's index is the NowCast of the twelve hours up to now. Without a body, a readable hour or enough recent hours
    there is no monitor; outcome is failed, sparse, stale (newest hour over two hours old, which has a monitor if its
    hours suffice) or ok. A failed station does not touch the others.
    """
    series = hourly(bodies, stations, now)
    end = F.floor(F.unix_timestamp(now) / 3600).cast("int")
    slot = F.when((end - F.col("hour")).between(0, 11), F.struct((end - F.col("hour")).alias("age"), "value"))
    own = series.groupBy("id").agg(F.max("hour").alias("latest"), F.max_by("value", "hour").alias("concentration"), F.map_from_entries(F.collect_list(slot)).alias("slots"))  # twelve entries at most
    slots = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.try_element_at(F.col("slots"), k))
    known = own.select("id", "latest", "concentration", air.nowcast(slots).alias("nowcast")).withColumn("aqi", air.pm25_index(air.tenths(F.col("nowcast"))))
    late = F.unix_timestamp(now) - F.col("latest") * 3600 > STALE_HOURS * 3600
    outcome = F.when(F.col("latest").isNull(), "failed").when(late, "stale").when(F.col("nowcast").isNull(), "sparse").otherwise("ok")
    outcomes = stations.select("id").distinct().join(known, "id", "left").select("id", outcome.alias("outcome"))
    good = known.where("nowcast IS NOT NULL").join(stations, "id")
    return good.select("id", "name", "agency", "lon", "lat", F.timestamp_seconds(F.col("latest") * 3600).alias("observed"), "concentration", "nowcast", "aqi", air.index_category(F.col("aqi")).alias("category")), outcomes

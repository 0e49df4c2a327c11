"""The given tables seen as the domain's relations, with the same arithmetic in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators import series

HOUR_SQL = "(date_diff('day', DATE '1970-01-01', ts::DATE) * 24 + hour(ts))::INT"
LON_SQL = "(-140 + (({k} * 7919) % 9000) / 100.0)"
LAT_SQL = "(15 + (({k} * 104729) % 5500) / 100.0)"


def readings(events: DataFrame) -> DataFrame:
    """event_id, station, hour, minute, value, kind."""
    return events.select("event_id", "ts", F.col("user_id").cast("int").alias("station"), series.hour_index(F.col("ts")).alias("hour"), series.minute_index(F.col("ts")).alias("minute"), "value", F.col("event_type").alias("kind"))


def hourly(events: DataFrame) -> DataFrame:
    """station, hour, value: the last write of each hour."""
    return series.last_write(readings(events), ["station", "hour"], "value", "ts", "event_id")


HOURLY_SQL = f"""
hourly AS (
  SELECT user_id::INT AS station, {HOUR_SQL} AS hour, max_by(value, (ts, event_id)) AS value
  FROM events GROUP BY ALL)"""


def at(key: str, shift: int = 0):
    k = F.col(key) + shift
    return (-140 + ((k * 7919) % 9000) / 100.0).alias("lon"), (15 + ((k * 104729) % 5500) / 100.0).alias("lat")


def stations(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """id, name, lon, lat, aqi, age_min, system, source."""
    def of(df, key, name, source, shift):
        k = F.col(key)
        return df.select((k * 2 + shift).alias("id"), F.col(name).alias("name"), *at(key, shift), (k * 37 % 301).cast("int").alias("aqi"), (k * 13 % 240).cast("int").alias("age_min"), F.when(k % 7 == 0, "ca-aqhi").otherwise("us-epa-aqi").alias("system"), F.lit(source).alias("source"))

    return of(supplier, "s_suppkey", "s_name", "supplier", 0).unionByName(of(customer, "c_custkey", "c_name", "customer", 1))


STATIONS_SQL = f"""
stations AS (
  SELECT s_suppkey * 2 AS id, s_name AS name, {LON_SQL.format(k='s_suppkey')} AS lon, {LAT_SQL.format(k='s_suppkey')} AS lat,
    (s_suppkey * 37 % 301)::INT AS aqi, (s_suppkey * 13 % 240)::INT AS age_min, CASE WHEN s_suppkey % 7 = 0 THEN 'ca-aqhi' ELSE 'us-epa-aqi' END AS system, 'supplier' AS source FROM supplier
  UNION ALL
  SELECT c_custkey * 2 + 1, c_name, {LON_SQL.format(k='(c_custkey + 1)')}, {LAT_SQL.format(k='(c_custkey + 1)')},
    (c_custkey * 37 % 301)::INT, (c_custkey * 13 % 240)::INT, CASE WHEN c_custkey % 7 = 0 THEN 'ca-aqhi' ELSE 'us-epa-aqi' END, 'customer' FROM customer)"""


def cities(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """city_id, name, region, priority, lon, lat."""
    few = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return few.select(F.col("c_custkey").alias("city_id"), F.col("c_name").alias("name"), F.col("n_name").alias("region"), (1 + F.col("c_custkey") % 2).cast("int").alias("priority"), *at("c_custkey", 3))


CITIES_SQL = f"""
cities AS (
  SELECT c_custkey AS city_id, c_name AS name, n_name AS region, (1 + c_custkey % 2)::INT AS priority,
    {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

KM_SQL = "2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - ({h}))))".format(
    h="pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"
)


def cells(lineitem: DataFrame, width: int = 64, height: int = 40) -> DataFrame:
    """cx, cy, first, second: two models' mean values on a grid."""
    cx, cy = (F.col("l_partkey") % width).cast("int").alias("cx"), (F.col("l_suppkey") * 3 % height).cast("int").alias("cy")
    of = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.floor(F.col("l_extendedprice")) / 100))
    return lineitem.groupBy(cx, cy).agg(of("A").alias("first"), of("R").alias("second"))


CELLS_SQL = """
cells AS (
  SELECT (l_partkey % 64)::INT AS cx, (l_suppkey * 3 % 40)::INT AS cy,
    avg(CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice) / 100 END) AS first,
    avg(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) / 100 END) AS second
  FROM lineitem GROUP BY ALL)"""

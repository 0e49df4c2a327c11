"""Queries over remaining scalars, rules, frames and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import air, clock, geo, text
from hazeframe.operators import contract, quality, ranking, raster, spatial
from hazeframe.operators.staging import scratch
from hazeframe.plans.domain import CELLS_SQL, HOUR_SQL, KM_SQL, LAT_SQL, LON_SQL, at, cells, readings
from hazeframe.plans.registry import query
from hazeframe.sources import demo, files


@query("F05_city_identity", "SELECT c_custkey, 'USA:' || n_name || ':' || c_name AS id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def city_identity(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", text.city_identity(F.lit("USA"), F.col("n_name"), F.col("c_name")).alias("id"))


@query("F07_index_labels", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'AQHI ' || (event_id % 10) ELSE 'AQI ' || (event_id % 300) END AS label FROM events")
def index_labels(t):
    k = F.col("event_id")
    return t.events.select("event_id", air.index_label(F.when(k % 3 == 0, "ca-aqhi").otherwise("us-epa-aqi"), F.when(k % 3 == 0, k % 10).otherwise(k % 300)).alias("label"))


@query("F11_sources", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'given' WHEN 1 THEN 'aqhi' ELSE 'bcair' END AS source FROM customer")
def sources(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", text.source_of(F.when(k % 3 == 0, "given").when(k % 3 == 1, ""), F.concat(F.when(k % 3 == 1, "aqhi:").otherwise("bcair:"), k)).alias("source"))


@query("D01_iso_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso_times(t):
    return t.orders.select("o_orderkey", clock.iso(F.col("o_orderdate").cast("timestamp")).alias("iso"))


@query("D03_zoned_hours", "SELECT o_orderkey, epoch(timezone('UTC', timezone('America/Tijuana', date_trunc('day', o_orderdate) + to_hours((4 + o_orderkey % 20)::BIGINT))))::BIGINT // 3600 AS hour FROM orders")
def zoned_hours(t):
    """Local hours of a zone with daylight saving, all year; the clocks change before four."""
    utc = clock.local_hour(F.date_format("o_orderdate", "yyyy-MM-dd"), (4 + F.col("o_orderkey") % 20).cast("int"), F.lit("America/Tijuana"))
    return t.orders.select("o_orderkey", F.floor(F.unix_timestamp(utc) / 3600).alias("hour"))


@query("M19_faint_alpha", "SELECT event_id, round(40 / 255.0::DOUBLE * least(1.0, greatest(0.0, value / 100)), 9) AS alpha FROM events")
def faint_alpha(t):
    return t.events.select("event_id", F.round(air.faint_alpha(F.col("value") / 100), 9).alias("alpha"))


@query("M31_micrograms", "SELECT event_id, round(value, 6) AS v FROM events")
def micrograms(t):
    return t.events.select("event_id", F.round(air.micrograms(F.col("value") * 1e-9), 6).alias("v"))


@query("W16_priorities", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 ELSE 0 END, c_custkey)::INT AS rank FROM customer")
def priorities(t):
    """Arrays of unequal length compare as if padded with zeros."""
    k = F.col("c_custkey")
    own = F.when(k % 2 == 0, F.array((k % 3).cast("int"), (k % 5).cast("int"))).otherwise(F.array((k % 3).cast("int")))
    rows = t.customer.withColumn("p", ranking.priority(own, 2))
    return ranking.numbered(rows, "c_nationkey", F.asc("p"), F.asc("c_custkey")).select("c_custkey", "rank")


@query("W18_first_times", f"WITH h AS (SELECT DISTINCT user_id, {HOUR_SQL} AS hour FROM events) SELECT user_id::INT AS user_id, hour FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour) <= 73")
def first_times(t):
    """The first 73 valid times of each run (a feature of the provider's runs)."""
    hours = readings(t.events).select(F.col("station").alias("user_id"), "hour").distinct()
    return ranking.numbered(hours, "user_id", F.asc("hour")).where("rank <= 73").select("user_id", "hour")


@query("S40_native_hours", "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 60 > 48 THEN 'hour' END, CASE WHEN o_orderkey % 7 * 20 > 60 THEN 'valid-time' END, CASE WHEN o_orderkey % 11 = 0 THEN 'cells' END], lambda x: x IS NOT NULL)) AS rule FROM orders")
def native_hours(t):
    """Rules for one decoded forecast hour: within the run, at the time asked for, and not empty."""
    k = F.col("o_orderkey")
    return quality.violations(t.orders, "o_orderkey", {"hour": (k % 60).between(0, 48), "valid-time": F.abs(k % 7 * 20) <= 60, "cells": k % 11 > 0})


@query("S33_landmark_rules", "SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'rank' END, CASE WHEN p_brand NOT LIKE 'Brand#%' OR p_size % 5 = 0 THEN 'category' END], lambda x: x IS NOT NULL)) AS rule FROM part")
def landmark_rules(t):
    """Rank and category of landmarks, as rules over their rows."""
    return quality.violations(t.part, "p_partkey", {"rank": F.col("p_size").between(1, 40), "category": F.col("p_brand").startswith("Brand#") & (F.col("p_size") % 5 != 0)})


@query("S06_csv_stations", "SELECT 'E' || c_custkey AS id, -121.0::DOUBLE AS lon FROM customer WHERE c_custkey % 3 <> 0")
def csv_stations(t):
    """The provincial station list, written from customers; one in three out of bounds."""
    root = scratch(t.spark)
    k = F.col("c_custkey")
    t.customer.select(F.concat(F.lit("E"), k).alias("EMS_ID"), F.lit("n").alias("STATION_NAME"), F.lit("o").alias("STATION_OWNER"), F.when(k % 3 == 0, "95").otherwise("49.0").alias("LATITUDE"), F.lit("-121.0").alias("LONGITUDE")).write.csv(root, header=True)
    return files.csv_stations(t.spark, root).select("id", "lon")


@query("K04_frame_sink", f"SELECT ({HOUR_SQL} // 12 * 12)::INT AS hour, count(*) AS n FROM events GROUP BY 1")
def frame_sink(t):
    """Frames written by valid time, each in a partition of its own, and read back."""
    root = scratch(t.spark)
    rows = readings(t.events).select((F.floor(F.col("hour") / 12) * 12).cast("int").alias("hour"), "event_id")
    rows.repartition("hour").write.partitionBy("hour").parquet(root)
    return t.spark.read.schema("event_id long, hour int").parquet(root).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@query("K10_status_log", "SELECT 2 AS runs, (SELECT count(*) FROM nation) * 2 AS rows")
def status_log(t):
    """A status document appended by each run."""
    root = scratch(t.spark)
    for run in (1, 2):
        t.nation.select(F.lit(run).alias("run"), "n_nationkey").write.mode("append").parquet(root)
    return t.spark.read.schema("run int, n_nationkey int").parquet(root).agg(F.count_distinct("run").cast("int").alias("runs"), F.count(F.lit(1)).alias("rows"))


@query("R06_composed_frames", f"""
WITH {CELLS_SQL}, f AS (SELECT cx, cy, CASE WHEN cx % 9 <> 0 THEN first END AS a, CASE WHEN cy % 7 <> 0 THEN second END AS b, cx % 5 <> 0 AS covered FROM cells)
SELECT cx AS x, cy AS y, round(CASE WHEN covered THEN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + 0.5 * greatest(b - a, 0) WHEN a IS NOT NULL THEN a ELSE b END END, 6) AS merged,
  CASE WHEN NOT covered THEN 0 WHEN a IS NOT NULL AND b IS NOT NULL AND b > a THEN 3 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS code, 0 AS tile FROM f WHERE a IS NOT NULL OR b IS NOT NULL""")
def composed_frames(t):
    """Two fields merged by weight under a coverage mask and cut into tiles; this grid lies in the first tile."""
    c = cells(t.lineitem)
    first = c.where("cx % 9 <> 0 AND first IS NOT NULL").select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("first").alias("value"))
    second = c.where("cy % 7 <> 0 AND second IS NOT NULL").select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("second").alias("value"))
    got = raster.composed(first, second, F.lit(0.5), F.col("x") % 5 != 0)
    return got.select("x", "y", F.round("merged", 6).alias("merged"), "code", "tile")


@query("R11_coverage_mask", f"""
WITH p AS (SELECT c_custkey, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer),
m AS (SELECT DISTINCT floor(lon)::INT AS mx, floor(lat)::INT AS my FROM p WHERE c_custkey % 2 = 0)
SELECT c_custkey, EXISTS (SELECT 1 FROM m WHERE mx = floor(lon) AND my = floor(lat)) AS covered FROM p""")
def coverage_mask(t):
    """A mask of covered cells as a table that points are looked up in."""
    rows = t.customer.select("c_custkey", *at("c_custkey", 3)).withColumn("mx", F.floor("lon").cast("int")).withColumn("my", F.floor("lat").cast("int"))
    mask = rows.where("c_custkey % 2 = 0").select("mx", "my", F.lit(True).alias("on")).distinct()
    return rows.join(mask, ["mx", "my"], "left").select("c_custkey", F.coalesce("on", F.lit(False)).alias("covered"))


@query("R16_mask_codes", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_id % 5 END::INT AS code FROM events")
def mask_codes(t):
    """Codes of mask colours, one channel off by one; an unknown colour has none."""
    k = F.col("event_id") % 5
    rgba = [F.element_at(F.array(*[F.lit(c[i]) for c in (*raster.MASK.values(), (9, 9, 9, 9))]), (k + 1).cast("int")) for i in range(4)]
    return t.events.select("event_id", raster.mask_code(rgba[0] + (F.col("event_id") % 2).cast("int"), *rgba[1:]).alias("code"))


@query("P02_unwrapped_bounds", "SELECT c_custkey, (c_custkey % 360 - 180) > 90 AS east, CASE WHEN c_custkey % 360 - 180 > 90 THEN c_custkey % 360 - 540 ELSE c_custkey % 360 - 180 END BETWEEN -170 AND -45 AS shown FROM customer")
def unwrapped_bounds(t):
    lon = (F.col("c_custkey") % 360 - 180).cast("double")
    return t.customer.select("c_custkey", (lon > 90).alias("east"), geo.in_display(lon, F.lit(50.0)).alias("shown"))


@query("R26_filled_polygons", """
WITH t AS (SELECT c_custkey, -150 + c_custkey * 7 % 110 AS x, c_custkey * 3 % 75 AS y FROM customer WHERE c_custkey > 0),
e AS (SELECT c_custkey, unnest([x, x + 12, x + 6])::DOUBLE AS px, unnest([y, y, y + 9])::DOUBLE AS py, unnest([x + 6, x, x + 12])::DOUBLE AS qx, unnest([y + 9, y, y])::DOUBLE AS qy FROM t),
c AS (SELECT c_custkey, x + i AS cx, y + j AS cy FROM t, generate_series(0, 12) a(i), generate_series(0, 9) b(j)),
n AS (SELECT c.c_custkey, cx, cy, count(*) AS crossed FROM c JOIN e ON e.c_custkey = c.c_custkey AND (py > cy + 0.5) <> (qy > cy + 0.5) AND cx + 0.5 < (qx - px) * (cy + 0.5 - py) / (qy - py) + px GROUP BY ALL)
SELECT c_custkey, cx::INT AS cx, cy::INT AS cy FROM n WHERE crossed % 2 = 1""")
def filled_polygons(t):
    k = F.col("c_custkey")
    corner = lambda dx, dy: F.struct((-150 + k * 7 % 110 + dx).cast("double").alias("x"), (k * 3 % 75 + dy).cast("double").alias("y"))
    rows = t.customer.where("c_custkey > 0").select("c_custkey", F.array(corner(0, 0), corner(12, 0), corner(6, 9)).alias("ring"))
    return spatial.filled(rows, "c_custkey", "ring")


@query("R27_coastal_cells", f"""
WITH a AS (SELECT c_custkey, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer),
b AS (SELECT {LON_SQL.format(k='s_suppkey')} AS lon, {LAT_SQL.format(k='s_suppkey')} AS lat FROM supplier), d AS (SELECT a.c_custkey, {KM_SQL} AS km FROM a, b)
SELECT c_custkey, round(min(km), 5) AS km FROM d WHERE km <= 200 GROUP BY c_custkey""")
def coastal_cells(t):
    """Points within 200 km of land and their distance to it."""
    land = t.supplier.select(*at("s_suppkey", 0)).toDF("r_lon", "r_lat")
    return spatial.coastal(t.customer.select("c_custkey", *at("c_custkey", 3)), land, "c_custkey").select("c_custkey", F.round("km", 5).alias("km"))


@query("W14_incident_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY 'i' || o_orderkey)::INT AS rank FROM orders")
def incident_order(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.concat(F.lit("i"), "o_orderkey").alias("id"))
    return ranking.numbered(rows, "o_custkey", F.asc("id")).select("o_orderkey", "rank")


@query("S29_demo_manifest", """
WITH d AS (SELECT ts::DATE AS day, max(ts) AS now FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, 37 AS frames, 73 AS first_frames, 49 AS second_frames, 8 AS sources, strftime(date_trunc('hour', now) + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS last_valid,
  strftime(now - INTERVAL 120 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS fires_seen, 0 AS broken FROM d""")
def demo_manifest(t):
    """A synthetic snapshot for the last reading of each day, held against every rule of the contract."""
    whole = demo.manifests(t.events.groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("now")))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in contract.manifest_rules().items()]))
    size = lambda name: F.size(f"forecasts.{name}.frames")
    return whole.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), size("best").alias("frames"), size("firework").alias("first_frames"), size("hrrr").alias("second_frames"), F.size("sources").alias("sources"),
        F.element_at("forecast.frames", -1)["validTime"].alias("last_valid"), F.col("sources")["cwfis"]["observedAt"].alias("fires_seen"), F.size(broken).alias("broken"),
    )


"""Queries over hourly readings: series, NowCast, guards, windows, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeframe.functions import air, clock
from hazeframe.operators import quality, series
from hazeframe.plans.domain import HOUR_SQL, HOURLY_SQL, hourly, readings
from hazeframe.plans.registry import query

SPINE_SQL = HOURLY_SQL + """,
ends AS (SELECT station, min(hour) AS lo, max(hour) AS hi FROM hourly GROUP BY station),
spine AS (SELECT station, unnest(generate_series(lo, hi))::INT AS hour FROM ends),
dense AS (SELECT s.station, s.hour, h.value FROM spine s LEFT JOIN hourly h ON h.station = s.station AND h.hour = s.hour)"""

INDEX_SQL = "CASE " + " ".join(
    f"WHEN t <= {khi} THEN (({ihi - ilo}) * (t - {klo}) * 2 + {khi - klo}) // {2 * (khi - klo)} + {ilo}" if n < 5 else f"ELSE (({ihi - ilo}) * (t - {klo}) * 2 + {khi - klo}) // {2 * (khi - klo)} + {ilo}"
    for n, (klo, khi, ilo, ihi) in enumerate(air.BREAKPOINTS)
) + " END"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN aqi <= {top} THEN '{name}'" for top, name in air.CATEGORIES) + " ELSE 'Beyond the AQI' END"
NOWCAST_SQL = f"""
WITH {SPINE_SQL},
stats AS (
  SELECT c.station, c.hour, max(v.value) AS hi, min(v.value) AS lo, count(CASE WHEN c.hour - v.hour < 3 THEN v.value END) AS recent
  FROM dense c JOIN dense v ON v.station = c.station AND v.hour BETWEEN c.hour - 11 AND c.hour GROUP BY ALL),
weight AS (SELECT *, CASE WHEN hi = 0 AND lo = 0 THEN 1.0 WHEN hi = 0 THEN 0.5 ELSE greatest(0.5, lo / hi) END AS w FROM stats WHERE recent >= 2),
sums AS (
  SELECT c.station, c.hour, sum(v.value * pow(c.w, c.hour - v.hour)) / sum(CASE WHEN v.value IS NOT NULL THEN pow(c.w, c.hour - v.hour) END) AS x
  FROM weight c JOIN dense v ON v.station = c.station AND v.hour BETWEEN c.hour - 11 AND c.hour GROUP BY ALL),
cut AS (SELECT station, hour, trunc(round(x * 10, 6))::INT AS t FROM sums),
scored AS (SELECT station, hour, t / 10.0::DOUBLE AS nowcast, ({INDEX_SQL})::INT AS aqi FROM cut)
SELECT station, hour, nowcast, aqi, {CATEGORY_SQL} AS category FROM scored"""


@query("M05_nowcast_aqi", NOWCAST_SQL)
def nowcast_aqi(t):
    """Hourly readings to NowCast, index and category: last write, dense spine, 12-hour frame."""
    return series.nowcast_series(hourly(t.events), "station", "hour", "value")


@query("A03_last_write", f"WITH {HOURLY_SQL} SELECT * FROM hourly")
def last_write(t):
    return hourly(t.events)


@query("A01_newest_first_wins", f"SELECT station, hour, event_id FROM (SELECT user_id::INT AS station, {HOUR_SQL} AS hour, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY station ORDER BY hour DESC, event_id) = 1")
def newest_first(t):
    return series.newest(readings(t.events).select("station", "hour", "event_id"), "station", "hour", F.asc("event_id"))


@query("A02_amendment_wins", f"SELECT station, hour, kind, event_id FROM (SELECT user_id::INT AS station, {HOUR_SQL} AS hour, event_type AS kind, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY station ORDER BY hour DESC, kind = 'purchase' DESC, event_id) = 1")
def amendment(t):
    return series.newest(readings(t.events).select("station", "hour", "kind", "event_id"), "station", "hour", F.desc(F.col("kind") == "purchase"), F.asc("event_id"))


@query("A04_latest_hour", f"WITH {HOURLY_SQL} SELECT station, max(hour) AS hour, max_by(value, hour) AS value FROM hourly GROUP BY station")
def latest_hour(t):
    return hourly(t.events).groupBy("station").agg(F.max("hour").alias("hour"), F.max_by("value", "hour").alias("value"))


@query("A05_observed_max", f"SELECT event_type AS kind, max({HOUR_SQL}) AS hour, count(*) AS n FROM events GROUP BY 1")
def observed_max(t):
    return readings(t.events).groupBy("kind").agg(F.max("hour").alias("hour"), F.count(F.lit(1)).alias("n"))


@query("A06_collapse_guard", f"""
WITH counts AS (SELECT event_type AS kind, {HOUR_SQL} // 6 AS run, count(*) AS n FROM events GROUP BY ALL),
seen AS (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY run) AS previous FROM counts)
SELECT kind, run, n, previous, coalesce(previous >= 8 AND n < previous * 0.5, false) AS collapsed FROM seen""")
def collapse(t):
    counts = readings(t.events).groupBy("kind", F.floor(F.col("hour") / 6).cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return quality.collapse_guard(counts, "kind", "run", "n", quality.GUARD_MINIMUM["bcair"])


@query("A07_stale_rate", f"""
WITH u AS (SELECT user_id, event_type AS kind, max({HOUR_SQL}) AS hour FROM events GROUP BY ALL), m AS (SELECT max(hour) AS top FROM u)
SELECT kind, count(*) AS n, count_if(top - hour > 48)::BIGINT AS stale, count_if(top - hour > 48) > 0.85 * count(*) AS failed FROM u, m GROUP BY kind""")
def stale_rate(t):
    last = t.events.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max(series.hour_index(F.col("ts"))).alias("hour"))
    top = last.agg(F.max("hour").alias("top"))  # one row
    stale = F.count_if(F.col("top") - F.col("hour") > 48)
    return last.crossJoin(F.broadcast(top)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), stale.alias("stale"), (stale > 0.85 * F.count(F.lit(1))).alias("failed"))


@query("A12_preferred_state", """
WITH s AS (SELECT user_id::INT AS station, event_type AS kind, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank, min(event_id) AS ord FROM events GROUP BY ALL)
SELECT station, min_by(kind, (rank, ord)) AS kind, bool_and(rank > 1) AS unavailable FROM s GROUP BY station""")
def preferred_state(t):
    rank = F.when(F.col("kind") == "click", 0).when(F.col("kind") == "view", 1).otherwise(2)
    states = readings(t.events).groupBy("station", "kind").agg(F.min("event_id").alias("ord")).withColumn("rank", rank)
    return states.groupBy("station").agg(F.min_by("kind", F.struct("rank", "ord")).alias("kind"), F.bool_and(F.col("rank") > 1).alias("unavailable"))


@query("A14_consecutive_non_fresh", f"""
WITH r AS (SELECT event_type AS kind, {HOUR_SQL} // 6 AS run, count(*) >= 10 AS fresh FROM events GROUP BY ALL),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY kind ORDER BY run) AS island FROM r)
SELECT kind, run, fresh, (row_number() OVER (PARTITION BY kind, island ORDER BY run) - CASE WHEN island = 0 THEN 0 ELSE 1 END)::INT AS streak FROM i""")
def non_fresh(t):
    runs = readings(t.events).groupBy("kind", F.floor(F.col("hour") / 6).cast("int").alias("run")).agg((F.count(F.lit(1)) >= 10).alias("fresh"))
    return series.run_lengths(runs, "kind", "run", F.col("fresh"))


@query("A15_health_rollup", f"""
WITH r AS (SELECT event_type AS kind, {HOUR_SQL} // 24 AS run, (max(date_diff('minute', TIMESTAMP '1970-01-01', ts)) % 90)::INT AS beat, (count(*) % 100)::INT AS fc, (count(*) % 12)::INT AS cover, (count(*) % 3)::INT AS bad FROM events GROUP BY ALL),
i AS (SELECT *, list_filter([CASE WHEN beat > 30 THEN 'stale-heartbeat' END, CASE WHEN fc > 30 THEN 'stale-forecast' END, CASE WHEN cover < 6 THEN 'insufficient-forecast-coverage' END], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT kind, run, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) > 0 THEN 'unhealthy' WHEN bad > 0 THEN 'degraded' ELSE 'healthy' END AS verdict FROM i""")
def health(t):
    n = F.count(F.lit(1))
    runs = readings(t.events).groupBy("kind", F.floor(F.col("hour") / 24).cast("int").alias("run")).agg((F.max("minute") % 90).cast("int").alias("beat"), (n % 100).cast("int").alias("fc"), (n % 12).cast("int").alias("cover"), (n % 3).cast("int").alias("bad"))
    issues, verdict = quality.health(F.col("beat"), F.col("fc"), F.col("cover"), 15, F.col("bad"), F.lit("fresh"))
    return runs.select("kind", "run", F.array_join(issues, ",").alias("issues"), verdict.alias("verdict"))


@query("A16_run_metrics", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak, count_if(value > 400)::BIGINT AS high FROM events GROUP BY 1")
def metrics(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak"), F.count_if(F.col("value") > 400).alias("high"))


@query("A17_missing_hours", f"WITH {SPINE_SQL} SELECT station, hour FROM spine ANTI JOIN hourly USING (station, hour)")
def missing(t):
    return series.missing_hours(hourly(t.events), "station", "hour")


@query("A18_category_counts", "SELECT user_id::INT AS station, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS view, count_if(event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY 1")
def category_counts(t):
    got = readings(t.events).groupBy("station").pivot("kind", ["click", "view", "purchase"]).count()
    return got.na.fill(0, ["click", "view", "purchase"])


@query("M02_pm25_index", f"WITH c AS (SELECT event_id, trunc(round(value * 10, 6))::INT AS t FROM events), s AS (SELECT event_id, t, ({INDEX_SQL})::INT AS aqi FROM c) SELECT event_id, t AS tenth, aqi, {CATEGORY_SQL} AS category FROM s")
def pm25(t):
    cut = t.events.select("event_id", air.tenths(F.col("value")).alias("tenth")).withColumn("aqi", air.pm25_index(F.col("tenth")))
    return cut.withColumn("category", air.index_category(F.col("aqi")))


@query("M06_health_index", """
WITH e AS (SELECT event_id, floor(value) / 40 AS v FROM events)
SELECT event_id, CASE WHEN v > 10 THEN '10+' ELSE greatest(1, least(10, floor(v + 0.5)::BIGINT))::VARCHAR END AS shown,
  CASE WHEN v > 10 THEN 'Very High' WHEN floor(v + 0.5) <= 3 THEN 'Low' WHEN floor(v + 0.5) <= 6 THEN 'Moderate' ELSE 'High' END AS category FROM e""")
def health_index(t):
    v = F.floor("value") / 40
    return t.events.select("event_id", air.health_index_display(v).alias("shown"), air.health_index_category(v).alias("category"))


@query("M21_risk_and_severity", """
WITH c AS (SELECT event_id, trunc(round(value * 10, 6))::INT AS t FROM events), s AS (SELECT event_id, (%s)::INT AS aqi FROM c),
k AS (SELECT event_id, aqi, %s AS category FROM s)
SELECT event_id, CASE WHEN category IN ('Unhealthy', 'Very Unhealthy', 'Hazardous', 'Beyond the AQI') THEN 3 WHEN category = 'Unhealthy for Sensitive Groups' THEN 2 WHEN category = 'Moderate' THEN 1 ELSE 0 END AS risk,
  round(least(1.0, aqi / 500.0), 6)::DOUBLE AS severity, CASE WHEN aqi <= 50 THEN '#00e400' WHEN aqi <= 100 THEN '#ffff00' WHEN aqi <= 150 THEN '#ff7e00' WHEN aqi <= 200 THEN '#ff0000' WHEN aqi <= 300 THEN '#8f3f97' ELSE '#7e0023' END AS colour, 'AQI ' || aqi AS label FROM k""" % (INDEX_SQL, CATEGORY_SQL))
def risk(t):
    system = F.lit("us-epa-aqi")
    got = t.events.select("event_id", air.pm25_index(air.tenths(F.col("value"))).alias("aqi"))
    return got.select("event_id", air.risk_rank(system, air.index_category(F.col("aqi"))).alias("risk"), F.round(air.severity(system, F.col("aqi")), 6).alias("severity"), air.index_colour(F.col("aqi")).alias("colour"), air.index_label(system, F.col("aqi")).alias("label"))


@query("W07_trailing_frame", f"""
WITH {SPINE_SQL} SELECT station, hour, count(value) OVER w AS known, count(value) OVER (PARTITION BY station ORDER BY hour ROWS 2 PRECEDING) AS recent, max(value) OVER w AS high, min(value) OVER w AS low
FROM dense WINDOW w AS (PARTITION BY station ORDER BY hour ROWS 11 PRECEDING)""")
def trailing(t):
    dense = series.dense(hourly(t.events), "station", "hour", "value")
    w = Window.partitionBy("station").orderBy("hour")
    return dense.select("station", "hour", F.count("value").over(w.rowsBetween(-11, 0)).alias("known"), F.count("value").over(w.rowsBetween(-2, 0)).alias("recent"), F.max("value").over(w.rowsBetween(-11, 0)).alias("high"), F.min("value").over(w.rowsBetween(-11, 0)).alias("low"))


@query("W10_canonical_hours", f"""
WITH {HOURLY_SQL}, s AS (SELECT station, hour - lag(hour) OVER (PARTITION BY station ORDER BY hour) AS step FROM hourly)
SELECT station, count(*) AS n, coalesce(bool_and(step > 0), true) AS ordered, coalesce(bool_and(step = 1), true) AS hourly FROM s GROUP BY station""")
def canonical(t):
    return series.is_canonical(hourly(t.events), "station", "hour")


@query("D10_freshness_labels", f"""
WITH e AS (SELECT event_id, (event_id * 7 % 3000)::BIGINT AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS label FROM e""")
def labels(t):
    return t.events.select("event_id", clock.age_label(F.col("event_id") * 7 % 3000).alias("label"))


@query("D16_playback_tick", """
SELECT event_id, CASE WHEN event_id % 5000 * 1000 >= 4000000 THEN 4000000 ELSE least(4000000, greatest(0, event_id % 5000 * 1000) + least(250, greatest(0, event_id % 400)) * 3600) END::BIGINT AS position FROM events""")
def tick(t):
    return t.events.select("event_id", clock.advanced(F.col("event_id") % 5000 * 1000, F.col("event_id") % 400, F.lit(4000000)).cast("long").alias("position"))


@query("T02_staleness", f"""
WITH r AS (SELECT event_type AS kind, max({HOUR_SQL}) AS hour FROM events GROUP BY 1), m AS (SELECT max(hour) AS top FROM r)
SELECT kind, top - hour AS age, CASE WHEN top - hour > 2 THEN 'stale' ELSE 'ok' END AS status FROM r, m""")
def staleness(t):
    last = readings(t.events).groupBy("kind").agg(F.max("hour").alias("hour"))
    top = last.agg(F.max("hour").alias("top"))  # one row
    age = F.col("top") - F.col("hour")
    return last.crossJoin(F.broadcast(top)).select("kind", age.alias("age"), quality.aged_status(F.lit("ok"), age, F.lit(quality.STALE_HOURS["aqhi"])).alias("status"))


@query("T17_tumbling_hours", f"SELECT event_type AS kind, {HOUR_SQL} AS hour, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL")
def tumbling(t):
    return readings(t.events).groupBy("kind", "hour").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


@query("T18_sliding_12h", f"""
WITH h AS (SELECT event_type AS kind, {HOUR_SQL} AS hour, value FROM events)
SELECT kind, until, count(*) AS n, max(value) AS peak FROM (SELECT kind, value, unnest(generate_series(hour + 1, hour + 12))::INT AS until FROM h) GROUP BY ALL""")
def sliding(t):
    """Sliding windows by their end hour. Hours are summed first, so a row is copied 12 times only per hour, not per event."""
    hours = readings(t.events).groupBy("kind", "hour").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    copies = hours.select("kind", F.explode(F.sequence(F.col("hour") + 1, F.col("hour") + 12)).alias("until"), "n", "peak")
    return copies.groupBy("kind", "until").agg(F.sum("n").alias("n"), F.max("peak").alias("peak"))

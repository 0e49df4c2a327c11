"""Queries over joins, rankings and time brackets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators import ranking, series, spatial, temporal
from hazeframe.plans.domain import CITIES_SQL, HOUR_SQL, HOURLY_SQL, KM_SQL, STATIONS_SQL, cities, hourly, readings, stations
from hazeframe.plans.registry import query


def _right(df):
    return df.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")


def _matches(t):
    """Nearest fresh station within 50 km of each city: of the comparable system, else, in Canada, of the health index."""
    fresh = _right(stations(t.supplier, t.customer).where("age_min BETWEEN 0 AND 120").select("id", "aqi", "age_min", "system", "lon", "lat"))
    towns = cities(t.customer, t.nation).withColumn("home", F.col("region") == "CANADA")
    allowed = (F.col("system") == "us-epa-aqi") | ((F.col("system") == "ca-aqhi") & F.col("home"))
    return spatial.nearest_within(towns, fresh, 50.0, "age_min", "id", first=F.col("system") != "us-epa-aqi", where=allowed, sees=("home",), kinds=("system",))


MATCH_SQL = f"""
WITH {STATIONS_SQL}, {CITIES_SQL},
pairs AS (SELECT a.city_id, a.name, a.region, a.priority, b.id, b.aqi, b.age_min, b.system, {KM_SQL} AS km FROM cities a JOIN stations b ON b.age_min BETWEEN 0 AND 120 AND (b.system = 'us-epa-aqi' OR a.region = 'CANADA')),
best AS (SELECT * FROM pairs WHERE km <= 50 QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY system <> 'us-epa-aqi', km, age_min, id) = 1)"""


@query("J05_nearest_station", MATCH_SQL + " SELECT city_id, id, aqi, round(km, 6) AS km FROM best")
def nearest_station(t):
    """Nearest comparable fresh station of each city within 50 km."""
    return _matches(t).select("city_id", "id", "aqi", F.round("km", 6).alias("km"))


TOP_SQL = MATCH_SQL + ", one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, priority, city_id) = 1)"


@query("A11_city_per_station", TOP_SQL + " SELECT id, city_id FROM one")
def city_per_station(t):
    return series.newest(_matches(t).withColumn("near", -F.col("km")), "id", "near", F.asc("priority"), F.asc("city_id")).select("id", "city_id")


@query("W02_worst_cities", TOP_SQL + " SELECT city_id, aqi, round(km, 6) AS km FROM one ORDER BY aqi DESC, age_min, km, priority, city_id LIMIT 5")
def worst_cities(t):
    one = series.newest(_matches(t).withColumn("near", -F.col("km")), "id", "near", F.asc("priority"), F.asc("city_id"))
    return ranking.top(one.withColumn("aqi", F.col("aqi").cast("double")), 5, "aqi", F.asc("age_min"), F.asc("km"), F.asc("priority"), F.asc("city_id")).select("city_id", F.col("aqi").cast("int").alias("aqi"), F.round("km", 6).alias("km"))


@query("J11_nearest_of_few", f"""
WITH {CITIES_SQL}, s AS (SELECT * FROM (WITH {STATIONS_SQL} SELECT * FROM stations) WHERE source = 'supplier'),
p AS (SELECT a.city_id, b.id, {KM_SQL} AS km FROM cities a, s b)
SELECT city_id, min_by(id, (km, id)) AS id, round(min(km), 6) AS km FROM p GROUP BY city_id""")
def nearest_few(t):
    few = _right(stations(t.supplier, t.customer).where("source = 'supplier'").select("id", "lon", "lat"))
    return spatial.nearest(cities(t.customer, t.nation), few, "city_id", "id").select("city_id", "id", F.round("km", 6).alias("km"))


@query("J06_same_station_pairs", f"""
WITH {STATIONS_SQL}, n AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: len(x) >= 4))) AS tokens FROM (SELECT id, 'Site ' || (id // 2 % 5) || ' plant' AS name, floor(lon * 20) / 20 AS lon, floor(lat * 20) / 20 AS lat, system, source FROM stations)),
p AS (SELECT a.id, b.id AS r_id, {KM_SQL} AS km FROM n a JOIN n b ON a.id < b.id AND a.source <> b.source AND a.system = b.system AND floor(a.lon * 10) BETWEEN floor(b.lon * 10) - 1 AND floor(b.lon * 10) + 1
  AND (list_has_all(a.tokens, b.tokens) OR list_has_all(b.tokens, a.tokens)))
SELECT id, r_id FROM p WHERE km <= 0.15""")
def same_station(t):
    rounded = stations(t.supplier, t.customer).select("id", F.concat(F.lit("Site "), F.floor(F.col("id") / 2) % 5, F.lit(" plant")).alias("name"), (F.floor(F.col("lon") * 20) / 20).alias("lon"), (F.floor(F.col("lat") * 20) / 20).alias("lat"), "system", "source")
    return spatial.same_station_pairs(rounded).select("id", "r_id")


@query("J06_merged_stations")
def merged(t):
    """Stations of two sources as one list; order decides, so SQL cannot express it."""
    rows = stations(t.supplier, t.customer).select("id", F.lit("Central plant").alias("name"), (F.floor(F.col("lon") * 20) / 20).alias("lon"), (F.floor(F.col("lat") * 20) / 20).alias("lat"), "system", "source", "age_min", (F.col("source") == "customer").alias("local"), F.col("id").alias("ord"))
    return spatial.merge_stations(rows).select("id")


@query("J09_time_bracket", f"""
WITH {HOURLY_SQL}, tl AS (SELECT station AS s, hour * 60 AS m FROM hourly WHERE hour % 2 = 0), q AS (SELECT event_id, user_id::INT AS station, date_diff('minute', TIMESTAMP '1970-01-01', ts)::INT AS minute FROM events),
b AS (SELECT event_id, minute, (SELECT max(m) FROM tl WHERE s = station AND m <= minute) AS lo, (SELECT min(m) FROM tl WHERE s = station AND m >= minute) AS hi FROM q),
c AS (SELECT event_id, minute, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM b WHERE coalesce(lo, hi) IS NOT NULL),
d AS (SELECT event_id, minute, CASE WHEN hi - lo > 150 THEN CASE WHEN minute - lo > hi - minute THEN hi ELSE lo END ELSE lo END AS before, CASE WHEN hi - lo > 150 THEN CASE WHEN minute - lo > hi - minute THEN hi ELSE lo END ELSE hi END AS after FROM c)
SELECT event_id, before, after, round(CASE WHEN after > before THEN (minute - before) / (after - before) ELSE 0 END, 6) AS t, CASE WHEN minute - before <= after - minute THEN before ELSE after END AS nearest FROM d""")
def time_bracket(t):
    """Frames around each reading with the blend between them; wide gaps snap to the nearer frame."""
    line = hourly(t.events).where("hour % 2 = 0").select("station", (F.col("hour") * 60).alias("at"))
    got = temporal.bracket(readings(t.events).select("event_id", "station", "minute"), line, "station", "minute", "at", 150)
    return got.select("event_id", "before", "after", F.round("t", 6).alias("t"), temporal.nearest_instant(got, "minute").alias("nearest"))


@query("W09_resident_frames", """
WITH e AS (SELECT event_id, (event_id % 7)::INT AS f, event_id % 3 = 0 AS mix FROM events), g AS (SELECT *, CASE WHEN mix AND f < 6 THEN f + 1 ELSE f END AS n FROM e),
w AS (SELECT event_id, CASE WHEN f = 6 AND n = 6 THEN [6, 0, 1] ELSE [f, CASE WHEN mix THEN n ELSE f + 1 END, CASE WHEN mix THEN n ELSE f + 1 END + 1, f - 1] END AS wanted FROM g)
SELECT event_id, array_to_string(list_filter(wanted, lambda x, i: x >= 0 AND x < 7 AND NOT list_contains(wanted[1:i - 1], x))[1:3], ',') AS frames FROM w""")
def resident(t):
    f, mix = (F.col("event_id") % 7).cast("int"), F.col("event_id") % 3 == 0
    after = F.when(mix & (f < 6), f + 1).otherwise(f)
    return t.events.select("event_id", F.array_join(temporal.resident(f, after, mix, F.lit(7)), ",").alias("frames"))


@query("J02_full_outer_hours", f"""
WITH r AS (SELECT {HOUR_SQL} AS hour, event_type, value FROM events), a AS (SELECT hour, max(value) AS first FROM r WHERE event_type = 'click' GROUP BY hour), b AS (SELECT hour, max(value) AS second FROM r WHERE event_type <> 'click' GROUP BY hour),
s AS (SELECT unnest(generate_series(min(hour), max(hour)))::INT AS hour FROM r)
SELECT hour, first, second FROM s LEFT JOIN a USING (hour) LEFT JOIN b USING (hour) WHERE first IS NOT NULL OR second IS NOT NULL""")
def full_outer(t):
    h = readings(t.events)
    spine = h.agg(F.explode(F.sequence(F.min("hour"), F.max("hour"))).alias("hour"))
    side = lambda which, name: h.where(which).groupBy("hour").agg(F.max("value").alias(name))
    return temporal.paired(spine, side("kind = 'click'", "first"), side("kind <> 'click'", "second"), "hour")


@query("J04_stitched_runs", f"""
WITH r AS (SELECT {HOUR_SQL} AS hour, event_type, value FROM events), a AS (SELECT hour, max(value) AS value FROM r WHERE event_type = 'click' AND hour < (SELECT max(hour) - 100 FROM r) GROUP BY hour), b AS (SELECT hour, max(value) AS value FROM r WHERE event_type <> 'click' GROUP BY hour)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE hour > (SELECT max(hour) FROM a)""")
def stitched(t):
    h = readings(t.events)
    top = h.agg((F.max("hour") - 100).alias("cut"))  # one row
    first = h.where("kind = 'click'").crossJoin(F.broadcast(top)).where("hour < cut").groupBy("hour").agg(F.max("value").alias("value"))
    return temporal.stitched(first, h.where("kind <> 'click'").groupBy("hour").agg(F.max("value").alias("value")), "hour")


@query("P16_visible_run", f"""
WITH {HOURLY_SQL}, c AS (SELECT max(hour) - 60 AS clock FROM hourly), s AS (SELECT station, coalesce(max(CASE WHEN hour <= clock THEN hour END), min(hour)) AS start FROM hourly, c GROUP BY station)
SELECT h.station, h.hour, h.value FROM hourly h JOIN s USING (station) WHERE h.hour BETWEEN start AND start + 36""")
def visible(t):
    h = hourly(t.events)
    clock = h.agg((F.max("hour") - 60).alias("clock"))  # one row
    return temporal.visible(h.crossJoin(F.broadcast(clock)), "station", "hour", F.col("clock"), 36).select("station", "hour", "value")


@query("J01_coalesced_coordinates", f"""
SELECT o_orderkey, coalesce(nullif(CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END, 0.0), o_totalprice) AS lon FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey""")
def coalesced(t):
    dim = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("x"))
    return t.orders.join(dim, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.nullif("x", F.lit(0.0)), "o_totalprice").alias("lon"))


@query("J15_semi_join", "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) o USING (c_custkey)")
def semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("J16_anti_join", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 400000) o USING (c_custkey)")
def anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("J14_recent_lookup", """
WITH r AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[1:8] AS ids FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY 1),
p AS (SELECT unnest(ids) AS o_orderkey, generate_subscripts(ids, 1) AS pos FROM r)
SELECT o_orderkey, o_totalprice FROM p JOIN orders USING (o_orderkey) ORDER BY pos LIMIT 5""")
def recents(t):
    low = t.orders.agg(F.min("o_custkey").alias("o_custkey"))
    mine = t.orders.join(F.broadcast(low), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("o_orderdate")).alias("d"), "o_orderkey"))).alias("x"))
    ids = mine.select(F.slice(F.col("x.o_orderkey"), 1, 8).alias("ids"))
    return ranking.recent(ids, t.orders, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("J21_zone_cascade", """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'America/Tijuana' WHEN c_nationkey < 8 THEN CASE c_nationkey WHEN 0 THEN 'America/Hermosillo' WHEN 1 THEN 'America/Chihuahua' WHEN 2 THEN 'America/Mazatlan' ELSE NULL END END AS listed,
  coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'America/Tijuana' WHEN c_nationkey < 8 THEN CASE c_nationkey WHEN 0 THEN 'America/Hermosillo' WHEN 1 THEN 'America/Chihuahua' WHEN 2 THEN 'America/Mazatlan' END END, CASE WHEN c_acctbal < 0 THEN 'America/Cancun' END, 'America/Mexico_City') AS zone FROM customer""")
def zones(t):
    """Municipality, then state, then place, then a default."""
    states = t.spark.createDataFrame([(0, "America/Hermosillo"), (1, "America/Chihuahua"), (2, "America/Mazatlan")], "c_nationkey int, state_zone string")
    border = F.when(F.col("c_custkey") % 11 == 0, "America/Tijuana")
    rows = t.customer.join(F.broadcast(states), "c_nationkey", "left")
    listed = F.coalesce(border, "state_zone")
    return rows.select("c_custkey", listed.alias("listed"), F.coalesce(listed, F.when(F.col("c_acctbal") < 0, "America/Cancun"), F.lit("America/Mexico_City")).alias("zone"))


@query("W01_top5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top5(t):
    return ranking.top(t.orders, 5, "o_totalprice", F.asc("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("W04_search_cities", f"""
WITH {CITIES_SQL}, k AS (SELECT *, lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) AS key, lower(name || ' ' || regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g') || ' ' || region || ' usa united states america') AS raw FROM cities),
x AS (SELECT *, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS txt FROM k)
SELECT city_id, CASE WHEN key = 'customer 0000001' THEN 0 WHEN starts_with(key, 'customer 0000001') OR starts_with(replace(key, ' ', ''), 'customer0000001') THEN 1 WHEN contains(' ' || txt, ' customer') AND contains(' ' || txt, ' 0000001') THEN 2 ELSE 3 END AS match
FROM x WHERE (contains(txt, 'customer') AND contains(txt, '0000001')) OR starts_with(replace(key, ' ', ''), 'customer0000001') ORDER BY match, priority, name, region LIMIT 8""")
def search(t):
    rows = cities(t.customer, t.nation).withColumn("search_name", F.col("name")).withColumn("country", F.lit("USA"))
    return ranking.search_cities(rows, "Customer#0000001").select("city_id", "match")


@query("W05_numbered", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer")
def numbered(t):
    return ranking.numbered(t.customer, "c_nationkey", F.desc("c_acctbal"), F.asc("c_custkey")).select("c_custkey", "rank")


@query("W06_bands", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 0 WHEN c_acctbal <= 4000 THEN 1 WHEN c_acctbal <= 8000 THEN 2 ELSE 3 END AS tier FROM customer")
def bands(t):
    return t.customer.select("c_custkey", ranking.band(F.col("c_acctbal"), [0, 4000, 8000]).alias("tier"))


@query("W12_keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 101")
def page(t):
    return ranking.page(t.orders, "o_orderkey", 500, 100).select("o_orderkey")


@query("W17_distinct_times", f"SELECT DISTINCT {HOUR_SQL} AS hour FROM events")
def distinct_times(t):
    return readings(t.events).select("hour").distinct()


@query("U01_union_all", "SELECT s_suppkey AS id, 's' AS src FROM supplier UNION ALL SELECT c_custkey, 'c' FROM customer")
def union_all(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("s").alias("src")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.lit("c").alias("src")))


@query("U03_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0")
def except_(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_suppkey % 7 = 0").select("s_nationkey"))


@query("U04_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("U05_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("U07_positions_equal", "SELECT (SELECT count(*) FROM (SELECT n_nationkey, n_regionkey FROM nation EXCEPT SELECT n_nationkey, r_regionkey FROM nation, region)) AS extra, (SELECT count(*) FROM (SELECT n_nationkey, r_regionkey FROM nation, region EXCEPT SELECT n_nationkey, n_regionkey FROM nation)) AS missing")
def positions(t):
    have = t.nation.select("n_nationkey", "n_regionkey")
    want = t.nation.select("n_nationkey").crossJoin(F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"))))  # 25 x 5 rows
    extra, missing = (a.subtract(b).agg(F.count(F.lit(1)).alias(n)) for a, b, n in ((have, want, "extra"), (want, have, "missing")))
    return extra.crossJoin(missing)


@query("P01_bounds", f"""
WITH {STATIONS_SQL} SELECT id, lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72 AS forecast, (CASE WHEN lon > 90 THEN lon - 360 ELSE lon END) BETWEEN -170 AND -45 AND lat BETWEEN 10 AND 84 AS display,
  (lon BETWEEN -180 AND -45 AND lat BETWEEN 10 AND 84) OR (lon BETWEEN 170 AND 180 AND lat BETWEEN 50 AND 84) AS monitor FROM stations""")
def bounds(t):
    lon, lat = F.col("lon"), F.col("lat")
    return stations(t.supplier, t.customer).select("id", geo.in_box(lon, lat).alias("forecast"), geo.in_display(lon, lat).alias("display"), geo.in_monitor_regions(lon, lat).alias("monitor"))


@query("R28_greedy_clusters")
def clusters(t):
    """Clusters of screens, of some 200 points each; order decides, so SQL cannot express it."""
    rows = t.customer.select((F.col("c_nationkey") + 25 * F.floor(F.col("c_custkey") / 5000)).cast("long").alias("screen"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 600).cast("double").alias("y"), F.col("c_custkey").alias("ord"))
    return spatial.greedy_clusters(rows, "screen", 40.0)

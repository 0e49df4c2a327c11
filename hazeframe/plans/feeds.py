"""Queries over provider feeds, assets, timelines, labels, lines and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import air, clock, geo
from hazeframe.operators import contract, ranking, raster, spatial
from hazeframe.operators.staging import scratch
from hazeframe.plans.contracts import VALID_SQL, monitors
from hazeframe.plans.domain import CELLS_SQL, HOUR_SQL, LAT_SQL, LON_SQL, at, cells, readings
from hazeframe.plans.rasters import INDEX_SQL, LUT_SQL
from hazeframe.plans.registry import query
from hazeframe.sources import files, payloads


@query("S35_loaded_monitors", f"WITH {VALID_SQL} SELECT c_custkey % 2 AS precedence, count(*) AS n FROM good WHERE valid GROUP BY 1")
def loaded_monitors(t):
    """Two assets that are there and one that is not: a partial failure."""
    root = scratch(t.spark)
    for n in (0, 1):
        monitors(t).where(F.col("c_custkey") % 2 == n).drop("c_custkey").write.json(f"{root}/{n}")
    rows, _ = files.monitor_assets(t.spark, [("airnow", f"{root}/0"), ("bcair", f"{root}/1"), ("sinaica", f"{root}/none")])
    return rows.groupBy(F.col("precedence").cast("long").alias("precedence")).agg(F.count(F.lit(1)).alias("n"))


@query("S36_loaded_incidents", "SELECT 'i' || (o_orderkey % 500) AS id, max_by(floor(o_totalprice), (o_orderkey % 2, o_orderkey))::DOUBLE AS hectares FROM orders GROUP BY 1")
def loaded_incidents(t):
    root = scratch(t.spark)
    k = F.col("o_orderkey")
    rows = t.orders.select(F.concat(F.lit("i"), k % 500).alias("id"), F.lit("fire").alias("name"), F.lit("US").alias("country"), F.lit(-120.0).alias("lon"), F.lit(45.0).alias("lat"), F.lit("active").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"), F.lit("https://x").alias("sourceUrl"), F.floor("o_totalprice").cast("double").alias("areaHectares"), k.alias("place"))
    for n in (0, 1):
        rows.where(F.col("place") % 2 == n).write.json(f"{root}/{n}")
    return files.incident_assets(t.spark, [f"{root}/0", f"{root}/1"]).select("id", F.col("areaHectares").alias("hectares"))


@query("S16_canadian_fires", "SELECT 'CA:' || k AS id, max(CASE WHEN k % 4 = 0 THEN -100.0 ELSE -110.0 END)::DOUBLE AS lon, min_by(hectares, o_orderkey) AS hectares FROM (SELECT o_orderkey % 700 AS k, o_orderkey, floor(o_totalprice)::DOUBLE AS hectares FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY k")
def canadian_fires(t):
    """One body of features; points and squares; one in nine prescribed."""
    k = F.col("o_orderkey") % 700
    polygon = F.lit("[[[-111.0,50.0],[-109.0,50.0],[-109.0,52.0],[-111.0,52.0]]]")
    feature = F.struct(F.struct(F.when(k % 4 == 0, "Point").otherwise("Polygon").alias("type"), F.when(k % 4 == 0, "[-100.0,55.0]").otherwise(polygon).alias("coordinates")).alias("geometry"), F.struct(k.cast("string").alias("agency_fire_id"), F.when(F.col("o_orderkey") % 9 == 0, 1).alias("fire_was_prescribed"), F.floor("o_totalprice").cast("double").alias("hectares"), F.lit("2024-01-01T00:00:00Z").alias("status_date")).alias("properties"))
    few = t.orders.groupBy(k.alias("g")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", feature.alias("f")))).alias("x"))  # a body for each id
    raw = few.select(F.to_json(F.struct(F.col("x.f").alias("features"))).alias("body"))
    return payloads.canadian_fires(raw, "body").select("id", "lon", "hectares")


@query("R23_feature_rings", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 3 = 1 THEN 2 ELSE 0 END AS rings, CASE WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 3 = 1 THEN 7 ELSE 0 END AS points FROM nation")
def feature_rings(t):
    k = F.col("n_nationkey") % 3
    kind = F.when(k == 0, "Polygon").when(k == 1, "MultiPolygon").otherwise("Point")
    body = F.when(k == 0, "[[[0,0],[1,0],[1,1],[null,2]]]").when(k == 1, "[[[[0,0],[1,0],[1,1]]],[[[0,0],[1,0],[1,1],[0,1]]]]").otherwise("[1,2]")
    rings = payloads.rings_of(kind, body)
    return t.nation.select("n_nationkey", F.size(rings).alias("rings"), F.size(F.flatten(rings)).alias("points"))


@query("S15_legacy_columns", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'old' END AS name, NULL::VARCHAR AS missing FROM customer")
def legacy_columns(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("new_name"), F.lit("old").alias("old_name"))
    return payloads.with_legacy(rows, {"name": ["new_name", "old_name"], "missing": ["never"]}).withColumn("missing", F.col("missing").cast("string"))


@query("A10_first_named", "SELECT c_nationkey, min_by(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, (c_custkey % 3 = 0, c_custkey)) AS name FROM customer GROUP BY c_nationkey")
def first_named(t):
    rows = t.customer.select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return payloads.first_named(rows, "c_nationkey", "name", "c_custkey")


@query("S10_station_metadata", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, -99.5::DOUBLE AS lon FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def station_metadata(t):
    k = F.col("s_suppkey")
    parameters = F.when(k % 3 == 0, '[{"id":"O3"}]').otherwise('[{"id":"O3"},{"id":"PM2.5"}]')
    meta = F.concat(F.when(k % 2 == 0, "[").otherwise(""), F.lit('{"lat":"19.4","long":"-99.5","edo":"CDMX","nombre":"'), "s_name", F.lit('"}'), F.when(k % 2 == 0, "]").otherwise(""))
    rows = t.supplier.select(F.when(k % 5 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id"), F.lit("").alias("fallback"), parameters.alias("parameters"), meta.alias("meta"))
    return payloads.station_metadata(rows).select("id", "name", "lon")


@query("S19_capabilities", "SELECT n_nationkey, 4 AS times, 1704067200 + 3600 * (n_nationkey % 3) AS run FROM nation")
def capabilities(t):
    run = F.concat(F.lit("2024-01-01T0"), F.col("n_nationkey") % 3, F.lit(":00:00Z"))
    xml = F.concat(F.lit("<WMS><Layer><Layer><Name>other</Name><Dimension name='time'>2020-01-01T00:00:00Z</Dimension></Layer><Layer><Name>SMOKE</Name><Dimension name='TIME'> 2024-01-01T00:00:00Z/2024-01-01T03:00:00Z/PT1H </Dimension><Extent name='reference_time'>2023-12-31T00:00:00Z,"), run, F.lit("</Extent></Layer></Layer></WMS>"))
    got = payloads.capabilities(t.nation.select("n_nationkey", xml.alias("body")), "n_nationkey", "body", "SMOKE")
    return got.select("n_nationkey", F.size("times").alias("times"), F.unix_timestamp("run").alias("run"))


@query("J03_paired_fields", f"""
WITH h AS (SELECT DISTINCT {HOUR_SQL} AS hour FROM events) SELECT hour, hour * 2 AS first, CASE WHEN hour % 2 = 0 THEN hour * 3 END AS second FROM h""")
def paired_fields(t):
    """The second field is needed only where its run says so; a needed one that is missing fails the read."""
    hours = readings(t.events).select("hour").distinct()
    second = hours.where("hour % 2 = 0").select("hour", (F.col("hour") * 3).alias("second"))
    both = hours.withColumn("first", F.col("hour") * 2).join(second, "hour", "left")
    lost = (F.col("hour") % 2 == 0) & F.col("second").isNull()
    return both.select("hour", "first", F.when(lost, F.raise_error(F.lit("a field disappeared")).cast("int")).otherwise(F.col("second")).alias("second"))


# timelines: the hours of each user's events, in minutes
TIMES_SQL = f"WITH tl AS (SELECT user_id, list_sort(list_distinct(list({HOUR_SQL} * 60))) AS t FROM events GROUP BY user_id), p AS (SELECT *, len(t) AS n, CASE WHEN len(t) < 2 THEN 0 ELSE t[-1] - t[1] END AS span, t[1] + (user_id * 37 % 9000)::INT AS spot FROM tl)"


def _timelines(t):
    rows = readings(t.events).groupBy("station").agg(F.array_sort(F.collect_set(F.col("hour") * 60)).alias("t"))
    return rows.withColumnRenamed("station", "user_id").withColumn("at", F.get("t", F.lit(0)) + (F.col("user_id") * 37 % 9000).cast("int"))


@query("D14_positions", TIMES_SQL + " SELECT user_id::INT AS user_id, span, least(span, greatest(0, spot - t[1])) AS position, list_contains(t, spot) AS available FROM p")
def positions(t):
    """Span (D15), position (D14) and live position (D17)."""
    live = clock.live_position(F.col("t"), F.col("at"))
    return _timelines(t).select("user_id", clock.timeline_span(F.col("t")).alias("span"), live["position"].alias("position"), live["available"].alias("available"))


@query("D18_steps", TIMES_SQL + """
SELECT user_id::INT AS user_id, coalesce(list_filter(t, lambda x: x > spot)[1], t[-1]) - t[1] AS forward, coalesce(list_filter(t, lambda x: x < spot)[-1], t[1]) - t[1] AS back FROM p""")
def steps(t):
    offset = F.col("at") - F.get("t", F.lit(0))
    return _timelines(t).select("user_id", clock.stepped_position(F.col("t"), offset, F.lit(1)).alias("forward"), clock.stepped_position(F.col("t"), offset, F.lit(-1)).alias("back"))


@query("D19_refreshed_positions", TIMES_SQL + """
SELECT user_id::INT AS user_id, CASE WHEN user_id % 3 = 0 THEN least(span, greatest(0, spot - t[1])) WHEN user_id % 5 = 0 THEN 90 ELSE least(span, greatest(0, t[1] - 60 + 90 - t[1])) END AS position FROM p""")
def refreshed(t):
    old = F.transform("t", lambda x: x - 60)
    return _timelines(t).select("user_id", clock.refreshed_position(old, F.col("t"), F.lit(90), F.col("at"), F.col("user_id") % 3 == 0, F.col("user_id") % 5 == 0).alias("position"))


@query("D12_observation_ages", "WITH e AS (SELECT event_id, event_id * 7 % 3000 - 20 AS x FROM events), m AS (SELECT event_id, greatest(0, x) AS m FROM e) SELECT event_id, CASE WHEN m < 60 THEN m || ' min old' ELSE (m // 60) || ' hr ' || (m % 60) || ' min old' END AS label FROM m")
def observation_ages(t):
    return t.events.select("event_id", clock.observation_age(F.col("event_id") * 7 % 3000 - 20).alias("label"))


@query("D10_state_labels", """
WITH e AS (SELECT event_id, ['ok', 'stale', 'error', 'unavailable'][event_id % 4 + 1] AS s, CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS m FROM events)
SELECT event_id, CASE WHEN s = 'unavailable' THEN 'Unavailable' WHEN s = 'error' THEN CASE WHEN m IS NOT NULL THEN 'Update failed' ELSE 'Error' END WHEN m IS NULL THEN CASE WHEN s = 'stale' THEN 'Stale' ELSE 'Current' END WHEN m < 60 THEN m || 'm old' ELSE (m // 60) || 'h old' END AS label FROM e""")
def state_labels(t):
    k, now = F.col("event_id"), F.lit("2024-03-01").cast("timestamp")
    status = F.element_at(F.array(*map(F.lit, contract.STATUSES)), (k % 4 + 1).cast("int"))
    seen = F.when(k % 3 != 0, F.timestamp_seconds(F.unix_timestamp(now) - (k % 500) * 60))
    return t.events.select("event_id", clock.state_label(status, seen, now).alias("label"))


@query("D08_cycle_files", "SELECT o_orderkey, strftime(o_orderdate, '/hrrr.%Y%m%d/conus/hrrr.t%H') || 'z.wrfsfcf' || lpad((o_orderkey % 49)::VARCHAR, 2, '0') || '.grib2' AS path FROM orders")
def cycle_files(t):
    return t.orders.select("o_orderkey", clock.cycle_file(F.col("o_orderdate"), F.col("o_orderkey") % 49).alias("path"))


@query("D09_newest_times", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN greatest(l_quantity, l_tax) ELSE l_tax END AS newest FROM lineitem")
def newest_times(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", clock.newest_time(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")), F.col("l_tax")).alias("newest"))


@query("W03_severity_order", """
WITH m AS (SELECT event_id AS id, user_id, trunc(value)::INT % 320 AS aqi, event_id % 9 AS seen FROM events), c AS (SELECT *, CASE WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 150 THEN 2 ELSE 3 END AS risk FROM m)
SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY risk DESC, least(1.0, aqi / 500.0) DESC, seen DESC, id)::INT AS rank FROM c""")
def severity_order(t):
    aqi = F.col("value").cast("int") % 320
    rows = t.events.select(F.col("event_id").alias("id"), "user_id", F.lit("us-epa-aqi").alias("system"), aqi.alias("value"), air.index_category(aqi).alias("category"), (F.col("event_id") % 9).alias("observed"))
    return ranking.numbered(rows, "user_id", *ranking.by_severity()).select("id", "rank")


def label_rows(t):
    k = F.col("c_custkey")
    return t.customer.select((k % 40).alias("screen"), k.alias("id"), (k * 7919 % 400).cast("double").alias("x"), (k * 104729 % 300).cast("double").alias("y"), F.lit(60.0).alias("w"), F.lit(16.0).alias("h"), F.array((k % 3).cast("int"), (k % 5).cast("int")).alias("priority"), (k % 4 == 0).alias("retained"), (k % 6 != 0).alias("counts"))


@query("W15_placed_labels")
def placed_labels(t):
    """Labels that fit on their screens; order decides, so SQL cannot express it."""
    return ranking.placed_labels(label_rows(t), "screen", 2.0, 12)


def source_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select((F.col("o_custkey") % 200).alias("client"), k.alias("ord"), F.concat(F.lit("a"), k % 400).alias("key"), F.concat(F.lit("s"), k % 3).alias("surface"), (k % 7).cast("int").alias("frame"), F.when(k % 5 == 0, F.concat(F.lit("g"), k % 2)).alias("grp"), (k % 4 != 0).alias("optional"), (k % 3).cast("int").alias("rank"), (1000 + k % 900).alias("bytes"))


@query("R32_bounded_sources")
def bounded_sources(t):
    """Frames a client keeps within a budget; admission is greedy, so SQL cannot express it."""
    return ranking.bounded_sources(source_rows(t), "client", 9000)


@query("R25_clipped_lines")
def clipped_lines(t):
    """Events of each user as a polyline, cut to the forecast box."""
    rows = t.events.select("user_id", "event_id", (F.col("event_id") * 7919 % 16000 / 100 - 170).alias("x"), (F.col("event_id") * 104729 % 8500 / 100).alias("y"))
    got = spatial.clipped_lines(rows, "user_id", "event_id")
    return got.select("user_id", "piece", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("R30_cluster_identity", """
WITH m AS (SELECT user_id, event_type AS cluster, event_id AS rank, 'm' || event_id AS id, event_id % 3 = 0 AS health FROM events),
c AS (SELECT user_id, cluster, min(rank) AS first, string_agg(id, ',' ORDER BY rank) AS ids, min(health) <> max(health) AS mixed FROM m GROUP BY ALL)
SELECT user_id, string_agg(ids, '|' ORDER BY first) AS identity, count_if(mixed)::BIGINT AS mixed FROM c GROUP BY user_id""")
def cluster_identity(t):
    """Membership of all clusters of a screen as one text, and how many are mixed (A22)."""
    rows = t.events.select("user_id", F.col("event_type").alias("cluster"), F.col("event_id").alias("rank"), F.concat(F.lit("m"), "event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("system"))
    return spatial.cluster_identity(rows, "user_id")


@query("R20_tile_bounds", "SELECT n_nationkey, round(-145 + x * 100 / 4092.0::DOUBLE, 6) AS west, round(-145 + (x + 1023) * 100 / 4092.0::DOUBLE, 6) AS east, round(72 - (y + 634) * 62 / 2536.0::DOUBLE, 6) AS south, round(72 - y * 62 / 2536.0::DOUBLE, 6) AS north FROM (SELECT n_nationkey, n_nationkey % 4 * 1023 AS x, n_nationkey // 4 % 4 * 634 AS y FROM nation)")
def tile_bounds(t):
    b = geo.tile_bounds(F.col("n_nationkey") % 4, F.floor(F.col("n_nationkey") / 4) % 4)
    return t.nation.select("n_nationkey", *[F.round(b[c], 6).alias(c) for c in ("west", "east", "south", "north")])


@query("M26_sphere_round_trip", f"SELECT c_custkey, round({LON_SQL.format(k='(c_custkey + 3)')}, 6)::DOUBLE AS lon, round({LAT_SQL.format(k='(c_custkey + 3)')}, 6)::DOUBLE AS lat FROM customer")
def sphere_round_trip(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    lon, lat = geo.from_sphere(geo.sphere(F.col("lon"), F.col("lat")))
    return rows.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("M29_pixel_places", f"""
WITH p AS (SELECT c_custkey, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer)
SELECT c_custkey, CASE WHEN lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72 THEN round((lon + 145) / 100 * 1023, 6)::DOUBLE END AS x, CASE WHEN lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72 THEN round((72 - lat) / 62 * 634, 6)::DOUBLE END AS y FROM p""")
def pixel_places(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    x, y = geo.pixel(F.col("lon"), F.col("lat"), 1024, 635)
    return rows.select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("M18_surface_blend", """
WITH e AS (SELECT event_id, event_id % 5 <> 0 AS a, event_id % 7 <> 0 AS b, value AS v, (event_id % 11) / 10.0::DOUBLE AS t FROM events)
SELECT event_id, round(CASE WHEN a AND b THEN v + v * t WHEN b THEN v * 2 WHEN a THEN v END, 6) AS value, round(CASE WHEN a AND b THEN 0.25 + 0.5 * t WHEN b THEN 0.75 WHEN a THEN 0.25 END, 6)::DOUBLE AS coverage
FROM (SELECT * REPLACE (least(1.0, greatest(0.0, t)) AS t) FROM e)""")
def surface_blend(t):
    k = F.col("event_id")
    sample = lambda v, on, share: F.struct(v.alias("value"), on.alias("covered"), F.lit(share).alias("coverage"))
    got = air.surface_blend(sample(F.col("value"), k % 5 != 0, 0.25), sample(F.col("value") * 2, k % 7 != 0, 0.75), (k % 11) / 10.0)
    return t.events.select("event_id", F.round(got["value"], 6).alias("value"), F.round(got["coverage"], 6).alias("coverage"))


@query("R08_quarter_tiles", f"WITH {CELLS_SQL}, s AS (SELECT cx, cy, unnest(list_filter([CASE WHEN cy < 20 THEN 0 END, CASE WHEN cy >= 19 THEN 1 END], lambda v: v IS NOT NULL)) AS tile_row FROM cells WHERE cx < 63 AND cy < 39), q AS (SELECT *, unnest(list_filter([CASE WHEN cx < 32 THEN 0 END, CASE WHEN cx >= 31 THEN 1 END], lambda v: v IS NOT NULL)) AS tile_column FROM s) SELECT cx AS x, cy AS y, tile_row, tile_column, cx - tile_column * 31 AS px, cy - tile_row * 19 AS py FROM q")
def quarter_tiles(t):
    rows = cells(t.lineitem).where("cx < 63 AND cy < 39").select(F.col("cx").alias("x"), F.col("cy").alias("y"))  # 2 * 32 - 1 by 2 * 20 - 1
    return raster.quarters(rows, 32, 20)


@query("R09_overview", f"WITH {CELLS_SQL} SELECT cx // 2 AS x, cy // 2 AS y, round(first, 6) AS first FROM cells WHERE cx % 2 = 0 AND cy % 2 = 0")
def overview(t):
    rows = cells(t.lineitem).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.round("first", 6).alias("first"))
    return raster.halved(rows)


@query("A21_valid_counts", "SELECT l_returnflag AS flag, count(*) AS n, count_if(l_linenumber % 3 <> 0)::BIGINT AS valid FROM lineitem GROUP BY 1")
def valid_counts(t):
    v = F.when(F.col("l_linenumber") % 6 == 3, float("nan")).when(F.col("l_linenumber") % 6 != 0, F.col("l_quantity"))
    return raster.valid_counts(t.lineitem.select(F.col("l_returnflag").alias("flag"), v.alias("v")), "flag", "v")


@query("R13_coloured", f"WITH {LUT_SQL}, i AS (SELECT l_orderkey, l_linenumber, {INDEX_SQL} AS idx FROM (SELECT *, l_extendedprice / 100 AS v FROM lineitem)) SELECT l_orderkey, l_linenumber, red, green, blue, alpha FROM i JOIN lut ON lut.index = i.idx")
def coloured(t):
    return raster.coloured(t.lineitem, F.col("l_extendedprice") / 100).select("l_orderkey", "l_linenumber", "red", "green", "blue", "alpha")


@query("R17_decoded_pixels", "SELECT p_partkey, CASE WHEN p_partkey % 241 > 1 AND p_partkey % 241 % 24 = 1 THEN p_partkey % 241 - 1 ELSE p_partkey % 241 END::INT AS index, (p_partkey % 4)::INT AS code, p_partkey % 4 <> 0 AS valid FROM part")
def decoded_pixels(t):
    """Palette colours, one channel off by one, and mask colours back to indices and codes."""
    table = raster.lookup_table(t.spark).drop("value")
    k = F.col("p_partkey")
    mask = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("red", "green", "blue", "alpha"), rgba, strict=True)]) for rgba in raster.MASK.values()]), (k % 4 + 1).cast("int"))
    rows = t.part.select("p_partkey", (k % 241).cast("int").alias("index"), *[mask[c].alias(f"mask_{c}") for c in ("red", "green", "blue", "alpha")]).join(F.broadcast(table), "index").drop("index")
    return raster.decoded(rows, "p_partkey")


@query("R04_reprojected", f"""
WITH {CELLS_SQL}, p AS (SELECT c_custkey, (-140 + ((c_custkey + 3) * 7919 % 9000) / 100.0 + 145) / 2.5::DOUBLE AS x, (72 - (15 + ((c_custkey + 3) * 104729 % 5500) / 100.0)) / 2.0::DOUBLE AS y FROM customer),
n AS (SELECT c_custkey, floor(x)::INT + dx AS cx, floor(y)::INT + dy AS cy, CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END * CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT c_custkey, round(sum(first * w) / sum(CASE WHEN first IS NOT NULL THEN w END), 5) AS sample FROM n LEFT JOIN cells USING (cx, cy) WHERE w > 0 GROUP BY c_custkey""")
def reprojected(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    got = raster.reprojected(rows, cells(t.lineitem).select("cx", "cy", F.col("first").alias("value")), "c_custkey", {"lon0": -145, "lat0": 72, "dx": 2.5, "dy": 2.0})
    return got.select("c_custkey", F.round("sample", 5).alias("sample"))

"""Queries over cells: sampling, blending, tiles, palettes, clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import air, geo
from hazeframe.operators import contract, raster, spatial
from hazeframe.plans.domain import CELLS_SQL, CITIES_SQL, LAT_SQL, LON_SQL, at, cells, cities
from hazeframe.plans.registry import query
from hazeframe.sources import demo

POINTS_SQL = CITIES_SQL + ", points AS (SELECT city_id, (lon + 145) / 100.0 * 63 AS x, (72 - lat) / 62.0 * 39 AS y FROM cities WHERE lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72)"
CORNER_SQL = POINTS_SQL + """, corners AS (
  SELECT city_id, (floor(x) + dx)::INT AS cx, (floor(y) + dy)::INT AS cy, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) AS w
  FROM points, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS d(dx, dy))"""


def _points(t):
    x, y = geo.pixel(F.col("lon"), F.col("lat"), 64, 40)
    return cities(t.customer, t.nation).select("city_id", x.alias("x"), y.alias("y")).where("x IS NOT NULL")


@query("R01_bilinear_valid", f"""
WITH {CELLS_SQL}, {CORNER_SQL}, j AS (SELECT city_id, w, first AS v FROM corners LEFT JOIN cells USING (cx, cy) WHERE w > 0)
SELECT city_id, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS sample FROM j GROUP BY city_id""")
def bilinear(t):
    """Sample of the first model at each city; missing neighbours are dropped and weights renormalised."""
    return raster.sampled(_points(t), cells(t.lineitem).withColumnRenamed("first", "value"), "city_id").select("city_id", F.round("sample", 6).alias("sample"))


@query("R02_bilinear_strict", f"""
WITH {CELLS_SQL}, {CORNER_SQL}, j AS (SELECT city_id, w, second AS v FROM corners LEFT JOIN cells USING (cx, cy) WHERE w > 0)
SELECT city_id, CASE WHEN count(v) = count(*) THEN round(sum(w * v) / sum(w), 6) END AS sample FROM j GROUP BY city_id""")
def strict(t):
    return raster.sampled(_points(t), cells(t.lineitem).withColumnRenamed("second", "value"), "city_id", strict=True).select("city_id", F.round("sample", 6).alias("sample"))


BLEND_SQL = f"""
WITH {CELLS_SQL}, w AS (SELECT *, (cx % 5) / 4.0 AS weight, (cx + cy) % 9 <> 0 AS covered FROM cells),
blend AS (SELECT cx, cy, CASE WHEN covered THEN CASE WHEN first IS NOT NULL AND second IS NOT NULL THEN first + weight * greatest(second - first, 0) WHEN first IS NOT NULL THEN first ELSE second END END AS merged,
  CASE WHEN NOT covered THEN 0 WHEN first IS NOT NULL AND second > first AND weight > 0 THEN 3 WHEN first IS NOT NULL THEN 1 WHEN second IS NOT NULL THEN 2 ELSE 0 END AS code FROM w)"""


def _blend(t):
    return raster.feathered(cells(t.lineitem), F.col("first"), F.col("second"), (F.col("cx") % 5) / 4.0, (F.col("cx") + F.col("cy")) % 9 != 0)


@query("R05_feathered_max", BLEND_SQL + " SELECT cx, cy, round(merged, 6) AS merged, code FROM blend")
def feathered(t):
    return _blend(t).select("cx", "cy", F.round("merged", 6).alias("merged"), "code")


@query("R18_sampled_source", BLEND_SQL + f""", {CORNER_SQL}, j AS (SELECT city_id, w, cx, cy, merged AS v, code FROM corners LEFT JOIN blend USING (cx, cy) WHERE w > 0)
SELECT city_id, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS sample, max_by(code, (w, -cy, -cx)) FILTER (WHERE v IS NOT NULL) AS source FROM j GROUP BY city_id""")
def sampled_source(t):
    surface = _blend(t).select("cx", "cy", F.col("merged").alias("value"), F.col("code").alias("source"))
    return raster.sampled(_points(t), surface, "city_id").select("city_id", F.round("sample", 6).alias("sample"), "source")


@query("R07_tiles", """
WITH p AS (SELECT o_orderkey, (o_orderkey * 1023 // 7 % 4093)::INT AS x, (o_orderkey * 634 % 2537)::INT AS y FROM orders),
s AS (SELECT *, unnest(generate_series(0, 3))::INT AS tx FROM p), q AS (SELECT *, unnest(generate_series(0, 3))::INT AS ty FROM s)
SELECT o_orderkey, ty * 4 + tx AS tile, x - tx * 1023 AS px, y - ty * 634 AS py FROM q WHERE x - tx * 1023 BETWEEN 0 AND 1023 AND y - ty * 634 BETWEEN 0 AND 634""")
def tiles(t):
    """Detail pixels to 4 x 4 tiles that share their border pixels."""
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", (F.floor(k * 1023 / 7) % 4093).cast("int").alias("x"), (k * 634 % 2537).cast("int").alias("y"))
    return raster.tiled(rows).select("o_orderkey", "tile", "px", "py")


@query("R10_seam_faults", """
SELECT (l_partkey % 64)::INT AS x, (l_suppkey * 3 % 40)::INT AS y, count(DISTINCT coalesce(l_linenumber::VARCHAR, 'null')) AS versions, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1""")
def seams(t):
    rows = t.lineitem.select((F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") * 3 % 40).cast("int").alias("y"), "l_linenumber")
    return raster.seam_faults(rows, "l_linenumber")


@query("J12_point_tile", f"""
WITH p AS (SELECT c_custkey, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer)
SELECT c_custkey, (greatest(0, least(3, floor((72 - lat) / 62.0 * 2536 / 634))) * 4 + greatest(0, least(3, floor((lon + 145) / 100.0 * 4092 / 1023))))::INT AS tile FROM p WHERE lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72""")
def point_tile(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    x, y = geo.pixel(F.col("lon"), F.col("lat"), 4093, 2537)
    return rows.select("c_custkey", geo.tile(x, y).alias("tile")).where("tile IS NOT NULL")


_RAMP = " ".join(
    f"WHEN v >= {lo[0]} AND v < {hi[0]} THEN {1 + n * raster.STEPS} + round_even(least(1.0, greatest(0.0, (v - {lo[0]}) / {float(hi[0] - lo[0])})) * {raster.STEPS - 1}, 0)"
    for n, (lo, hi) in enumerate(zip(raster.STOPS[1:-1], raster.STOPS[2:], strict=True))
)
INDEX_SQL = f"(CASE WHEN v >= 1000 THEN {1 + 10 * raster.STEPS} {_RAMP} ELSE 0 END)::INT"


@query("R12_palette_index", f"SELECT l_orderkey, l_linenumber, {INDEX_SQL} AS idx FROM (SELECT *, l_extendedprice / 100 AS v FROM lineitem)")
def palette_index(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", raster.palette_index(F.col("l_extendedprice") / 100).alias("idx"))


_STOPS = ", ".join(f"({n - 1}, {', '.join(map(str, raster.STOPS[n]))}, {', '.join(map(str, raster.STOPS[min(n + 1, 11)]))})" for n in range(1, 12))
LUT_SQL = f"""
stops(n, lo, r0, g0, b0, a0, hi, r1, g1, b1, a1) AS (VALUES {_STOPS}),
steps AS (SELECT *, unnest(generate_series(0, CASE WHEN n = 10 THEN 0 ELSE 23 END)) AS k FROM stops),
lut AS (SELECT (1 + n * 24 + k)::INT AS index, round_even(r0 + (r1 - r0) * (k / 23.0::DOUBLE), 0)::INT AS red, round_even(g0 + (g1 - g0) * (k / 23.0::DOUBLE), 0)::INT AS green, round_even(b0 + (b1 - b0) * (k / 23.0::DOUBLE), 0)::INT AS blue, round_even(a0 + (a1 - a0) * (k / 23.0::DOUBLE), 0)::INT AS alpha FROM steps
  UNION ALL SELECT 0, 0, 0, 0, 0)"""


@query("R14_palette_table", f"""
WITH {LUT_SQL}, c AS (SELECT {INDEX_SQL} AS index, count(*) AS cells FROM (SELECT l_extendedprice / 100 AS v FROM lineitem) GROUP BY 1)
SELECT lut.*, coalesce(cells, 0) AS cells FROM lut LEFT JOIN c USING (index)""")
def palette_table(t):
    """Every palette entry with the number of line items that it colours."""
    return raster.palette_use(t.lineitem, F.col("l_extendedprice") / 100)


@query("R15_nearest_colour", f"""
WITH {LUT_SQL}, c AS (SELECT p_partkey, (p_partkey * 37 % 256)::INT AS red, (p_partkey * 59 % 256)::INT AS green, (p_partkey * 83 % 256)::INT AS blue, 200 AS alpha FROM part),
d AS (SELECT p_partkey, index, abs(c.red - lut.red) + abs(c.green - lut.green) + abs(c.blue - lut.blue) + abs(c.alpha - lut.alpha) AS apart FROM c, lut)
SELECT p_partkey, min_by(index, (apart, index)) AS index, min(apart)::INT AS apart FROM d GROUP BY p_partkey""")
def nearest_colour(t):
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", *[(k * m % 256).cast("int").alias(c) for c, m in (("red", 37), ("green", 59), ("blue", 83))], F.lit(200).alias("alpha"))
    return raster.nearest_colour(rows, "p_partkey").select("p_partkey", "index", "apart")


@query("M17_blend", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS a, CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS b, (event_id % 11) / 10.0::DOUBLE AS t FROM events)
SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * least(1.0, greatest(0.0, t)) END, 6) AS v FROM e""")
def blend(t):
    a, b = F.when(F.col("event_id") % 5 != 0, F.col("value")), F.when(F.col("event_id") % 7 != 0, F.col("value") * 2)
    return t.events.select("event_id", F.round(air.blend(a, b, (F.col("event_id") % 11) / 10.0, a.isNotNull(), b.isNotNull()), 6).alias("v"))


N, FF, X0, Y0 = geo.lambert()
XY_SQL = f"""
p AS (SELECT c_custkey, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer),
r AS (SELECT *, {geo.RADIUS * FF!r} / pow(tan(pi() / 4 + radians(lat) / 2), {N!r}) AS rho, radians(lon - (-97.5)) * {N!r} AS theta FROM p),
xy AS (SELECT c_custkey, lon, lat, (rho * sin(theta) - ({X0!r})) / 3000.0 AS x, (-rho * cos(theta) - ({Y0!r})) / 3000.0 AS y FROM r)"""


@query("M13_lambert_forward", f"WITH {XY_SQL} SELECT c_custkey, round(x, 4) AS x, round(y, 4) AS y, x BETWEEN 0 AND 1798 AND y BETWEEN 0 AND 1058 AS inside FROM xy")
def forward(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    x, y = geo.to_grid(F.col("lon"), F.col("lat"))
    return rows.select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), geo.in_domain(x, y).alias("inside"))


@query("M14_lambert_round_trip", f"WITH {XY_SQL} SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM xy")
def round_trip(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    lon, lat = geo.from_grid(*geo.to_grid(F.col("lon"), F.col("lat")))
    return rows.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("M15_edge_weight", f"""
WITH {XY_SQL}, t AS (SELECT *, least(1.0, greatest(0.0, least(x, 1798 - x, y, 1058 - y) * 3 / 200)) AS t FROM xy)
SELECT c_custkey, round(CASE WHEN x BETWEEN 0 AND 1798 AND y BETWEEN 0 AND 1058 THEN t * t * (3 - 2 * t) ELSE 0 END, 6) AS w FROM t""")
def weight(t):
    rows = t.customer.select("c_custkey", *at("c_custkey", 3))
    return rows.select("c_custkey", F.round(geo.edge_weight(*geo.to_grid(F.col("lon"), F.col("lat"))), 6).alias("w"))


@query("R24_clipped_segments", """
WITH s AS (SELECT c_custkey, (-170 + c_custkey * 7 % 150)::DOUBLE AS x0, (c_custkey * 3 % 90)::DOUBLE AS y0, (-160 + c_custkey * 11 % 140)::DOUBLE AS x1, (c_custkey * 5 % 85)::DOUBLE AS y1 FROM customer),
d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
e AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (-145 - x0) / dx WHEN dx < 0 THEN (-45 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (10 - y0) / dy WHEN dy < 0 THEN (72 - y0) / dy ELSE 0 END) AS t0,
  least(1.0, CASE WHEN dx > 0 THEN (-45 - x0) / dx WHEN dx < 0 THEN (-145 - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (72 - y0) / dy WHEN dy < 0 THEN (10 - y0) / dy ELSE 1 END) AS t1 FROM d)
SELECT c_custkey, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM e WHERE t0 <= t1 AND (dx <> 0 OR x0 BETWEEN -145 AND -45) AND (dy <> 0 OR y0 BETWEEN 10 AND 72)""")
def segments(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", (-170 + k * 7 % 150).cast("double").alias("x0"), (k * 3 % 90).cast("double").alias("y0"), (-160 + k * 11 % 140).cast("double").alias("x1"), (k * 5 % 85).cast("double").alias("y1"))
    got = rows.select("c_custkey", spatial.clipped_segment(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("c")).where("c IS NOT NULL")
    return got.select("c_custkey", F.round("c.t0", 6).alias("t0"), F.round("c.t1", 6).alias("t1"))


@query("R21_clipped_rings")
def rings(t):
    """Triangles cut to the forecast box, as corner counts and areas."""
    k = F.col("c_custkey")
    corner = lambda dx, dy: F.struct((-150 + k * 7 % 110 + dx).cast("double").alias("x"), (k * 3 % 75 + dy).cast("double").alias("y"))
    rows = t.customer.select("c_custkey", F.array(corner(0, 0), corner(12, 0), corner(6, 9)).alias("ring"))
    got = spatial.clipped_ring(rows, "ring")
    n = F.size("clipped")
    shoelace = F.aggregate(F.transform("clipped", lambda p, i: p["x"] * F.element_at("clipped", F.when(i + 2 > n, 1).otherwise(i + 2))["y"] - F.element_at("clipped", F.when(i + 2 > n, 1).otherwise(i + 2))["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)
    return got.select("c_custkey", n.alias("corners"), F.round(F.abs(shoelace) / 2, 6).alias("area"))


_BUMPS = lambda model, x, y: f"{model[0]}::DOUBLE" + "".join(f" + {top} * exp(-(pow(({x} - {cx} - hour * {demo.STEP * drift!r}::DOUBLE) / {wide}::DOUBLE, 2) + pow(({y} - {cy}) / {high}::DOUBLE, 2)))" for top, cx, cy, drift, wide, high in model[1])


@query("S30_synthetic_plumes", f"""
WITH {XY_SQL}, h AS (SELECT c_custkey, (lon + 145) / 100.0::DOUBLE * 256 AS px, (72 - lat) / 62.0::DOUBLE * 158 AS py, lon BETWEEN -145 AND -45 AND lat BETWEEN 10 AND 72 AS ok, x / 3 AS u, y / 3 AS v, unnest(generate_series(0, 36))::INT AS hour FROM xy),
m AS (SELECT *, u BETWEEN 0 AND 599 AND v BETWEEN 0 AND 399 AS inside, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(u, 599 - u, v, 399 - v) * 9 / 200)) AS t FROM h),
f AS (SELECT *, CASE WHEN ok AND hour > 0 THEN {_BUMPS(demo.FIRST, 'px', 'py')} END AS a, CASE WHEN inside THEN {_BUMPS(demo.SECOND, 'u', 'v')} END AS b FROM m)
SELECT c_custkey, hour, floor(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + t * t * (3 - 2 * t) * greatest(b - a, 0) WHEN a IS NOT NULL THEN a ELSE b END * 1000 + 0.3217::DOUBLE)::BIGINT AS value_milli,
  (CASE WHEN a IS NOT NULL AND b > a AND t > 0 THEN 3 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END)::INT AS code FROM f""")
def plumes(t):
    """The synthetic plumes of both models, merged, at every customer's place for the 37 hours of a run."""
    places = t.customer.select("c_custkey", *at("c_custkey", 3), F.explode(F.sequence(F.lit(0), F.lit(contract.HORIZON))).alias("hour"))
    return demo.smoke(places).select("c_custkey", "hour", F.floor(F.col("merged") * 1000 + 0.3217).alias("value_milli"), "code")

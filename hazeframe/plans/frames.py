"""Composed forecast frames over several hours, from two fields of the line items under the coastal mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators import coast, frames, raster
from hazeframe.plans.registry import query
from hazeframe.plans.rasters import INDEX_SQL, N, FF, X0, Y0

LATTICE = coast.Lattice(129, 81)
TILING = frames.Tiling(LATTICE)
FIRST = frames.Geographic(-145.0, 72.0, 2.5, 2.0)
SECOND = frames.Lambert(60, 36, 90000.0)


def fields(t):
    """(hour, cx, cy, value) twice: mean prices by line number and cell, one with holes."""
    value = F.floor("l_extendedprice") / 100
    first = t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_linenumber").cast("int").alias("hour"), (F.col("l_partkey") % 41).cast("int").alias("cx"), (F.col("l_suppkey") * 3 % 32).cast("int").alias("cy")).agg(F.avg(value).alias("value"))
    second = t.lineitem.where("l_linenumber < 6").groupBy(F.col("l_linenumber").cast("int").alias("hour"), (F.col("l_partkey") % 60).cast("int").alias("cx"), (F.col("l_suppkey") * 5 % 36).cast("int").alias("cy")).agg((F.avg(value) * 1.5).alias("value"))
    return first, second


def covered(t):
    k = F.col("x") * 31 + F.col("y") * 17
    return LATTICE.cells(t.spark).where(k % 11 != 0)


_XY = f"""
px AS (SELECT x, y, {LATTICE.west!r}::DOUBLE + x * {LATTICE.lon_step!r}::DOUBLE AS lon, {LATTICE.north!r}::DOUBLE - y * {LATTICE.lat_step!r}::DOUBLE AS lat FROM generate_series(0, {LATTICE.width - 1}) a(x), generate_series(0, {LATTICE.height - 1}) b(y) WHERE (x * 31 + y * 17) % 11 <> 0),
r AS (SELECT *, {geo.RADIUS * FF!r}::DOUBLE / pow(tan(pi() / 4 + radians(lat) / 2), {N!r}::DOUBLE) AS rho, radians(lon + 97.5::DOUBLE) * {N!r}::DOUBLE AS theta FROM px),
p AS (SELECT x, y, (lon + 145) / 2.5::DOUBLE AS ax, (72 - lat) / 2.0::DOUBLE AS ay, (rho * sin(theta) - ({X0!r}::DOUBLE)) / 3000.0::DOUBLE / 30 AS bx, (-rho * cos(theta) - ({Y0!r}::DOUBLE)) / 3000.0::DOUBLE / 30 AS by_ FROM r),
w AS (SELECT *, bx BETWEEN 0 AND 59 AND by_ BETWEEN 0 AND 35 AS inside, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(bx, 59 - bx, by_, 35 - by_) * 90 / 200)) AS t FROM p),
f1 AS (SELECT l_linenumber AS hour, l_partkey % 41 AS cx, l_suppkey * 3 % 32 AS cy, avg(floor(l_extendedprice) / 100) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
f2 AS (SELECT l_linenumber AS hour, l_partkey % 60 AS cx, l_suppkey * 5 % 36 AS cy, avg(floor(l_extendedprice) / 100) * 1.5::DOUBLE AS v FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
h AS (SELECT DISTINCT l_linenumber AS hour FROM lineitem), k AS (SELECT dx, dy FROM (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
c1 AS (SELECT w.x, w.y, floor(ax) + dx AS cx, floor(ay) + dy AS cy, abs(1 - dx - (ax - floor(ax))) * abs(1 - dy - (ay - floor(ay))) AS g FROM w, k),
c2 AS (SELECT w.x, w.y, floor(bx) + dx AS cx, floor(by_) + dy AS cy, abs(1 - dx - (bx - floor(bx))) * abs(1 - dy - (by_ - floor(by_))) AS g FROM w, k WHERE inside),
s1 AS (SELECT hour, x, y, sum(g * v) / sum(g) AS a FROM c1 JOIN f1 USING (cx, cy) WHERE g > 0 GROUP BY ALL),
s2 AS (SELECT hour, x, y, sum(g * v) / sum(g) AS b FROM c2 JOIN f2 USING (cx, cy) WHERE g > 0 GROUP BY ALL),
m AS (SELECT h.hour, w.x, w.y, s1.a, s2.b, CASE WHEN inside THEN t * t * (3 - 2 * t) ELSE 0 END AS weight FROM w CROSS JOIN h LEFT JOIN s1 ON s1.hour = h.hour AND s1.x = w.x AND s1.y = w.y LEFT JOIN s2 ON s2.hour = h.hour AND s2.x = w.x AND s2.y = w.y),
merged AS (SELECT hour, x, y, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + weight * greatest(b - a, 0) WHEN a IS NOT NULL THEN a ELSE b END AS value,
  (CASE WHEN a IS NOT NULL AND b > a AND weight > 0 THEN 3 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END)::INT AS code FROM m)"""


@query("R06_frame_tiles", f"""
WITH {_XY}, tx AS (SELECT *, unnest(generate_series(0, 3)) AS c FROM merged), ty AS (SELECT *, unnest(generate_series(0, 3)) AS r FROM tx)
SELECT hour::INT AS hour, (r * 4 + c)::INT AS tile, (x - c * 32)::INT AS px, (y - r * 20)::INT AS py, floor(value * 1000 + 0.3217::DOUBLE)::BIGINT AS value_milli, code FROM ty WHERE x - c * 32 BETWEEN 0 AND 32 AND y - r * 20 BETWEEN 0 AND 20""")
def frame_tiles(t):
    """All tiles of all hours, after the seam and completeness gates; both fields reprojected, one from the Lambert grid."""
    first, second = fields(t)
    hours = t.lineitem.select(F.col("l_linenumber").cast("int").alias("hour")).distinct()
    made = frames.compose(first, second, hours, covered(t), TILING, FIRST, SECOND)
    return frames.checked(made, hours, covered(t), TILING).select("hour", "tile", "px", "py", F.floor(F.col("value") * 1000 + 0.3217).alias("value_milli"), "code")


@query("R06_base_raster", f"""
WITH {_XY}, b AS (SELECT hour, x // 4 AS bx, y // 4 AS by_, round(value, 4) AS v, code FROM merged WHERE x % 4 = 0 AND y % 4 = 0)
SELECT hour::INT AS hour, bx::INT AS x, by_::INT AS y, {INDEX_SQL} AS idx, code FROM b""")
def base_raster(t):
    """Every fourth pixel of the composed frames as palette indices."""
    first, second = fields(t)
    hours = t.lineitem.select(F.col("l_linenumber").cast("int").alias("hour")).distinct()
    small = frames.base(frames.compose(first, second, hours, covered(t), TILING, FIRST, SECOND))
    return small.select("hour", "x", "y", raster.palette_index(F.round("value", 4)).alias("idx"), "code")


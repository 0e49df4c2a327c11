"""Queries over the sea: filled polygons with holes, and the coastal mask of ways over water."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.operators import coast
from hazeframe.plans.domain import LAT_SQL, LON_SQL, at
from hazeframe.plans.registry import query

LATTICE = coast.Lattice(128, 80)
WIDE = LATTICE.widened(*LATTICE.halo(200.0))
# outline of each polygon around its centre, and of the island that every second one has: (lon, lat) offsets
OUTER, HOLE = ((-4.0, -3.0), (4.0, -3.5), (5.0, 3.0), (-3.0, 4.0)), ((-1.5, -1.0), (1.5, -1.25), (0.25, 1.5))


def _sql_ring(points, ring: int, where: str) -> str:
    ends = [(*p, *points[(i + 1) % len(points)]) for i, p in enumerate(points)]
    rows = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in ends)
    return f"SELECT ord, {ring} AS ring, lon + a AS lon0, lat + b AS lat0, lon + c AS lon1, lat + d AS lat1 FROM p, (VALUES {rows}) AS v(a, b, c, d) WHERE {where}"


def sea_sql(lattice: coast.Lattice) -> str:
    """Parity of the crossings left of every lattice point, ring by ring; the ring painted last decides."""
    return f"""
p AS (SELECT c_custkey AS ord, {LON_SQL.format(k='(c_custkey + 3)')} AS lon, {LAT_SQL.format(k='(c_custkey + 3)')} AS lat FROM customer),
r AS ({_sql_ring(OUTER, 0, 'TRUE')} UNION ALL {_sql_ring(HOLE, 1, 'ord % 2 = 0')}),
e AS (SELECT ord, ring, (lon0 - ({lattice.west!r})) / {lattice.lon_step!r} AS x0, ({lattice.north!r} - lat0) / {lattice.lat_step!r} AS y0, (lon1 - ({lattice.west!r})) / {lattice.lon_step!r} AS x1, ({lattice.north!r} - lat1) / {lattice.lat_step!r} AS y1 FROM r),
c AS (SELECT ord, ring, y, x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) AS met FROM e, generate_series(0, {lattice.height - 1}) g(y) WHERE least(y0, y1) <= y AND y < greatest(y0, y1)),
i AS (SELECT ord, ring, x, y FROM c, generate_series(0, {lattice.width - 1}) g(x) WHERE met <= x GROUP BY ALL HAVING count(*) % 2 = 1),
sea AS (SELECT x::INT AS x, y::INT AS y FROM i GROUP BY x, y HAVING max_by(ring, (ord, ring)) = 0)"""


def polygons(t):
    ring = lambda points: F.array(*[F.struct((F.col("lon") + a).alias("lon"), (F.col("lat") + b).alias("lat")) for a, b in points])
    rows = t.customer.select(F.col("c_custkey").alias("ord"), *at("c_custkey", 3))
    return rows.select("ord", F.when(F.col("ord") % 2 == 0, F.array(ring(OUTER), ring(HOLE))).otherwise(F.array(ring(OUTER))).alias("rings"))


@query("R26_ocean_fill", f"WITH {sea_sql(WIDE)} SELECT x, y FROM sea")
def ocean_fill(t):
    """Sea points of a lattice with its halo, from polygons with islands."""
    return coast.sea(polygons(t), WIDE)


_HALO = LATTICE.halo(200.0)


@query("R27_coastal_coverage", f"""
WITH RECURSIVE {sea_sql(WIDE)},
d AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0),
n AS (SELECT x, y, x + dx AS nx, y + dy AS ny, dx, dy FROM sea, d WHERE x + dx BETWEEN 0 AND {WIDE.width - 1} AND y + dy BETWEEN 0 AND {WIDE.height - 1}),
seeds AS (SELECT DISTINCT n.x, n.y FROM n LEFT JOIN sea s ON s.x = nx AND s.y = ny WHERE s.x IS NULL),
steps AS (SELECT n.x, n.y, nx, ny, sqrt(CASE WHEN dy = 0 THEN 0 ELSE pow(6371.0088 * radians({WIDE.lat_step!r}::DOUBLE), 2) END + CASE WHEN dx = 0 THEN 0 ELSE pow(6371.0088 * radians({WIDE.lon_step!r}::DOUBLE) * cos(radians({WIDE.north!r}::DOUBLE - (n.y + ny) * 0.5::DOUBLE * {WIDE.lat_step!r}::DOUBLE)), 2) END) AS km FROM n JOIN sea s ON s.x = nx AND s.y = ny),
ways(x, y, km) USING KEY (x, y) AS (
  SELECT x, y, 0.0::DOUBLE FROM seeds
  UNION
  SELECT s.nx, s.ny, min(w.km + s.km) FROM ways w JOIN steps s ON s.x = w.x AND s.y = w.y LEFT JOIN recurring.ways o ON o.x = s.nx AND o.y = s.ny
  WHERE w.km + s.km <= 200 AND (o.km IS NULL OR w.km + s.km < o.km) GROUP BY s.nx, s.ny),
far AS (SELECT sea.x - {_HALO[0]} AS x, sea.y - {_HALO[1]} AS y FROM sea LEFT JOIN ways USING (x, y) WHERE ways.km IS NULL),
grid AS (SELECT x::INT AS x, y::INT AS y FROM generate_series(0, {LATTICE.width - 1}) a(x), generate_series(0, {LATTICE.height - 1}) b(y))
SELECT grid.x, grid.y, far.x IS NULL AS covered FROM grid LEFT JOIN far ON far.x = grid.x AND far.y = grid.y""")
def coastal_coverage(t):
    """Land and the water within 200 km of it, by ways over water."""
    return coast.coverage(polygons(t), LATTICE)

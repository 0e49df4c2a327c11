"""Sea and coast on a lattice: polygons filled by scanlines, and distances over water by frontier relaxation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators.staging import remove, written

EARTH_KM = 6371.0088  # fixed value


@dataclass(frozen=True)
class Lattice:
    """Evenly spaced points over a box, row 0 in the north, the outer ones on its edges."""

    width: int
    height: int
    west: float = geo.FORECAST_BOX[0]
    east: float = geo.FORECAST_BOX[1]
    south: float = geo.FORECAST_BOX[2]
    north: float = geo.FORECAST_BOX[3]

    @property
    def lon_step(self) -> float:
        return (self.east - self.west) / (self.width - 1)

    @property
    def lat_step(self) -> float:
        return (self.north - self.south) / (self.height - 1)

    def halo(self, km: float) -> tuple[int, int]:
        """Columns and rows to add on each side, so that nothing within km of the box is out of sight."""
        across = EARTH_KM * math.radians(self.lon_step) * math.cos(math.radians(self.north))
        return math.ceil(km / across) + 2, math.ceil(km / (EARTH_KM * math.radians(self.lat_step))) + 2

    def widened(self, columns: int, rows: int) -> Lattice:
        dx, dy = columns * self.lon_step, rows * self.lat_step
        return Lattice(self.width + 2 * columns, self.height + 2 * rows, self.west - dx, self.east + dx, self.south - dy, self.north + dy)

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Fractional column and row."""
        return (lon - self.west) / self.lon_step, (F.lit(self.north) - lat) / self.lat_step

    def cells(self, spark: SparkSession) -> DataFrame:
        n = spark.range(self.width * self.height)
        return n.select((F.col("id") % self.width).cast("int").alias("x"), F.floor(F.col("id") / self.width).cast("int").alias("y"))


def ring_edges(polygons: DataFrame, lattice: Lattice) -> DataFrame:
    """ord, ring, x0, y0, x1, y1 in lattice places, of polygons (ord, rings: arrays of (lon, lat) structs); the last
    point of a ring is joined to the first."""
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rings = polygons.repartition(parts, "ord").select("ord", F.posexplode("rings").alias("ring", "points"))  # so their crossings need no shuffle
    n = F.size("points")
    pair = lambda p, i: F.struct(p.alias("a"), F.get("points", F.when(i + 1 == n, 0).otherwise(i + 1)).alias("b"))
    rows = rings.select("ord", "ring", F.explode(F.transform("points", pair)).alias("e"))
    (x0, y0), (x1, y1) = (lattice.place(F.col(f"e.{k}.lon"), F.col(f"e.{k}.lat")) for k in "ab")
    return rows.select("ord", "ring", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def ring_spans(edges: DataFrame, lattice: Lattice) -> DataFrame:
    """ord, ring, y, first, last: stretches of lattice points inside each ring, by the parity of crossings along a row.

    An edge costs a row for each lattice row it crosses and a stretch one row, so the work goes with the outline and not
    with the box around it. An edge holds its upper end and not its lower one; a point on the left outline is inside.
    """
    low, high = F.ceil(F.least("y0", "y1")), F.ceil(F.greatest("y0", "y1")) - 1
    top, bottom = F.greatest(low, F.lit(0)), F.least(high, F.lit(lattice.height - 1))
    crossed = edges.where(top <= bottom).select("ord", "ring", "x0", "y0", "x1", "y1", F.explode(F.sequence(top, bottom)).alias("y"))
    crossed = crossed.select("ord", "ring", F.col("y").cast("int").alias("y"), (F.col("x0") + (F.col("y") - F.col("y0")) * ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))).alias("x"))
    along = Window.partitionBy("ord", "ring", "y").orderBy("x")
    paired = crossed.select("ord", "ring", "y", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("n")).where("n % 2 = 1")
    first, last = F.greatest(F.ceil("x"), F.lit(0)), F.least(F.ceil("to") - 1, F.lit(lattice.width - 1))
    return paired.select("ord", "ring", "y", first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")


def sea(polygons: DataFrame, lattice: Lattice) -> DataFrame:
    """x, y of lattice points in the sea: polygons are painted by ord, a polygon's first ring as sea and its other rings
    as land, so what was painted last over a point holds."""
    spans = ring_spans(ring_edges(polygons, lattice), lattice)
    points = spans.select("ord", "ring", "y", F.explode(F.sequence("first", "last")).alias("x"))
    # two plain maxima, which are hashed inside tasks; the maximum of a struct would sort all points of a task
    painted = points.groupBy("x", "y").agg(*[F.max(F.when(on, F.col("ord"))).alias(n) for n, on in (("_sea", F.col("ring") == 0), ("_land", F.col("ring") > 0))])
    return painted.where("_sea IS NOT NULL AND (_land IS NULL OR _sea > _land)").select("x", "y")


def around(cells: DataFrame, *more: str) -> DataFrame:
    """Each cell's eight neighbours as nx, ny."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    rows = cells.withColumn("_n", F.explode(steps))
    return rows.select("x", "y", *more, (F.col("x") + F.col("_n.i")).alias("nx"), (F.col("y") + F.col("_n.j")).alias("ny"))


def coast(water: DataFrame, lattice: Lattice) -> DataFrame:
    """x, y of sea points with a land point next to them; what lies beyond the lattice is no land."""
    near = around(water).where(F.col("nx").between(0, lattice.width - 1) & F.col("ny").between(0, lattice.height - 1))
    own = water.select(F.col("x").alias("nx"), F.col("y").alias("ny"))
    return near.join(own, ["nx", "ny"], "left_anti").select("x", "y").distinct()


def from_coast(water: DataFrame, lattice: Lattice, km: float = 200.0) -> DataFrame:
    """x, y, km: shortest ways over water, in eight directions, from the coast to sea points at most km away.

    A multi-source shortest path as relaxation: each round extends only the points that the round before improved, so
    that all rounds together cost about the points times the few times each is improved. Round r knows every way of r
    steps, hence there are as many rounds as the longest shortest way has steps; only whether any point improved reaches
    the driver. Tables are staged and those of the round before deleted.
    """
    spark = water.sparkSession
    water, water_at = written(water.select(F.col("x").alias("nx"), F.col("y").alias("ny")))
    best, best_at = written(coast(water.toDF("x", "y"), lattice).withColumn("km", F.lit(0.0)))
    front, front_at = best, None
    down = EARTH_KM * math.radians(lattice.lat_step)
    across = F.lit(EARTH_KM * math.radians(lattice.lon_step)) * F.cos(F.radians(F.lit(lattice.north) - (F.col("y") + F.col("ny")) * 0.5 * lattice.lat_step))
    step = F.hypot(F.when(F.col("y") == F.col("ny"), 0.0).otherwise(down), F.when(F.col("x") == F.col("nx"), 0.0).otherwise(across))
    while True:
        reached = around(front, "km").withColumn("way", F.col("km") + step).where(F.col("way") <= km)
        reached = reached.groupBy("nx", "ny").agg(F.min("way").alias("way")).join(water, ["nx", "ny"], "left_semi").select(F.col("nx").alias("x"), F.col("ny").alias("y"), "way")
        known = best.select("x", "y", F.col("km").alias("known"))
        better, better_at = written(reached.join(known, ["x", "y"], "left").where("known IS NULL OR way < known").select("x", "y", F.col("way").alias("km")))
        if not better.limit(1).count():
            remove(spark, better_at, water_at, *([front_at] if front_at else []))
            return best
        rest = best.join(better.select("x", "y"), ["x", "y"], "left_anti")
        new, new_at = written(rest.select("x", "y", "km").unionByName(better))
        remove(spark, best_at, *([front_at] if front_at else []))
        best, best_at, front, front_at = new, new_at, better, better_at


def coverage(polygons: DataFrame, lattice: Lattice, km: float = 200.0) -> DataFrame:
    """x, y, covered for every point of the lattice: land, and water within km of the coast over water.

    Sea and ways are worked out on a lattice with a halo of km around and cut to the one asked for. A mask that covers
    nothing or everything is taken for a fault.
    """
    columns, rows = lattice.halo(km)
    wide = lattice.widened(columns, rows)
    water = sea(polygons, wide)
    water, water_at = written(water)
    far = water.join(from_coast(water, wide, km).select("x", "y"), ["x", "y"], "left_anti")
    inner = far.select((F.col("x") - columns).alias("x"), (F.col("y") - rows).alias("y"), F.lit(False).alias("_near"))
    out, _ = written(lattice.cells(polygons.sparkSession).join(inner, ["x", "y"], "left").select("x", "y", F.coalesce("_near", F.lit(True)).alias("covered")))
    remove(polygons.sparkSession, water_at)
    if out.select("covered").distinct().count() != 2:
        raise ValueError("a coastal mask must cover some points and not all")
    return out

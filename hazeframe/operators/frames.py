"""Forecast frames: two native fields sampled at the covered pixels of a tiled detail raster, merged, checked, written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators import raster
from hazeframe.operators.coast import Lattice
from hazeframe.operators.staging import staged

BASE = 4  # the base raster holds every fourth pixel of the detail raster


@dataclass(frozen=True)
class Geographic:
    """A grid of even degrees whose first row is the northern one."""

    lon0: float
    lat0: float
    dx: float
    dy: float

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return geo.grid_place(lon, lat, *map(F.lit, (self.lon0, self.lat0, self.dx, self.dy)))


@dataclass(frozen=True)
class Lambert:
    """The conformal grid, of nx by ny points `metres` apart from the same first point."""

    nx: int = geo.NX
    ny: int = geo.NY
    metres: float = geo.DX

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        x, y = geo.to_grid(lon, lat)
        return x * (geo.DX / self.metres), y * (geo.DX / self.metres)

    def inside(self, x: Column, y: Column) -> Column:
        return x.between(0, self.nx - 1) & y.between(0, self.ny - 1)

    def weight(self, x: Column, y: Column, feather_km: float) -> Column:
        """Smoothstep of the distance to the grid's edge; 0 outside."""
        km = F.least(x, self.nx - 1 - x, y, self.ny - 1 - y) * (self.metres / 1000)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), km / feather_km))
        return F.when(self.inside(x, y), t * t * (3 - 2 * t)).otherwise(0.0)


@dataclass(frozen=True)
class Tiling:
    """columns x rows tiles that share their border pixels, over a detail raster of a lattice."""

    lattice: Lattice
    columns: int = geo.TILES
    rows: int = geo.TILES

    @property
    def strides(self) -> tuple[int, int]:
        return (self.lattice.width - 1) // self.columns, (self.lattice.height - 1) // self.rows

    def __post_init__(self) -> None:
        if (self.lattice.width - 1) % self.columns or (self.lattice.height - 1) % self.rows:
            raise ValueError("tiles must share their border pixels")

    def pixels(self, covered: DataFrame) -> DataFrame:
        """tile, px, py, x, y of covered raster pixels (x, y); border pixels once for each tile they are in."""
        sx, sy = self.strides

        def spans(v: Column, stride: int, n: int) -> Column:
            k = F.floor(v / stride).cast("int")
            return F.filter(F.array(k - 1, k), lambda i: i.between(0, n - 1) & (v - i * stride <= stride))

        rows = covered.select("x", "y", F.explode(spans(F.col("y"), sy, self.rows)).alias("_r")).select("x", "y", "_r", F.explode(spans(F.col("x"), sx, self.columns)).alias("_c"))
        return rows.select((F.col("_r") * self.columns + F.col("_c")).alias("tile"), (F.col("x") - F.col("_c") * sx).alias("px"), (F.col("y") - F.col("_r") * sy).alias("py"), "x", "y")


def quads(field: DataFrame) -> DataFrame:
    """hour, qx, qy, v00, v10, v01, v11 of a field (hour, cx, cy, value): each cell with its right and lower neighbours.

    Values that are not finite or below 0 are missing. So a pixel finds all four of its neighbours in one row, and a
    frame is sampled by one join and no aggregation over pixels.
    """
    good = field.where(geo.finite(F.col("value")) & (F.col("value") >= 0))
    corners = F.array(*[F.struct((F.col("cx") - i).alias("qx"), (F.col("cy") - j).alias("qy"), F.lit(f"v{i}{j}").alias("k")) for j in (0, 1) for i in (0, 1)])
    rows = good.select("hour", "value", F.explode(corners).alias("c")).select("hour", "c.*", "value")
    return rows.groupBy("hour", "qx", "qy").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(k) for k in ("v00", "v10", "v01", "v11")])


def bilinear(x: Column, y: Column) -> Column:
    """Weighted mean of a quad's values that are there; null if none with a weight is."""
    fx, fy = x - F.floor(x), y - F.floor(y)
    parts = [("v00", (1 - fx) * (1 - fy)), ("v10", fx * (1 - fy)), ("v01", (1 - fx) * fy), ("v11", fx * fy)]
    used = [(F.col(v), F.when(F.col(v).isNotNull(), w).otherwise(0.0)) for v, w in parts]
    total = used[0][1] + used[1][1] + used[2][1] + used[3][1]
    value = sum((F.when(w > 0, v * w).otherwise(0.0) for v, w in used), F.lit(0.0))
    return F.when(total > 0, value / total)


def compose(first: DataFrame | None, second: DataFrame | None, hours: DataFrame, covered: DataFrame, tiling: Tiling, first_grid: Geographic, second_grid: Lambert, feather_km: float = 200.0) -> DataFrame:
    """hour, tile, px, py, x, y, value, code for every hour and covered pixel of every tile.

    first and second are fields (hour, cx, cy, value) on a geographic and a Lambert grid; a field that is absent, or has
    no row in an hour, counts as missing there. The second one raises the first, feathered in from its grid's edge.
    Pixels outside the coverage have no row. Places and weights depend on pixels only and are worked out once for all hours.
    """
    lon = tiling.lattice.west + F.col("x") * tiling.lattice.lon_step
    lat = F.lit(tiling.lattice.north) - F.col("y") * tiling.lattice.lat_step
    pixels = tiling.pixels(covered)
    ax, ay = first_grid.place(lon, lat)
    bx, by = second_grid.place(lon, lat)
    placed = pixels.select("*", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    placed = placed.withColumn("weight", second_grid.weight(F.col("bx"), F.col("by"), feather_km)).withColumn("_in", second_grid.inside(F.col("bx"), F.col("by")))
    rows = placed.join(hours.select("hour").distinct())  # every pixel is due in every hour: the result's own size
    keep = [*pixels.columns, "hour", "ax", "ay", "bx", "by", "weight", "_in"]
    for field, name in ((first, "a"), (second, "b")):
        x, y = F.col(f"{name}x"), F.col(f"{name}y")
        if field is None:
            rows = rows.select(*keep, F.lit(None).cast("double").alias(name))
        else:
            q = quads(field)
            at = rows.withColumn("qx", F.floor(x).cast("int")).withColumn("qy", F.floor(y).cast("int"))
            rows = at.join(q, ["hour", "qx", "qy"], "left").select(*keep, bilinear(x, y).alias(name))
        keep.append(name)
    second_value = F.when(F.col("_in"), F.col("b"))
    merged = raster.feathered(rows, F.col("a"), second_value, F.col("weight"))
    return merged.select("hour", "tile", "px", "py", "x", "y", F.col("merged").alias("value"), "code")


def base(frames: DataFrame) -> DataFrame:
    """hour, x, y, value, code of the base raster: every fourth pixel, once."""
    own = frames.where((F.col("x") % BASE == 0) & (F.col("y") % BASE == 0))
    rows = own.groupBy("hour", "x", "y").agg(F.min(F.struct("tile", "value", "code")).alias("r"))
    return rows.select("hour", (F.col("x") / BASE).cast("int").alias("x"), (F.col("y") / BASE).cast("int").alias("y"), "r.value", "r.code")


def seam_faults(frames: DataFrame) -> DataFrame:
    """hour, x, y of pixels whose copies in several tiles differ in value or source; null equals null."""
    version = F.struct(F.coalesce(F.col("value").cast("string"), F.lit("none")), "code")
    return frames.groupBy("hour", "x", "y").agg((F.min(version) != F.max(version)).alias("_off")).where("_off").select("hour", "x", "y")


def gaps(frames: DataFrame, hours: DataFrame, covered: DataFrame, tiling: Tiling) -> DataFrame:
    """hour, tile, expected, actual of tiles that lack pixels or have some twice."""
    due = tiling.pixels(covered).groupBy("tile").agg(F.count(F.lit(1)).alias("expected"))
    have = frames.groupBy("hour", "tile").agg(F.count(F.lit(1)).alias("actual"), F.count_distinct("px", "py").alias("_n"))
    both = due.join(hours.select("hour").distinct()).join(have, ["hour", "tile"], "full_outer")
    off = (F.coalesce("actual", F.lit(0)) != F.coalesce("expected", F.lit(0))) | (F.coalesce("_n", F.lit(0)) != F.coalesce("actual", F.lit(0)))
    return both.where(off).select("hour", "tile", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))


def checked(frames: DataFrame, hours: DataFrame, covered: DataFrame, tiling: Tiling) -> DataFrame:
    """The frames, written and read back, once both gates passed; a seam or a gap fails with its first place."""
    frames = staged(frames)
    if (bad := seam_faults(frames).orderBy("hour", "x", "y").first()) is not None:
        raise ValueError(f"tiles disagree on their seam: {bad.asDict()}")
    if (bad := gaps(frames, hours, covered, tiling).orderBy("hour", "tile").first()) is not None:
        raise ValueError(f"a frame is incomplete: {bad.asDict()}")
    return frames


def written_frames(frames: DataFrame, hours: DataFrame, covered: DataFrame, tiling: Tiling, path: str) -> None:
    """Detail tiles and base raster as palette indices and source codes, below path by hour; nothing is written unless
    both gates pass."""
    good = checked(frames, hours, covered, tiling).withColumn("index", raster.palette_index(F.col("value")))
    good.select("hour", "tile", "px", "py", "index", "code").repartition("hour", "tile").sortWithinPartitions("hour", "tile", "py", "px").write.partitionBy("hour").mode("overwrite").parquet(f"{path}/tiles")
    small = base(good).withColumn("index", raster.palette_index(F.col("value")))
    small.select("hour", "x", "y", "index", "code").repartition("hour").write.partitionBy("hour").mode("overwrite").parquet(f"{path}/base")


def published(tiles: DataFrame, previous: DataFrame, reuse: DataFrame, columns: int) -> DataFrame:
    """hour, reused, tiles (array of column, row, path) for every hour of tiles (hour, tile, py, px, index, code) and of
    those that are reused (hour), which take their tiles over from previous (hour, tiles).

    A tile is one asset, addressed by its pixels in order, so equal tiles of different hours share one path; it is put
    together in one task, as its image is. An hour must have its tiles in a full grid of 2 x 2 or 4 x 4, else it fails.
    """
    kept = previous.join(reuse.select("hour").distinct(), "hour", "left_semi").select("hour", F.lit(True).alias("reused"), "tiles")
    own = tiles.join(reuse.select("hour").distinct(), "hour", "left_anti")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("py", "px", "index", "code"))), lambda p: F.concat_ws(":", p["index"], p["code"])), ",")
    assets = own.groupBy("hour", "tile").agg(F.substring(F.sha2(body, 256), 1, 20).alias("h"))
    column, row = (F.col("tile") % columns).cast("int"), F.floor(F.col("tile") / columns).cast("int")
    named = assets.select("hour", F.struct(row.alias("row"), column.alias("column"), F.concat(F.lit("assets/"), "h", F.lit("/best-"), column, F.lit("-"), row).alias("path")).alias("t"))
    listed = named.groupBy("hour").agg(F.array_sort(F.collect_list("t")).alias("t"))
    due = F.transform(F.sequence(F.lit(0), F.lit(columns * columns - 1)), lambda i: F.struct(F.floor(i / columns).cast("int").alias("row"), (i % columns).cast("int").alias("column")))
    whole = F.lit(columns in (2, 4)) & (F.transform("t", lambda x: F.struct(x["row"].alias("row"), x["column"].alias("column"))) == due)
    out = F.transform("t", lambda x: F.struct(x["column"].alias("column"), x["row"].alias("row"), x["path"].alias("path")))
    kind = "array<struct<column:int,row:int,path:string>>"
    fresh = listed.select("hour", F.lit(False).alias("reused"), F.when(whole, out).otherwise(F.raise_error(F.concat(F.lit("tiles form no full grid in hour "), F.col("hour").cast("string"))).cast(kind)).alias("tiles"))
    return fresh.unionByName(kept.select("hour", "reused", F.col("tiles").cast(kind).alias("tiles")))

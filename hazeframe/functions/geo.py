"""Geographic scalars: bounds, distances, projections, tile and pixel arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lon west, lon east, lat south, lat north.
FORECAST_BOX = (-145.0, -45.0, 10.0, 72.0)
DISPLAY_BOX = (-170.0, -45.0, 10.0, 84.0)
MONITOR_BOXES = [(-180.0, -45.0, 10.0, 84.0), (170.0, 180.0, 50.0, 84.0)]
TILE_W, TILE_H, STRIDE_X, STRIDE_Y, TILES = 1024, 635, 1023, 634, 4
# Lambert conformal grid: nx, ny, metres, first latitude, first longitude, central longitude, parallel, earth radius.
NX, NY, DX, LAT1, LON1, LOV, LAT0, RADIUS = 1799, 1059, 3000.0, 21.138123, -122.719528, -97.5, 38.5, 6371229.0


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def in_box(lon: Column, lat: Column, box=FORECAST_BOX) -> Column:
    west, east, south, north = box
    return F.coalesce(finite(lon) & finite(lat) & lon.between(west, east) & lat.between(south, north), F.lit(False))


def unwrapped(lon: Column) -> Column:
    return F.when(lon > 90, lon - 360).otherwise(lon)


def in_display(lon: Column, lat: Column) -> Column:
    return in_box(unwrapped(lon), lat, DISPLAY_BOX)


def in_monitor_regions(lon: Column, lat: Column) -> Column:
    first, second = (in_box(lon, lat, b) for b in MONITOR_BOXES)
    return first | second


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def kilometres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine(lon1, lat1, lon2, lat2, 6371.0)


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine(lon1, lat1, lon2, lat2, 6371000.0)


def lambert() -> tuple[float, float, float, float]:
    """n, F, x0, y0 of the grid's first point relative to the pole's axis."""
    n = math.sin(math.radians(LAT0))
    f = math.cos(math.radians(LAT0)) * math.tan(math.pi / 4 + math.radians(LAT0) / 2) ** n / n
    rho = RADIUS * f / math.tan(math.pi / 4 + math.radians(LAT1) / 2) ** n
    theta = n * math.radians(LON1 - LOV)
    return n, f, rho * math.sin(theta), -rho * math.cos(theta)


def to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Fractional column and row of the Lambert grid."""
    n, f, x0, y0 = lambert()
    rho = F.lit(RADIUS * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    theta = F.radians(lon - LOV) * n
    return (rho * F.sin(theta) - x0) / DX, (-rho * F.cos(theta) - y0) / DX


def from_grid(x: Column, y: Column) -> tuple[Column, Column]:
    n, f, x0, y0 = lambert()
    px, py = x * DX + x0, -(y * DX + y0)
    rho = F.sqrt(px * px + py * py)
    lon = F.degrees(F.atan2(px, py)) / n + LOV
    lat = F.degrees(2 * F.atan(F.pow(F.lit(RADIUS * f) / rho, F.lit(1 / n))) - math.pi / 2)
    return lon, lat


def in_domain(x: Column, y: Column) -> Column:
    return x.between(0, NX - 1) & y.between(0, NY - 1)


def edge_weight(x: Column, y: Column) -> Column:
    """Smoothstep of the distance to the grid's edge over 200 km; 0 outside."""
    km = F.least(x, NX - 1 - x, y, NY - 1 - y) * (DX / 1000)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), km / 200))
    return F.when(in_domain(x, y), t * t * (3 - 2 * t)).otherwise(0.0)


def pixel(lon: Column, lat: Column, width: int, height: int, box=FORECAST_BOX) -> tuple[Column, Column]:
    """Fractional pixel centre coordinates; null outside the box."""
    west, east, south, north = box
    inside = in_box(lon, lat, box)
    return F.when(inside, (lon - west) / (east - west) * (width - 1)), F.when(inside, (north - lat) / (north - south) * (height - 1))


def tile(x: Column, y: Column) -> Column:
    """Tile number of a detail pixel, clamped to the 4 x 4 tiles."""
    clamp = lambda v, stride: F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor(v / stride))).cast("int")
    return clamp(y, STRIDE_Y) * TILES + clamp(x, STRIDE_X)


def sphere(lon: Column, lat: Column) -> Column:
    a, p = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(p) * F.sin(a)).alias("x"), F.sin(p).alias("y"), (F.cos(p) * F.cos(a)).alias("z"))


def from_sphere(v: Column) -> tuple[Column, Column]:
    """lon, lat of a point of the unit sphere."""
    return F.degrees(F.atan2(v["x"], v["z"])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["y"]))))


def tile_bounds(column: Column, row: Column, box=FORECAST_BOX) -> Column:
    """west, east, south, north of a detail tile; neighbours share their border pixels."""
    west, east, south, north = box
    width, height = TILES * STRIDE_X + 1, TILES * STRIDE_Y + 1
    lon = lambda x: west + x * (east - west) / (width - 1)
    lat = lambda y: north - y * (north - south) / (height - 1)
    x, y = column * STRIDE_X, row * STRIDE_Y
    return F.struct(lon(x).alias("west"), lon(x + TILE_W - 1).alias("east"), lat(y + TILE_H - 1).alias("south"), lat(y).alias("north"))


def grid_place(lon: Column, lat: Column, lon0: Column, lat0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Fractional column and row on a geographic grid whose first row is the northern one."""
    return (lon - lon0) / dx, (lat0 - lat) / dy


def lambert_grid_ok(nx: Column, ny: Column, lat1: Column, lon1: Column) -> Column:
    """At least 100 x 100, near the known grid's shape, with a finite origin."""
    return (nx >= 100) & (ny >= 100) & finite(lat1) & finite(lon1) & (F.abs(nx - NX) <= 400) & (F.abs(ny - NY) <= 400)


def geographic_grid_ok(lon0: Column, lat0: Column, dx: Column, dy: Column, width: Column, height: Column, box=FORECAST_BOX) -> Column:
    """Positive steps of at most 5 degrees, on the globe, and touching the forecast box."""
    west, east, south, north = box
    right, low = lon0 + (width - 1) * dx, lat0 - (height - 1) * dy
    steps = (dx > 0) & (dy > 0) & (dx <= 5) & (dy <= 5)
    globe = lon0.between(-180.5, 180.5) & right.between(-180.5, 180.5) & lat0.between(-90.5, 90.5) & low.between(-90.5, 90.5)
    return finite(lon0) & finite(lat0) & finite(dx) & finite(dy) & steps & globe & (right >= west) & (lon0 <= east) & (lat0 >= south) & (low <= north)

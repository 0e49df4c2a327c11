"""Synthetic source without a network: drifting plumes of both models, and whole manifests for given instants.

Nothing is made on the driver: places and instants are rows of the caller's tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators import contract, raster

# Fixed values of the synthetic snapshot: minutes before now that each source was observed (forecasts: the full hour),
# and how many stations each source has.
OBSERVED_BEFORE = {"airnow": 35, "bcair": 40, "sinaica": 45, "aqhi": 30, "wfigs": 60, "cwfis": 120}
MONITORS = {"airnow": 19, "bcair": 5, "sinaica": 4, "aqhi": 8}
FIRST_HOURS, SECOND_HOURS = 73, 49
# Fixed values of the plumes: ground level, then height, centre, drift a step, and widths in columns and rows, of each
# plume on its model's grid. A step is 1.8 columns an hour.
STEP = 1.8
FIRST = 3.0, [(360.0, 72, 61, 1.0, 19, 25), (145.0, 157, 88, -0.35, 34, 22)]
SECOND = 2.0, [(720.0, 238, 210, 0.8, 31, 39), (210.0, 355, 265, -0.25, 52, 28)]
FIRST_WIDTH, FIRST_HEIGHT, SECOND_WIDTH, SECOND_HEIGHT, SECOND_CELLS = 257, 159, 600, 400, 3


def plumes(x: Column, y: Column, hour: Column, model: tuple) -> Column:
    """Concentration of a model at fractional grid places, hours after the run's start."""
    ground, bumps = model
    out = F.lit(ground)
    for top, cx, cy, drift, wide, high in bumps:
        across, down = (x - cx - hour * (STEP * drift)) / wide, (y - cy) / high
        out = out + top * F.exp(-(across * across + down * down))
    return out


def smoke(places: DataFrame, lon: str = "lon", lat: str = "lat", hour: str = "hour") -> DataFrame:
    """Adds merged and code of both models at each place (lon, lat) and hour of the run.

    The first model covers the forecast box from the second hour on, the second one its Lambert grid; they are merged
    as frames are, feathered over 200 km. Places in neither have a null value and code 0. A narrow map, no shuffle.
    """
    x, y = geo.pixel(F.col(lon), F.col(lat), FIRST_WIDTH, FIRST_HEIGHT)
    gx, gy = geo.to_grid(F.col(lon), F.col(lat))
    u, v, hours = F.col("_u"), F.col("_v"), F.col(hour)
    inside = u.between(0, SECOND_WIDTH - 1) & v.between(0, SECOND_HEIGHT - 1)
    edge = F.least(u, SECOND_WIDTH - 1 - u, v, SECOND_HEIGHT - 1 - v) * (geo.DX / 1000 * SECOND_CELLS / 200)
    on_grids = places.withColumns({"_x": x, "_y": y, "_u": gx / SECOND_CELLS, "_v": gy / SECOND_CELLS})
    fields = on_grids.withColumns({"_a": F.when(hours > 0, plumes(F.col("_x"), F.col("_y"), hours, FIRST)), "_b": F.when(inside, plumes(u, v, hours, SECOND)), "_t": F.when(inside, F.least(F.lit(1.0), F.greatest(F.lit(0.0), edge))).otherwise(0.0)})
    t = F.col("_t")
    return raster.feathered(fields, F.col("_a"), F.col("_b"), t * t * (3 - 2 * t)).drop("_x", "_y", "_u", "_v", "_a", "_b", "_t")


def manifests(instants: DataFrame, now: str = "now") -> DataFrame:
    """The columns of contract.MANIFEST added to instants, one whole and valid snapshot for each timestamp."""
    at, hour = F.col(now), F.date_trunc("hour", now)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ahead = lambda i: iso(F.timestamp_seconds(F.unix_timestamp(hour) + i.cast("long") * 3600))
    seen = {name: iso(F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)) for name, minutes in OBSERVED_BEFORE.items()}
    seen |= {"firework": iso(hour), "hrrr": iso(hour)}
    states = F.create_map(*[x for name in contract.SOURCES for x in (F.lit(name), F.struct(F.lit("ok").alias("status"), iso(at).alias("checkedAt"), seen[name].alias("observedAt"), F.lit(f"https://example.org/{name}").alias("provenance")))])
    sets = F.create_map(*[x for name, n in MONITORS.items() for x in (F.lit(name), F.struct(F.lit(f"/{name}-monitors.json").alias("url"), seen[name].alias("observedAt"), F.lit(n).cast("long").alias("count"), F.lit(contract.COUNT_VERSION if name == "aqhi" else None).cast("string").alias("countVersion")))])
    tile = lambda i: F.struct((i % 4).cast("int").alias("column"), F.floor(i / 4).cast("int").alias("row"), F.concat(F.lit("/detail/"), i).alias("textureUrl"), F.concat(F.lit("/detail-mask/"), i).alias("sourceMaskUrl"))
    part = lambda name: F.struct(F.lit(name).alias("source"), iso(hour).alias("modelRun"))
    nothing = F.lit(None).cast("string")

    def frames(n: int, public: bool) -> Column:
        def one(i: Column) -> Column:
            own = [F.concat(F.lit(f"/{kind}/"), i) if public else nothing for kind in ("texture", "mask")]
            parts = F.when(i > 0, F.array(part("hrrr"), part("firework"))).otherwise(F.array(part("hrrr"))) if public else F.lit(None)
            tiles = F.transform(F.sequence(F.lit(0), F.lit(contract.TILES - 1)), tile) if public else F.lit(None)
            return F.struct(ahead(i).alias("validTime"), iso(hour).alias("modelRun"), own[0].alias("textureUrl"), own[1].alias("sourceMaskUrl"), nothing.alias("values"), parts.alias("contributors"), tiles.alias("detailTiles"))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)

    def run(n: int, horizon: int, public: bool = False) -> Column:
        policy = {name: F.lit(v) if public else nothing for name, v in contract.POLICY.items()}
        status, legend, feather = (F.lit("fresh"), F.lit("/forecast-legend.png"), F.lit(200)) if public else (nothing, nothing, F.lit(None).cast("int"))
        fields = {"frames": frames(n, public), "integratedStatus": status, "horizonHours": F.lit(horizon), "modelRun": iso(hour), "legendUrl": legend, **policy, "featherDistanceKm": feather}
        return F.struct(*[c.alias(name) for name, c in fields.items()]).cast(contract.RUN)

    best = run(contract.HORIZON + 1, contract.HORIZON, True)
    box = F.struct(*[F.lit(float(v)).alias(name) for name, v in zip(("west", "east", "south", "north"), geo.FORECAST_BOX, strict=True)])
    air = F.struct(F.lit("/airnow-monitors.json").alias("monitorsUrl"), seen["airnow"].alias("observedAt"), sets.alias("monitorSets"))
    models = F.struct(best.alias("best"), run(SECOND_HOURS, SECOND_HOURS - 1).alias("hrrr"), run(FIRST_HOURS, FIRST_HOURS - 1).alias("firework"))
    columns = {"version": F.lit(8), "mode": F.lit("demo"), "generatedAt": iso(at), "bounds": box, "sources": states, "air": air, "forecast": best, "forecasts": models}
    return instants.select(*instants.columns, *[c.alias(name) for name, c in columns.items()])

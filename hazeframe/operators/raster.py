"""Raster operators on cell tables (x, y, value): sampling, blending, tiling, palettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators.staging import spread

# Fixed values of the display palette: lower bound, red, green, blue, alpha; a ramp runs to the next entry.
STOPS = [(0, 0, 0, 0, 0), (1, 77, 163, 255, 40), (5, 39, 120, 232, 90), (10, 0, 191, 255, 135), (20, 0, 181, 164, 170), (40, 245, 185, 66, 200), (60, 255, 128, 32, 220), (100, 239, 60, 52, 238), (150, 184, 30, 45, 247), (250, 122, 22, 45, 252), (500, 102, 18, 73, 254), (1000, 82, 16, 105, 255)]
STEPS = 24
SOURCES = {0: "none", 1: "first", 2: "second", 3: "combined"}


def neighbours(points: DataFrame, x: str, y: str) -> DataFrame:
    """Four rows per point: column, row and bilinear weight of the cells around it; zero weights are left out."""
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    fx, fy = F.col(x) - x0, F.col(y) - y0
    corner = lambda dx, dy, w: F.struct((x0 + dx).alias("cx"), (y0 + dy).alias("cy"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    return points.withColumn("_n", F.explode(F.filter(four, lambda c: c["w"] > 0))).select(*points.columns, "_n.cx", "_n.cy", "_n.w")


def sampled(points: DataFrame, cells: DataFrame, key: str, x: str = "x", y: str = "y", strict: bool = False) -> DataFrame:
    """key, sample, source: weighted mean of the valid cells around each point, and the heaviest one's source.

    Invalid neighbours are dropped and the weights renormalised; with strict, one missing neighbour gives null. Points
    without a valid neighbour have no sample, never 0. cells: cx, cy, value, and source if there is one.
    """
    source = F.col("source") if "source" in cells.columns else F.lit(None).cast("int")
    joined = neighbours(points, x, y).join(cells.select("cx", "cy", F.col("value").alias("_v"), source.alias("_s")), ["cx", "cy"], "left")
    good = F.when(F.col("_v").isNotNull(), F.col("w"))
    value = F.try_divide(F.sum(F.col("_v") * F.col("w")), F.sum(good))
    value = F.when(F.count("_v") == F.count(F.lit(1)), value) if strict else value
    heavy = F.max_by("_s", F.struct(good, -F.col("cy"), -F.col("cx")))
    return joined.groupBy(key).agg(value.alias("sample"), F.when(F.count("_v") > 0, heavy).alias("source"))


def feathered(cells: DataFrame, first: Column, second: Column, weight: Column, covered: Column | None = None) -> DataFrame:
    """Adds merged and code: first raised towards a larger second by weight; one side alone stands."""
    ok = lambda v: F.coalesce((v >= 0) & (v < float("inf")), F.lit(False))
    a, b = ok(first), ok(second)
    merged = F.when(a & b, first + weight * F.greatest(second - first, F.lit(0.0))).when(a, first).when(b, second)
    code = F.when(a & b & (second > first) & (weight > 0), 3).when(a, 1).when(b, 2).otherwise(0)
    if covered is not None:
        merged, code = F.when(covered, merged), F.when(covered, code).otherwise(0)
    return cells.withColumn("merged", merged).withColumn("code", code)


def tiled(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A row for each tile that holds the cell: shared border cells appear in up to four tiles."""
    def spans(v: Column, stride: int) -> Column:
        k = F.least(F.floor(v / stride).cast("int"), F.lit(geo.TILES - 1))
        return F.when((v % stride == 0) & (k > 0) & (v < stride * geo.TILES), F.array(k - 1, k)).otherwise(F.array(k))

    rows = cells.withColumn("_ty", F.explode(spans(F.col(y), geo.STRIDE_Y))).withColumn("_tx", F.explode(spans(F.col(x), geo.STRIDE_X)))
    return rows.select(*cells.columns, (F.col("_ty") * geo.TILES + F.col("_tx")).alias("tile"), (F.col(x) - F.col("_tx") * geo.STRIDE_X).alias("px"), (F.col(y) - F.col("_ty") * geo.STRIDE_Y).alias("py"))


def seam_faults(rows: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Cells whose copies in several tiles differ; null equals null."""
    same = F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("null")))
    return rows.groupBy(x, y).agg(same.alias("versions"), F.count(F.lit(1)).alias("copies")).where("versions > 1")


def palette_index(v: Column) -> Column:
    """0 for none, else 1 + ramp number * STEPS + place in the ramp, half to even; the last band is flat."""
    out = F.lit(0)
    for n in range(1, len(STOPS)):
        low, start = STOPS[n][0], 1 + (n - 1) * STEPS
        if n == len(STOPS) - 1:
            out = F.when(v >= low, start).otherwise(out)
        else:
            high = STOPS[n + 1][0]
            t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
            out = F.when((v >= low) & (v < high), F.lit(start) + F.rint(t * (STEPS - 1)).cast("int")).otherwise(out)
    return F.when(v.isNotNull() & (v >= 0), out).otherwise(0).cast("int")


def lookup_table(spark: SparkSession) -> DataFrame:
    """index, red, green, blue, alpha, value: one row per palette entry."""
    ramps = [(n - 1, *STOPS[n], *STOPS[min(n + 1, len(STOPS) - 1)]) for n in range(1, len(STOPS))]
    names = ["n", "lo", "r0", "g0", "b0", "a0", "hi", "r1", "g1", "b1", "a1"]
    table = spark.createDataFrame(ramps, ", ".join(f"{c} int" for c in names))
    last = len(STOPS) - 2
    steps = table.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("n") == last, 0).otherwise(STEPS - 1))))
    t = F.col("k") / (STEPS - 1)
    mixed = lambda c: F.rint(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * t).cast("int")
    rows = steps.select((1 + F.col("n") * STEPS + F.col("k")).cast("int").alias("index"), mixed("r").alias("red"), mixed("g").alias("green"), mixed("b").alias("blue"), mixed("a").alias("alpha"), (F.col("lo") + (F.col("hi") - F.col("lo")) * t).alias("value"))
    none = spark.createDataFrame([(0, 0, 0, 0, 0, 0.0)], "index int, red int, green int, blue int, alpha int, value double")
    return none.unionAll(rows)


def palette_use(cells: DataFrame, value: Column) -> DataFrame:
    """index, red, green, blue, alpha, cells: all palette entries with the number of values each stands for, counted
    inside tasks first; invalid values count for entry 0."""
    used = cells.groupBy(palette_index(value).alias("index")).agg(F.count(F.lit(1)).alias("_n"))
    return lookup_table(cells.sparkSession).drop("value").join(used, "index", "left").select("index", "red", "green", "blue", "alpha", F.coalesce("_n", F.lit(0)).alias("cells"))


def coloured(cells: DataFrame, value: Column) -> DataFrame:
    """Adds red, green, blue, alpha of each value; the palette has at most 256 rows, so it is broadcast."""
    table = lookup_table(cells.sparkSession).select(F.col("index").alias("_i"), "red", "green", "blue", "alpha")
    return cells.withColumn("_i", palette_index(value)).join(F.broadcast(table), "_i").drop("_i")


# Colours of the source mask by code, and how far (L1) a texture and a mask colour may be off.
MASK = {0: (0, 0, 0, 0), 1: (32, 96, 176, 255), 2: (208, 88, 48, 255), 3: (71, 166, 139, 255)}
TEXTURE_OFF, MASK_OFF = 12, 1


def mask_code(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """Source code of a mask colour; null for colours that are none's."""
    off = [F.struct(sum((F.abs(c - v) for c, v in zip((red, green, blue, alpha), rgba, strict=True)), F.lit(0)).alias("off"), F.lit(code).alias("code")) for code, rgba in MASK.items()]
    best = F.array_min(F.array(*off))
    return F.when(best["off"] <= MASK_OFF, best["code"])


# How far (L1 over red, green, blue) a colour may be off its source's, and the least alpha that shows.
LABEL_OFF, LEAST_ALPHA = 36, 8


def mask_label(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """Code of the source whose colour is nearest and less than LABEL_OFF away, the smaller code on ties; 0 (none) if no
    source is near or the pixel hardly shows."""
    off = [F.struct(sum((F.abs(c - v) for c, v in zip((red, green, blue), rgba, strict=False)), F.lit(0)).alias("off"), F.lit(code).alias("code")) for code, rgba in MASK.items() if code]
    best = F.array_min(F.array(*off))
    return F.when((alpha >= LEAST_ALPHA) & (best["off"] < LABEL_OFF), best["code"]).otherwise(0)


def palette() -> list[tuple[int, int, int, int, int, float]]:
    """(index, red, green, blue, alpha, value) of all entries, as lookup_table() has them."""
    out = [(0, 0, 0, 0, 0, 0.0)]
    for n in range(1, len(STOPS)):
        low, high = STOPS[n], STOPS[min(n + 1, len(STOPS) - 1)]
        for k in range(1 if n == len(STOPS) - 1 else STEPS):
            lo, r, g, b, a = (x + (y - x) * (k / (STEPS - 1)) for x, y in zip(low, high, strict=True))
            out.append((1 + (n - 1) * STEPS + k, round(r), round(g), round(b), round(a), float(lo)))
    return out


def nearest_entry(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """(apart, index, value) of the palette entry nearest by L1, the smaller index on ties.

    The palette is a constant of the function: no join, one row in and one row out. A batch of pixels is held against one
    entry after the other, and only a strictly nearer one takes the place of the one before.
    """
    table = palette()

    def nearest(red: pd.Series, green: pd.Series, blue: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        channels = (red, green, blue, alpha)
        known = ~np.logical_or.reduce([c.isna().to_numpy() for c in channels])
        pixels = [c.fillna(0).to_numpy("int64") for c in channels]
        apart, place = np.full(len(red), np.iinfo("int64").max), np.zeros(len(red), "int64")
        for n, entry in enumerate(table):
            off = sum(np.abs(p - v) for p, v in zip(pixels, entry[1:5], strict=True))
            nearer = off < apart
            apart[nearer], place[nearer] = off[nearer], n
        place[~known] = 0
        picked = [np.array([entry[k] for entry in table])[place] for k in (0, 5)]
        return pd.DataFrame({"apart": pd.Series(apart).where(known).astype("Int64"), "index": picked[0], "value": picked[1]})

    return F.pandas_udf(nearest, "apart int, index int, value double")(*[c.cast("int") for c in (red, green, blue, alpha)])


def colour_value(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """(index, value) of nearest_entry(); null where the pixel hardly shows."""
    best = nearest_entry(red, green, blue, alpha)
    return F.when(alpha >= LEAST_ALPHA, F.struct(best["index"].alias("index"), best["value"].alias("value")))


def decoded(pixels: DataFrame, key: str) -> DataFrame:
    """key, index, code, valid of pixels (red, green, blue, alpha and mask_red, ...); an unknown colour fails the read."""
    near = nearest_entry(*[F.col(c) for c in ("red", "green", "blue", "alpha")])
    code = mask_code(*[F.col(f"mask_{c}") for c in ("red", "green", "blue", "alpha")])
    out = spread(pixels).select(key, code.alias("code"), near.alias("_n")).select(key, "code", F.when(F.col("_n.apart") <= TEXTURE_OFF, F.col("_n.index")).alias("index"))
    known = F.col("index").isNotNull() & F.col("code").isNotNull()
    return out.select(key, F.when(known, F.col("index")).otherwise(F.raise_error(F.lit("unknown colour")).cast("int")).alias("index"), "code", (F.col("code") != 0).alias("valid"))


def halved(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Every second column and row, renumbered: the overview of a detail grid."""
    return cells.where((F.col(x) % 2 == 0) & (F.col(y) % 2 == 0)).withColumn(x, (F.col(x) / 2).cast("int")).withColumn(y, (F.col(y) / 2).cast("int"))


def quarters(cells: DataFrame, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of the 2 x 2 tiles of a (2 width - 1) x (2 height - 1) grid; the middle column and row are in both."""
    sides = lambda v, n: F.filter(F.array(F.when(v < n, 0), F.when(v >= n - 1, 1)), lambda k: k.isNotNull())
    rows = cells.withColumn("tile_row", F.explode(sides(F.col(y), height))).withColumn("tile_column", F.explode(sides(F.col(x), width)))
    return rows.withColumn("px", F.col(x) - F.col("tile_column") * (width - 1)).withColumn("py", F.col(y) - F.col("tile_row") * (height - 1))


def valid_counts(cells: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, valid: how many of the cells hold a finite value."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("valid"))


def composed(first: DataFrame, second: DataFrame, weight: Column, covered: Column) -> DataFrame:
    """A frame of two reprojected fields (x, y, value) by feathered(), in tiles with checked seams left to seam_faults()."""
    both = first.select("x", "y", F.col("value").alias("first")).join(second.select("x", "y", F.col("value").alias("second")), ["x", "y"], "full_outer")
    return tiled(feathered(both, F.col("first"), F.col("second"), weight, covered))


def reprojected(targets: DataFrame, cells: DataFrame, key: str, grid: dict | None = None) -> DataFrame:
    """sampled() at targets (lon, lat): on a geographic grid (lon0, lat0, dx, dy), else on the Lambert grid."""
    lon, lat = F.col("lon"), F.col("lat")
    x, y = geo.to_grid(lon, lat) if grid is None else geo.grid_place(lon, lat, *[F.lit(float(grid[k])) for k in ("lon0", "lat0", "dx", "dy")])
    return sampled(targets.withColumn("x", x).withColumn("y", y), cells, key)


def nearest_colour(colours: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """key, index, apart: the palette entry nearest by L1 (ties to the smaller index), within most if given."""
    best = nearest_entry(*[F.col(c) for c in ("red", "green", "blue", "alpha")])
    out = spread(colours).select(key, best.alias("b")).select(key, "b.index", "b.apart")
    return out if most is None else out.where(F.col("apart") <= most)


def detail_frame(cells: DataFrame, first: Column, second: Column, weight: Column, covered: Column, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Base raster and tiles of a (2 width - 1) x (2 height - 1) detail grid (x, y): merged once, of which the base
    takes every second column and row and the four tiles, which share the middle ones, take all."""
    merged = feathered(cells, first, second, weight, covered).select("x", "y", F.col("merged").alias("value"), "code")
    return halved(merged), quarters(merged, width, height)

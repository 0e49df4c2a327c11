"""Results at the edges of larger tables, and steps whose work must not fall to one task."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from hazeframe.functions import air
from hazeframe.operators import coast, raster, spatial
from hazeframe.plans import registry
from hazeframe.sources import assets


def test_completeness_without_gaps_is_null(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, hour), 1, "purchase", 1.0) for k, hour in enumerate((0, 1, 2))]
    at = lambda rows, name: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/{name}/events.parquet")
    at(rows, "whole")
    at([rows[0], rows[2]], "gap")
    got = [tuple(registry.QUERIES["A20_completeness"](spark, f"{tmp_path}/{name}").first()) for name in ("whole", "gap")]
    assert got[0] == (3, 3, None) and got[1][:2] == (3, 2) and got[1][2] is not None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_incidents_are_not_sorted_whole_and_the_last_in_order_wins(spark, tmp_path):
    rows = spark.range(4 * registry.published.SIZE * registry.published.FOLDER).select((F.col("id") % 2).cast("int").alias("asset"), F.col("id").alias("n"))
    body = F.to_json(F.struct(F.concat(F.lit("i"), F.col("n") % 7).alias("id"), F.lit("fire").alias("name"), F.when(F.col("n") % 5 != 0, "US").otherwise("XX").alias("country"), F.lit(-120.0).alias("lon"), F.lit(45.0).alias("lat"), F.lit("active").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"), F.lit("https://x").alias("sourceUrl"), F.col("n").cast("double").alias("areaHectares")))
    registry.published._write_envelopes(rows, "incidents", body, f"file://{tmp_path}/all")
    assert len(list((tmp_path / "all").glob("asset=*/folder=*/*.txt"))) == 4 * registry.published.FOLDER * 2 and len(list((tmp_path / "all").glob("asset=*/folder=*"))) == 8
    got, outcomes = assets.incidents(spark, [("odd", f"file://{tmp_path}/all/asset=1"), ("even", f"file://{tmp_path}/all/asset=0")])
    top = 4 * registry.published.SIZE * registry.published.FOLDER
    want = {f"i{k}": float(max(n for n in range(k, top, 7) if n % 5 and n % 2 == 0)) for k in range(7)}
    assert {r["id"]: r["areaHectares"] for r in got.collect()} == want and {r["status"] for r in outcomes.collect()} == {"ok"}
    assert "SortAggregate" not in plan_of(got)


def test_copies_of_points_cost_no_pairs(spark, monkeypatch):
    """600 cities at one point and 500 stations at another: one pair, and the tie rules of all rows hold."""
    made = []
    true = spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: made.append(true(*a)) or made[-1])
    left = spark.range(600).select(F.col("id").alias("a"), F.lit(10.0).alias("lon"), F.lit(20.0).alias("lat"), (F.col("id") % 2 == 0).alias("home"))
    right = spark.range(500).select(F.col("id").alias("b"), (F.col("id") % 9 + 3).alias("age"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("system"), F.lit(10.1).alias("r_lon"), F.lit(20.0).alias("r_lat"))
    got = spatial.nearest_within(left, right, 50.0, "age", "b", first=F.col("system") == "y", where=(F.col("system") == "y") | F.col("home"), sees=("home",), kinds=("system",)).collect()
    assert len(got) == 600 and {(r["a"] % 2, r["b"]) for r in got} == {(0, 0), (1, 1)}
    assert sum(df.count() for df in made) <= 8
    land = right.select("r_lon", "r_lat")
    near = spatial.coastal(left.withColumnRenamed("a", "k"), land, "k").collect()
    assert len(near) == 600 and len({round(r["km"], 6) for r in near}) == 1 and 10 < near[0]["km"] < 11
    assert spatial.coastal(left.withColumnRenamed("a", "k"), land, "k", 5.0).count() == 0


def test_manifests_are_dealt_over_all_tasks(spark):
    for name in ("V01_manifest_rules", "V03_valid_manifests", "V04_normalised_manifests", "T05_retained_runs", "U06_monitor_urls"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name


def test_filled_rows_match_the_parity_of_each_cell(spark):
    """Crossing, concave, degenerate and broken rings; a ring's row is cut once, and polygons are dealt over all tasks."""
    rng = random.Random(3)
    rings = [[(rng.randint(-24, 24) / rng.choice([1, 2, 4, 3]), rng.randint(-24, 24) / rng.choice([1, 2, 4, 3])) for _ in range(rng.randint(3, 9))] for _ in range(60)]
    rings += [[(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)], [(0.0, 0.0), (3.0, 3.0), (0.0, 3.0), (3.0, 0.0)], [(1.0, 1.0)], [(2.0, 2.0), (None, 4.0), (6.0, None), (7.0, 7.0), (1.0, 5.0)], [(-0.5 + 2**-54, -1.0), (5.0, -1.0), (5.0, 2.0), (-0.5 + 2**-54, 2.0)]]
    shapes = spark.createDataFrame(list(enumerate(rings)), "k int, ring array<struct<x:double,y:double>>").coalesce(1)
    got = spatial.filled(shapes, "k", "ring")
    span = lambda c: F.sequence(F.floor(F.array_min(F.col("ring")[c])).cast("int"), F.ceil(F.array_max(F.col("ring")[c])).cast("int"))
    box = shapes.select("k", "ring", span("x").alias("xs"), F.explode(span("y")).alias("cy")).select("k", "ring", "cy", F.explode("xs").alias("cx"))
    want = box.where(spatial.inside(F.col("ring"), F.col("cx") + 0.5, F.col("cy") + 0.5)).select("k", "cx", "cy")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000
    assert got.rdd.getNumPartitions() == 4


def test_palette_entries_of_a_batch(spark):
    """Ties go to the smaller index, unknown channels to no distance; the work is dealt over all tasks."""
    table = raster.palette()
    rng = random.Random(8)
    rows = [(n, *(rng.randint(0, 255) for _ in range(4))) for n in range(300)] + [(300, None, 1, 2, 3), (301, 0, 0, 0, 0), (302, 184, 30, 45, 247)]
    colours = spark.createDataFrame(rows, "n int, red int, green int, blue int, alpha int").coalesce(1)
    near = raster.nearest_colour(colours, "n")
    got = {r["n"]: (r["index"], r["apart"]) for r in near.collect()}
    for n, *c in rows:
        want = (0, None) if None in c else min((sum(abs(p - v) for p, v in zip(c, t[1:5], strict=True)), t[0]) for t in table)[::-1]
        assert got[n] == want, n
    assert near.rdd.getNumPartitions() == 4
    for name in ("R15_nearest_colour", "R15_colour_values", "R17_decoded_pixels"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name


def test_nowcast_works_its_weight_out_once(spark):
    rng = random.Random(5)
    rows = [[rng.choice([None, 0.0, rng.uniform(-6, 300)]) for _ in range(12)] for _ in range(300)] + [[0.0] * 12, [None] * 12, [-1.0] * 12, [-9.0] * 12, [7.5, None, 7.5] + [None] * 9]

    def plain(slots):
        known = [v for v in slots if v is not None]
        if sum(v is not None for v in slots[:3]) < 2:
            return None
        high, low = max(known), min(known)
        w = (1.0 if low == 0 else 0.5) if high == 0 else max(0.5, low / high)
        value = sum(v * w**i for i, v in enumerate(slots) if v is not None) / sum(w**i for i, v in enumerate(slots) if v is not None)
        return math.trunc(round(0.0 if -5 < value < 0 else value, 9) * 10 + (1e-7 if value > 0 else -1e-7)) / 10

    df = spark.createDataFrame(list(enumerate(rows)), "n int, slots array<double>").select("n", air.nowcast(F.col("slots")).alias("v"))
    for r in df.collect():
        want = plain(rows[r["n"]])
        assert r["v"] == want or abs(r["v"] - want) < 1e-9, (r, want)
    assert plan_of(df).count("array_max") <= 2 and plan_of(df).count("array_min") <= 2  # it was worked out for each slot


def test_sea_points_are_hashed_not_sorted(spark):
    lattice = coast.Lattice(40, 30)
    ring = lambda a, b, r: [(a - r, b - r), (a + r, b - r), (a + r, b + r), (a - r, b + r)]
    # a sea with an island, the island's lake painted later, and a sea painted before that an island of its own number hides
    shapes = [(1, [ring(-100.0, 45.0, 20.0), ring(-100.0, 45.0, 10.0)]), (2, [ring(-100.0, 45.0, 4.0)]), (0, [ring(-100.0, 45.0, 30.0)])]
    got = coast.sea(spark.createDataFrame(shapes, "ord long, rings array<array<struct<lon:double,lat:double>>>"), lattice)
    seen = {tuple(r) for r in got.collect()}
    for lon, lat, sea in ((-100.0, 45.0, True), (-107.0, 45.0, False), (-115.0, 45.0, True), (-125.0, 45.0, True)):
        x, y = round((lon - lattice.west) / lattice.lon_step), round((lattice.north - lat) / lattice.lat_step)
        assert ((x, y) in seen) is sea, lon
    assert "SortAggregate" not in plan_of(got)

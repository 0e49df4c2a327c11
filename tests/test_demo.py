"""The synthetic source: plumes against plain Python, manifests against the contract's rules."""

import datetime
import math

from pyspark.sql import functions as F

from hazeframe.operators import contract, raster
from hazeframe.sources import demo


def plain(x, y, hour, model):
    ground, bumps = model
    return ground + sum(top * math.exp(-(((x - cx - hour * demo.STEP * drift) / wide) ** 2) - ((y - cy) / high) ** 2) for top, cx, cy, drift, wide, high in bumps)


def test_plumes_match_plain_python(spark):
    rows = [(float(x), float(y), h) for x in (0, 72, 157, 256) for y in (0, 61, 158) for h in (0, 1, 36)]
    got = spark.createDataFrame(rows, "x double, y double, h int").select("x", "y", "h", demo.plumes(F.col("x"), F.col("y"), F.col("h"), demo.FIRST).alias("v")).collect()
    for r in got:
        assert math.isclose(r["v"], plain(r["x"], r["y"], r["h"], demo.FIRST), rel_tol=1e-9)


def test_the_first_hour_is_the_second_models_alone(spark):
    rows = [(1, -97.5, 38.5, 0), (1, -97.5, 38.5, 1), (2, -140.0, 70.0, 0), (2, -140.0, 70.0, 1), (3, 10.0, 80.0, 5), (4, None, 40.0, 5)]
    out = demo.smoke(spark.createDataFrame(rows, "id int, lon double, lat double, hour int"))
    assert out.columns == ["id", "lon", "lat", "hour", "merged", "code"]
    got = {(r["id"], r["hour"]): (r["merged"], r["code"]) for r in out.collect()}
    assert got[1, 0][1] == 2 and got[1, 0][0] >= 2
    assert got[1, 1][1] in (1, 3) and got[1, 1][0] >= 3
    assert got[2, 0] == (None, 0) and got[2, 1][1] == 1
    assert got[3, 5] == (None, 0) and got[4, 5] == (None, 0)


def test_manifests_keep_every_rule(spark):
    now = [datetime.datetime(2024, 2, 28, 23, 50), datetime.datetime(2024, 12, 31, 12, 0)]
    whole = demo.manifests(spark.createDataFrame([(t,) for t in now], "now timestamp"))
    assert [f for f in whole.schema.names if f != "now"] == [f.split(" ")[0] for f in "version mode generatedAt bounds sources air forecast forecasts".split()]
    broken = [name for name, ok in contract.manifest_rules().items() if whole.where(~F.coalesce(ok, F.lit(False))).count()]
    assert broken == []
    one = whole.where("month(now) = 2").select("forecast.frames", "sources").first()
    assert one["frames"][0]["validTime"] == "2024-02-28T23:00:00Z" and one["frames"][36]["validTime"] == "2024-03-01T11:00:00Z"
    assert [len(f["contributors"]) for f in one["frames"][:2]] == [1, 2]
    assert one["sources"]["airnow"]["observedAt"] == "2024-02-28T23:15:00Z"
    assert demo.manifests(spark.createDataFrame([], "now timestamp")).count() == 0


def test_palette_entries_without_cells_are_kept(spark):
    got = raster.palette_use(spark.createDataFrame([(0.5,), (None,), (1500.0,), (1200.0,)], "v double"), F.col("v")).collect()
    used = {r["index"]: r["cells"] for r in got}
    assert len(got) == 242 and used[0] == 2 and used[241] == 2 and sum(used.values()) == 4

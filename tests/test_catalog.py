"""Landmark lists, forecast hours, published tiles and detail frames: what is wrong is named or fails."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from hazeframe.operators import catalog, frames, raster

COUNTRIES = ["CAN", "MEX", "USA"]
LIST = "qid string, name string, country string, category string, rank int, lon double, lat double"


def good():
    sorts = ["natural"] * 7 + ["park"] * 7 + ["cultural"] * 6
    return [(f"Q{100 * n + r}", "n", c, sorts[r - 1], r, -100.1234567, 45.0) for n, c in enumerate(COUNTRIES) for r in range(1, 21)]


def faults(spark, rows):
    return sorted((r["rule"], r["subject"]) for r in catalog.landmark_faults(spark.createDataFrame(rows, LIST), COUNTRIES).collect())


def test_landmark_rules(spark):
    rows = good()
    assert faults(spark, rows) == []
    whole = catalog.landmarks(spark.createDataFrame(rows[::-1], LIST), COUNTRIES).orderBy("place").collect()
    assert [r["id"] for r in whole[:4]] == ["wikidata:Q1", "wikidata:Q101", "wikidata:Q201", "wikidata:Q102"] and whole[0]["lon"] == -100.123457
    assert [whole[i]["tier"] for i in (0, 15, 30, 45, 59)] == ["detail-major", "detail-regional", "detail-local", "local", "local"]
    change = lambda i, k, v: [*rows[:i], (*rows[i][:k], v, *rows[i][k + 1 :]), *rows[i + 1 :]]
    assert faults(spark, change(0, 0, "Qx")) == [("id", "Qx")]
    assert faults(spark, change(0, 0, "Q2")) == [("repeated id", "Q2")]
    assert faults(spark, change(0, 4, 2)) == [("missing rank", "CAN:1"), ("repeated rank", "CAN:2")]
    assert faults(spark, change(0, 4, None)) == [("missing rank", "CAN:1"), ("rank", "Q1")]
    assert faults(spark, change(0, 5, float("nan"))) == [("place", "Q1")]
    assert faults(spark, change(0, 3, "park")) == [("category count", "CAN:natural"), ("category count", "CAN:park")]
    assert faults(spark, change(0, 2, "FRA")) == [("category count", "CAN:natural"), ("classification", "Q1"), ("missing rank", "CAN:1")]
    with pytest.raises(ValueError, match="repeated id: Q2"):
        catalog.landmarks(spark.createDataFrame(change(0, 0, "Q2"), LIST), COUNTRIES)


def test_native_hours(spark):
    run = dt.datetime(2024, 1, 1, 6)
    at = lambda h, s=0: run + dt.timedelta(hours=h, seconds=s)
    asked = [(run, at(h)) for h in (-1, 0, 1, 2, 3, 4, 48, 49)]
    fields = [(run, at(h), at(h, s)) for h, s in ((-1, 0), (0, 60), (1, 61), (2, 0), (4, -60), (48, 0), (49, 0))]
    cells = [(run, at(h), v) for h in (0, 1, 4, 48) for v in (None, 1.0)] + [(run, at(2), None), (run, at(2), float("nan"))]
    got = catalog.native_hours(spark.createDataFrame(asked, "run timestamp, valid timestamp"), spark.createDataFrame(fields, "run timestamp, valid timestamp, stated timestamp"), spark.createDataFrame(cells, "run timestamp, valid timestamp, value double"))
    assert {r["hour"]: r["fault"] for r in got.collect()} == {-1: "hour", 0: None, 1: "valid-time", 2: "cells", 3: "missing", 4: None, 48: None, 49: "hour"}


def test_published_tiles(spark):
    rows = [(h, k, y, x, (x + y) % 3, 1) for h in (1, 2) for k in range(4) for y in range(3) for x in range(3)]
    schema = "hour int, tile int, py int, px int, index int, code int"
    none = spark.createDataFrame([], "hour int, tiles array<struct<column:int,row:int,path:string>>")
    df = spark.createDataFrame(rows, schema)
    got = {r["hour"]: r["tiles"] for r in frames.published(df, none, none.select("hour"), 2).collect()}
    assert [(t["column"], t["row"]) for t in got[1]] == [(0, 0), (1, 0), (0, 1), (1, 1)] and got[1] == got[2]
    assert len({t["path"].split("/")[1] for t in got[1]}) == 1 and got[1][1]["path"].endswith("/best-1-0")
    old = spark.createDataFrame([(2, [(0, 0, "old")])], none.schema)
    again = {r["hour"]: (r["reused"], [t["path"] for t in r["tiles"]]) for r in frames.published(df, old, old.select("hour"), 2).collect()}
    assert again[2] == (True, ["old"]) and again[1][0] is False
    for wrong, columns in ((df.where("tile <> 3"), 2), (df, 3), (df, 4)):
        with pytest.raises(Exception, match="no full grid"):
            frames.published(wrong, none, none.select("hour"), columns).collect()


def test_detail_frame_is_merged_once(spark):
    rows = [(x, y, float(x + y) if x % 3 else None, 5.0) for x, y in itertools.product(range(5), range(3))]
    base, tiles = raster.detail_frame(spark.createDataFrame(rows, "x int, y int, a double, b double"), F.col("a"), F.col("b"), F.lit(0.5), F.col("x") != 4, 3, 2)
    value = {(x, y): None if x == 4 else 5.0 if a is None else a + 0.5 * max(b - a, 0) for x, y, a, b in rows}
    assert {(r["x"], r["y"]): r["value"] for r in base.collect()} == {(x // 2, y // 2): v for (x, y), v in value.items() if x % 2 == 0 and y % 2 == 0}
    got = tiles.collect()
    assert len(got) == 4 * 6 and all(r["value"] == value[r["tile_column"] * 2 + r["px"], r["tile_row"] * 1 + r["py"]] for r in got)

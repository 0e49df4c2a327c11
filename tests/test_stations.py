"""Station series, published documents, stored fields and reuse rules against plain Python."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from hazeframe.operators import contract, snapshot, temporal
from hazeframe.sources import stations

NOW = dt.datetime(2024, 7, 15, 18, 20, tzinfo=dt.timezone.utc)


def rows_of(values, zone):
    """Rows as the provider writes them, of {hours before now: value}."""
    out = []
    for age, v in values.items():
        local = (NOW.replace(minute=0) - dt.timedelta(hours=age)).astimezone(ZoneInfo(zone))
        out.append({"valor": v, "fecha": local.strftime("%Y-%m-%d"), "hora": local.hour})
    return out


def test_station_series_and_outcomes(spark):
    zone = "America/Tijuana"  # seven hours behind in July, eight in January
    whole = {k: 35.0 for k in range(12)}
    cases = {
        "whole": (json.dumps(rows_of(whole, zone)), "ok", 35.0),
        "script": (f"<script>var dat = {json.dumps(rows_of(whole, zone))};</script>", "ok", 35.0),
        "sparse": (json.dumps(rows_of({1: 5.0, 4: 6.0}, zone)), "sparse", None),
        "stale": (json.dumps(rows_of({k: 9.0 for k in range(4, 12)}, zone)), "stale", None),
        "odd": (json.dumps([{"valor": "x", "fecha": "2024-07-15", "hora": 1}, {"valor": 5, "fecha": "15/07/2024", "hora": 1}, {"valor": -1, "fecha": "2024-07-15", "hora": 1}, {"valor": 1, "fecha": "2024-07-15", "hora": 24}]), "failed", None),
        "ahead": (json.dumps(rows_of({-3: 9.0, **whole}, zone)), "ok", 35.0),
        "twice": (json.dumps(rows_of({k: 99.0 for k in range(12)}, zone) + rows_of(whole, zone)), "ok", 35.0),
        "broken": ('[{"valor": 1', "failed", None),
        "none": (None, "failed", None),
        "absent": ("-", "failed", None),
    }
    known = spark.createDataFrame([(k, k, "g", -117.0, 32.5, zone) for k in cases], "id string, name string, agency string, lon double, lat double, zone string")
    bodies = spark.createDataFrame([(k, b) for k, (b, _, _) in cases.items() if b != "-"], "id string, body string")
    got, outcomes = stations.monitors(bodies, known, F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    assert {r["id"]: r["outcome"] for r in outcomes.collect()} == {k: o for k, (_, o, _) in cases.items()}
    found = {r["id"]: r for r in got.collect()}
    assert {k: r["nowcast"] for k, r in found.items()} == {k: v for k, (_, _, v) in cases.items() if v is not None}
    assert found["whole"]["aqi"] == 99 and found["whole"]["category"] == "Moderate" and found["ahead"]["observed"] == dt.datetime(2024, 7, 15, 18)


def test_documents_keep_to_their_budget(spark):
    rows = spark.createDataFrame([(g, k, json.dumps({"k": k})) for g in (0, 1) for k in (3, 1, 2)], "g int, k int, item string")
    got = {r["g"]: r for r in snapshot.envelopes(rows, "g", "item", "k", "monitors", 1000).collect()}
    assert json.loads(got[0]["payload"]) == {"count": 3, "monitors": [{"k": 1}, {"k": 2}, {"k": 3}], "sourceCount": 3}
    assert got[0]["path"] == got[1]["path"] and got[0]["bytes"] == len(got[0]["payload"])
    with pytest.raises(Exception, match="over its budget"):
        snapshot.envelopes(rows, "g", "item", "k", "monitors", 50).collect()


def test_a_status_that_cannot_be_written_is_told(spark, tmp_path):
    status = spark.createDataFrame([("fresh", 2)], "outcome string, n int")
    folder = snapshot.Folder(spark, f"{tmp_path}/s")
    assert snapshot.write_status(folder, status) and json.loads(folder.text("status.json")) == {"outcome": "fresh", "n": 2}
    (tmp_path / "file").write_text("in the way")
    assert snapshot.write_status(snapshot.Folder(spark, f"{tmp_path}/file"), status) is False


def test_stored_fields(spark):
    hours = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "valid int, second_run string")
    first = spark.createDataFrame([("a", v, f"f{v}") for v in (1, 2, 3)] + [("old", 1, "x")], "run string, valid int, field string")
    second = spark.createDataFrame([("b", 1, "s1"), ("b", 3, "x"), ("c", 3, "s3")], "run string, valid int, field string")
    got = sorted(map(tuple, temporal.paired_fields(hours, first, second, "a").collect()))
    assert got == [(1, "f1", "s1", "b"), (2, "f2", None, None), (3, "f3", "s3", "c")]
    assert {r["first"] for r in temporal.paired_fields(hours, first, second, None).collect()} == {None}
    for a, b in ((first.where("valid <> 2"), second), (first, second.where("run <> 'c'"))):
        with pytest.raises(Exception, match="disappeared"):
            temporal.paired_fields(hours, a, b, "a").collect()


def test_reuse_rules(spark):
    rows = spark.createDataFrame([(1, ("v", None, None)), (2, ("v", "x", None)), (3, ("w", None, None)), (4, ("v", None, True)), (5, ("v", None, False)), (6, None)], "k int, p struct<a:string,b:string,incomplete:boolean>")
    got = {r["k"]: r["ok"] for r in rows.select("k", contract.reusable(F.col("p"), {"a": F.lit("v"), "b": None}).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    cache = spark.createDataFrame([("p", "s", 5), ("p", "s", 4), ("q", "s", 5), ("p", "t", 5)], "parser string, signature string, hour int")
    assert contract.cached_set(cache, "p", F.lit("s"), F.lit(6), 2).count() == 2
    assert contract.cached_set(cache, "p", F.lit("s"), F.lit(6), 3).count() == 0

"""Envelopes, fire parts, search keys, mask labels and palette values against plain Python."""

import itertools
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from hazeframe.functions import text
from hazeframe.operators import raster
from hazeframe.plans import registry
from hazeframe.sources import assets, payloads

MONITOR = {"id": "a", "name": "n", "agency": "g", "lon": -100.0, "lat": 40.0, "observedAt": "2024-01-01T00:00:00Z", "category": "Good", "aqi": 12, "concentration": 3, "unit": "ug/m3"}
FIRE = {"id": "US:1", "name": "f", "country": "US", "lon": -120.0, "lat": 45.0, "status": "Active", "updatedAt": "2024-01-01T00:00:00Z", "sourceUrl": "https://x", "areaHectares": 5.0}


def put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return f"file://{path}"


def test_envelopes_and_their_outcomes(spark, tmp_path):
    odd = [{**MONITOR, "id": "b", "lat": "north"}, 7, None, {**MONITOR, "id": "c"}]
    listed = [
        ("airnow", put(tmp_path / "air.json", {"count": 2, "monitors": [MONITOR, {"id": ""}], "sourceCount": 9})),
        ("bcair", put(tmp_path / "bc.json", {"count": 9, "monitors": odd})),
        ("sinaica", put(tmp_path / "mx.json", '{"count": 1, "monitors": [{"id"')),
        ("aqhi", f"file://{tmp_path}/none.json"),
        ("aqhi", put(tmp_path / "empty.json", {"count": 0})),
        ("aqhi", put(tmp_path / "list.json", [MONITOR])),
        ("aqhi", put(tmp_path / "text.json", {"monitors": "none"})),
    ]
    rows, outcomes = assets.monitors(spark, listed)
    got = [(r["asset"], r["id"], r["ord"], r["indexSystem"], r["indexValue"]) for r in rows.orderBy("precedence", "path", "ord").collect()]
    assert got == [("airnow", "a", 0, "us-epa-pm25-aqi", 12.0), ("bcair", "c", 3, "us-epa-pm25-aqi", 12.0)]
    assert [r["status"] for r in outcomes.orderBy("precedence").collect()] == ["ok", "count", "corrupt", "missing", "ok", "corrupt", "corrupt"]
    assert [r["found"] for r in outcomes.orderBy("precedence").collect()][:4] == [2, 4, 0, 0]
    assert assets.loaded(outcomes) is False and assets.loaded(outcomes.where("status = 'ok'")) is True
    for bad in (listed[2:4], listed[3:4]):
        with pytest.raises(ValueError, match="no asset"):
            assets.monitors(spark, bad)


def test_incidents_of_several_files_keep_their_order(spark, tmp_path):
    files = {"1.json": [FIRE, {**FIRE, "areaHectares": 6.0}], "0.json": [{**FIRE, "areaHectares": 99.0}, {**FIRE, "id": "US:2"}], "2.json": [{**FIRE, "country": "XX", "areaHectares": 1.0}]}
    for name, items in files.items():
        put(tmp_path / "us" / name, {"incidents": items})
    later = put(tmp_path / "ca.json", {"incidents": [{**FIRE, "id": "US:2", "areaHectares": 8.0}]})
    got, outcomes = assets.incidents(spark, [("wfigs", f"file://{tmp_path}/us"), ("cwfis", later)])
    assert {r["id"]: r["areaHectares"] for r in got.collect()} == {"US:1": 6.0, "US:2": 8.0}
    assert assets.loaded(outcomes) is True
    none, outcomes = assets.incidents(spark, [])
    assert none.count() == 0 and outcomes.count() == 0


RING = [[-120.0, 45.0], [-119.0, 45.0], [-119.0, 46.0], [None, 1.0]]
GOOD = json.dumps({"features": [{"attributes": {"IrwinID": "x", "IncidentName": "n", "IncidentSize": 10}, "geometry": {"x": -120.0, "y": 45.0}}]})


NUMBER = itertools.count(1)
ALIKE = json.dumps({"features": [{"attributes": {"OBJECTID": 0}, "geometry": {"rings": []}}]})


def shapes(**more):
    kinds = [{"attr_IncidentTypeCategory": "RX"}, {"attr_IncidentTypeCategory": "WF"}, {"poly_IncidentTypeCategory": "prescribed"}, {}]
    far = [[10.0, 10.0], [11.0, 10.0], [11.0, 11.0]]
    return json.dumps({"features": [{"attributes": {"OBJECTID": next(NUMBER)} | k, "geometry": {"rings": [RING, far]}} for k in kinds]} | more)


@pytest.mark.parametrize(
    ("bodies", "message"),
    [
        ([shapes()], None), ([shapes(), shapes()], None), (None, "not loaded"), ([shapes(), '{"features": ['], "no JSON"), ([shapes(exceededTransferLimit=True)] * 1, "cut short"), ([shapes(exceededTransferLimit=True), shapes()], None), ([shapes(), ALIKE, ALIKE], "invalid paging"),
        ([shapes(), json.dumps({"error": "quota"})], "provider error: quota"), ([json.dumps({"x": 1})], "no features"),
    ],
)
def test_incidents_survive_failed_perimeters(spark, bodies, message):
    raw = spark.createDataFrame([(GOOD,)], "body string")
    known, rings, outcomes = payloads.fire_parts(raw, None if bodies is None else spark.createDataFrame([(b,) for b in bodies], "body string"), "body")
    assert [r["id"] for r in known.collect()] == ["x"]
    assert {r["part"]: (r["ok"], r["message"]) for r in outcomes.collect()} == {"incidents": (True, None), "perimeters": (message is None, message)}
    got = [[(p["x"], p["y"]) for p in r["points"]] for r in rings.collect()]
    assert len(got) == (2 * len(bodies) if message is None else 0) and all(sorted(g) == sorted(map(tuple, RING[:3])) for g in got)


def test_failed_incidents_fail_the_read(spark):
    raw = spark.createDataFrame([(json.dumps({"error": "down", "features": []}),)], "body string")
    with pytest.raises(Exception, match="provider error"):
        payloads.fire_parts(raw, spark.createDataFrame([(shapes(),)], "body string"), "body")[0].collect()


def plain_key(value):
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", value)).lower()
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def test_search_keys_decompose_every_code_point(spark):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(n, "x".join(chr(c) + "y" for c in points[n : n + 64])) for n in range(0, len(points), 64)]
    rng = random.Random(1)
    rows += [(-1 - n, "".join(rng.choice(["a", "E", "́", "̧", "Ǘ", "İ", "K", "ẩ", " ", "-", "ß", "中", "0"]) for _ in range(30))) for n in range(200)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "n int, t string").select("n", text.search_key(F.col("t"))).collect()}
    for n, t in rows:
        assert got[n] == plain_key(t), (n, t)


def test_mask_labels_and_palette_values(spark):
    rng = random.Random(4)
    near = [tuple(max(0, min(255, c + rng.randint(-20, 20))) for c in rng.choice(list(raster.MASK.values()))[:3]) + (rng.choice([0, 7, 8, 255]),) for _ in range(200)]
    rows = near + [tuple(rng.randint(0, 255) for _ in range(4)) for _ in range(100)] + [(32, 96, 176, 255), (32, 96, 212, 255), (32, 96, 211, 255)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, r int, g int, b int, a int")
    c = [F.col(k) for k in "rgba"]
    got = {r["n"]: r for r in df.select("n", raster.mask_label(*c).alias("code"), raster.colour_value(*c).alias("v")).collect()}
    table = raster.palette()
    assert [t[:5] for t in table] == [tuple(r)[:5] for r in raster.lookup_table(spark).orderBy("index").collect()]
    for n, (r, g, b, a) in enumerate(rows):
        off = min((abs(r - m[0]) + abs(g - m[1]) + abs(b - m[2]), k) for k, m in raster.MASK.items() if k)
        assert got[n]["code"] == (off[1] if a >= 8 and off[0] < 36 else 0)
        best = min(table, key=lambda t: (abs(r - t[1]) + abs(g - t[2]) + abs(b - t[3]) + abs(a - t[4]), t[0]))
        assert (got[n]["v"] is None) == (a < 8) and (a < 8 or (got[n]["v"]["index"], got[n]["v"]["value"]) == (best[0], best[5]))


def test_incident_clusters_match_a_walk(spark):
    sf = "/root/testdata/sf0.001"
    by = {}
    for r in registry.published.incident_points(registry.Tables(spark, sf)).collect():
        by.setdefault(r["screen"], []).append(r)
    want = []
    for screen, rows in by.items():
        founders = []
        for r in sorted(rows, key=lambda r: r["name"]):
            near = next((f for f in founders if (f["x"] - r["x"]) ** 2 + (f["y"] - r["y"]) ** 2 < 3600), None)
            if near is None:
                founders.append(r)
            want.append((screen, r["id"], (near or r)["id"]))
    got = registry.QUERIES["R29_incident_clusters"](spark, sf).select("screen", "id", "cluster").collect()
    assert sorted(map(tuple, got)) == sorted(want)

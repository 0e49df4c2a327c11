"""Core engine: every query against its oracle SQL on the small tables, and known values of scalars and operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from hazeframe.functions import air, text
from hazeframe.operators import quality, ranking, series, snapshot, spatial
from hazeframe.plans import registry
from hazeframe.sources import payloads

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings", "benchmark", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def slots(*values):
    padded = [*values, *[None] * (12 - len(values))]
    return F.array(*[F.lit(v).cast("double") for v in padded])


@pytest.mark.parametrize(
    ("values", "nowcast", "index"),
    [
        ((40, None, 20), 36.0, 102),  # weight 0.5: (40 + 20 / 4) / (1 + 1 / 4)
        ((30, None, 30), 30.0, 90),
        ((-2, 0, 0), 0.0, 0),
        ((-20, 0, 0, *(-20,) * 9), -12.4, 0),  # weight 0.5 at a maximum of 0 below which there is more; cut towards 0
        ((10,), None, None),
        ((0,) * 12, 0.0, 0),
        ((100, *(0,) * 11), 50.0, 137),
    ],
)
def test_nowcast(spark, values, nowcast, index):
    got = one(spark, air.nowcast(slots(*values)))
    assert got == pytest.approx(nowcast) if nowcast is not None else got is None
    assert one(spark, air.pm25_index(air.tenths(air.nowcast(slots(*values))))) == index


@pytest.mark.parametrize(("v", "index"), [(9.0, 50), (9.1, 51), (35.4, 100), (35.5, 101), (55.4, 150), (55.5, 151), (125.4, 200), (125.5, 201), (225.4, 300), (225.5, 301), (325.4, 500), (500.0, 848)])
def test_index_breakpoints(spark, v, index):
    assert one(spark, air.pm25_index(air.tenths(F.lit(v)))) == index


@pytest.mark.parametrize(("v", "shown"), [(0.2, "1"), (9.6, "10"), (10.01, "10+"), (3.49, "3"), (3.5, "4"), (6.5, "7"), (10.0, "10")])
def test_health_index_display(spark, v, shown):
    assert one(spark, air.health_index_display(F.lit(v))) == shown


def test_hectares(spark):
    assert one(spark, air.hectares(F.lit(10.0))) == pytest.approx(4.047)


@pytest.mark.parametrize(("unit", "good"), [("µg/m³", True), ("μg/m³", True), ("UG/M3", True), ("ppm", False), ("ppb", False)])
def test_mass_units(spark, unit, good):
    assert bool(one(spark, air.is_mass_unit(F.lit(unit)))) is good


@pytest.mark.parametrize(("t", "value"), [(0.0, 20.0), (0.5, 60.0), (1.0, 100.0)])
def test_blend(spark, t, value):
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, air.blend(F.lit(20.0), F.lit(100.0), F.lit(t), yes, yes)) == pytest.approx(value)
    assert one(spark, air.blend(F.lit(20.0), F.lit(100.0), F.lit(t), yes, no)) == 20.0
    assert one(spark, air.blend(F.lit(20.0), F.lit(100.0), F.lit(t), no, no)) is None


@pytest.mark.parametrize(("v", "label"), [(0.8, "<1"), (7.24, "7.2"), (19.6, "20"), (250.0, "250+")])
def test_concentration_label(spark, v, label):
    assert one(spark, text.concentration_label(F.lit(v))).startswith(label)


def test_newest_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 2, 3), ("b", 1, 1)], "k string, t int, v int")
    assert {(r["k"], r["v"]) for r in series.newest(df, "k", "t", F.asc("v")).collect()} == {("a", 3), ("b", 1)}


def test_missing_hours_of_gapped_series(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 7)], "k string, hour int")
    assert {(r["k"], r["hour"]) for r in series.missing_hours(df, "k", "hour").collect()} == {("a", 2), ("a", 3)}


def test_last_good_keeps_payload(spark):
    now = spark.createDataFrame([("a", True, "new"), ("b", False, None), ("c", False, None)], "source string, ok boolean, payload string")
    before = spark.createDataFrame([("b", "old")], "source string, payload string")
    got = {r["source"]: (r["status"], r["payload"]) for r in quality.last_good(now, before, "source", "payload").collect()}
    assert got["a"] == ("ok", "new") and got["b"] == ("stale", "old") and got["c"] == ("unavailable", None)


def test_within_matches_brute_force(spark):
    points = [(i, -120 + (i * 7 % 31) * 0.9, 35 + (i * 11 % 29) * 0.7) for i in range(60)]
    left = spark.createDataFrame(points, "a int, lon double, lat double")
    right = spark.createDataFrame([(i, x + 0.1, y - 0.1) for i, x, y in points], "b int, r_lon double, r_lat double")

    def km(x0, y0, x1, y1):
        p, q = math.radians(y0), math.radians(y1)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x1 - x0) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {(i, j) for i, x, y in points for j, u, v in points if km(x, y, u + 0.1, v - 0.1) <= 90}
    assert want and {(r["a"], r["b"]) for r in spatial.within(left, right, 90).collect()} == want


def test_clusters_need_a_strictly_nearer_founder(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 1), (1, 2, 40.0, 0.0, 2)], "g int, id int, x double, y double, ord int")
    assert len({r["cluster"] for r in spatial.greedy_clusters(df, "g", 40.0).collect()}) == 2
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 1), (1, 2, 70.0, 0.0, 2), (1, 3, 35.0, 0.0, 3)], "g int, id int, x double, y double, ord int")
    by = {r["id"]: r["cluster"] for r in spatial.greedy_clusters(df, "g", 60.0).collect()}
    assert by[3] == by[1] != by[2]


def test_page_has_one_row_more(spark):
    df = spark.range(10)
    assert [r["id"] for r in ranking.page(df, "id", 3, 2).collect()] == [4, 5, 6]


def test_top_ignores_values_that_are_not_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", float("nan")), ("d", None), ("e", 3.0)], "k string, v double")
    assert [r["k"] for r in ranking.top(df, 5, "v", F.asc("k")).collect()] == ["e", "a"]


def test_snapshots_appear_only_when_published(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.current() == {}
    first = store.publish({"t": spark.range(3)})
    assert store.current()["t"].count() == 3
    assert store.publish({"t": spark.range(5)}) != first
    assert store.current()["t"].count() == 5


def test_station_records_keep_good_rows(spark):
    body = """[
      {"Parameter":"PM2.5","Latitude":40.0,"Longitude":-100.0,"AQI":50,"Value":9.0,"Unit":"UG/M3","UTC":"2024-07-15T18:00","FullAQSCode":"840010010001","SiteName":"A","AgencyName":"X"},
      {"Parameter":"OZONE","Latitude":40.0,"Longitude":-100.0,"AQI":99,"Value":9.0,"Unit":"PPB","UTC":"2024-07-15T19:00","FullAQSCode":"840010010001","SiteName":"A","AgencyName":"X"},
      {"Parameter":"PM2.5","Latitude":95.0,"Longitude":-100.0,"AQI":50,"Value":9.0,"Unit":"UG/M3","UTC":"2024-07-15T18:00","FullAQSCode":"840010010002","SiteName":"B","AgencyName":"X"}]"""
    raw = spark.createDataFrame([(body,)], "body string")
    got = payloads.station_records(raw, "body", F.lit("2024-07-15 20:00:00").cast("timestamp")).collect()
    assert len(got) == 1


def test_core_does_not_import_the_corpus_operators():
    import pathlib

    for path in pathlib.Path(registry.__file__).parents[1].rglob("*.py"):
        if path.parent.name != "llm":
            assert "hazeframe.llm" not in path.read_text()


def test_stations_merge_in_reading_order(spark):
    """Chains and equal ids, against a plain walk over a list."""
    import random

    rng = random.Random(4)
    step = 0.00125  # degrees of latitude: about 139 metres, so only neighbours in a chain are near
    rows = [(f"s{rng.randint(0, 45)}", f"Plant {'north' if rng.random() < 0.9 else 'south'}", -100.0, 40 + step * rng.randint(0, 40), rng.choice(["airnow", "bcair"]), "epa", float(rng.choice([-10, 5, 30, 60, 119, 150, 200])), n) for n in range(120)]
    rows = [(i, name, x, y, source, system, age, source != "airnow", n) for i, name, x, y, source, system, age, n in rows]
    df = spark.createDataFrame(rows, "id string, name string, lon double, lat double, source string, system string, age_min double, local boolean, ord long")

    def same(a, b):
        near = math.radians(abs(a[3] - b[3])) * 6371000 <= 150
        return a[0] == b[0] or (a[4] != b[4] and near and a[1] == b[1])

    kept = []
    for row in rows:
        place = next((n for n, other in enumerate(kept) if same(other, row)), None)
        if place is None:
            kept.append(row)
            continue
        old = kept[place]
        was, now = 0 <= old[6] <= 120, 0 <= row[6] <= 120
        if now and not was or was == now and (row[7] and not old[7] or row[7] == old[7] and row[6] < old[6] or old[7] and not row[7] and row[6] < old[6]):
            kept[place] = row
    assert 20 < len(kept) < 110
    assert sorted(r["ord"] for r in spatial.merge_stations(df).collect()) == sorted(r[8] for r in kept)


def test_nearest_matches_brute_force_and_has_no_limit(spark):
    left = spark.createDataFrame([(i, -140 + i * 37 % 280 * 1.0, -70 + i * 53 % 140 * 1.0) for i in range(80)], "a int, lon double, lat double")
    right = spark.createDataFrame([(i, -130 + i * 3.0, 40 + i % 5 * 1.0) for i in range(25)], "b int, r_lon double, r_lat double")
    pairs = left.crossJoin(right).withColumn("km", spatial.geo.kilometres(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))).collect()
    want = {}
    for r in pairs:
        want[r["a"]] = min(want.get(r["a"], (math.inf, 0)), (r["km"], r["b"]))
    assert {r["a"]: (r["km"], r["b"]) for r in spatial.nearest(left, right, "a", "b").collect()} == want
    assert spatial.nearest(left, right.limit(0), "a", "b").collect() == []


def test_clipped_lines_match_a_walk(spark):
    rows = registry.QUERIES["R25_clipped_lines"](spark, SF).collect()
    points = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").orderBy("event_id").collect():
        points.setdefault(r[0], []).append((r[1] * 7919 % 16000 / 100 - 170, r[1] * 104729 % 8500 / 100))
    want = []
    for user, line in points.items():
        pieces, end = [], None
        for (x0, y0), (x1, y1) in zip(line, line[1:]):
            low, high = 0.0, 1.0
            for p, q in ((x0 - x1, x0 + 145), (x1 - x0, -45 - x0), (y0 - y1, y0 - 10), (y1 - y0, 72 - y0)):
                if p == 0:
                    high = -1.0 if q < 0 else high
                elif p < 0:
                    low = max(low, q / p)
                else:
                    high = min(high, q / p)
            if low > high:
                end = None
                continue
            a, b = (x0 + low * (x1 - x0), y0 + low * (y1 - y0)), (x0 + high * (x1 - x0), y0 + high * (y1 - y0))
            if end is None or low > 0:
                pieces.append([a])
            pieces[-1].append(b)
            end = b if high == 1.0 else None
        want += [(user, n + 1, k + 1, x, y) for n, piece in enumerate(pieces) for k, (x, y) in enumerate(piece)]
    got = sorted((r["user_id"], r["piece"], r["seq"], r["x"], r["y"]) for r in rows)
    assert len(got) == len(want) > 500
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5)


def test_rings_match_a_plain_clip(spark):
    got = {r["c_custkey"]: (r["corners"], r["area"]) for r in registry.QUERIES["R21_clipped_rings"](spark, SF).collect()}
    for k, (corners, area) in got.items():
        ring = [(-150.0 + k * 7 % 110 + dx, k * 3 % 75 + dy + 0.0) for dx, dy in ((0, 0), (12, 0), (6, 9))]
        for axis, edge, sign in ((0, -145, 1), (0, -45, -1), (1, 10, 1), (1, 72, -1)):
            out = []
            for n, p in enumerate(ring):
                q = ring[n - 1]
                if ((p[axis] - edge) * sign >= 0) != ((q[axis] - edge) * sign >= 0):
                    t = (edge - q[axis]) / (p[axis] - q[axis])
                    out.append(tuple(q[i] + (p[i] - q[i]) * t for i in (0, 1)))
                if (p[axis] - edge) * sign >= 0:
                    out.append(p)
            ring = out
        assert corners == len(ring)
        assert area == pytest.approx(abs(sum(ring[n - 1][0] * p[1] - p[0] * ring[n - 1][1] for n, p in enumerate(ring))) / 2, abs=1e-5)


def test_placed_labels_match_a_walk(spark):
    from hazeframe.plans import feeds

    tables = registry.Tables(spark, SF)
    want = []
    by = {}
    for r in feeds.label_rows(tables).collect():
        by.setdefault(r["screen"], []).append(r)
    for screen, rows in by.items():
        taken, counted = [], 0
        for r in sorted(rows, key=lambda r: (*r["priority"], not r["retained"], r["id"])):
            if r["counts"] and counted >= 12:
                continue
            if all(abs(r["x"] - o["x"]) >= 64 or abs(r["y"] - o["y"]) >= 20 for o in taken):
                taken.append(r)
                counted += r["counts"]
        want += [(screen, r["id"]) for r in taken]
    assert sorted((r["screen"], r["id"]) for r in registry.QUERIES["W15_placed_labels"](spark, SF).collect()) == sorted(want)


def test_bounded_sources_match_a_walk(spark):
    from hazeframe.plans import feeds

    by, want = {}, []
    for r in feeds.source_rows(registry.Tables(spark, SF)).orderBy("ord").collect():
        by.setdefault(r["client"], []).append(r)
    for client, rows in by.items():
        seen, frames, groups = set(), {}, {}
        for r in rows:
            if r["key"] in seen:
                continue
            seen.add(r["key"])
            own = frames.setdefault(r["surface"], [])
            if r["frame"] not in own:
                own.append(r["frame"])
            if own.index(r["frame"]) < 3:
                groups.setdefault((r["grp"] or r["key"]) if r["optional"] else r["key"], []).append(r)
        used = 0
        for group in sorted(groups.values(), key=lambda g: (min(r["rank"] for r in g), g[0]["ord"])):
            size = sum(r["bytes"] for r in group)
            if any(not r["optional"] for r in group) or used + size <= 9000:
                used += size
                want += [(client, r["key"]) for r in group]
    assert sorted((r["client"], r["key"]) for r in registry.QUERIES["R32_bounded_sources"](spark, SF).collect()) == sorted(want)


def test_missing_assets_are_a_partial_failure(spark, tmp_path):
    from hazeframe.sources import files

    (tmp_path / "a").write_text('{"id": "a", "name": "n", "agency": "g", "lon": -100.0, "lat": 40.0, "observedAt": "2024-01-01T00:00:00Z", "category": "Good", "aqi": 12, "concentration": 3, "unit": "ug/m3"}\n{"id": ""}\n')
    rows, outcomes = files.monitor_assets(spark, [("airnow", f"file://{tmp_path}/a"), ("bcair", f"file://{tmp_path}/b")])
    assert [(r["indexSystem"], r["indexValue"]) for r in rows.collect()] == [("us-epa-pm25-aqi", 12.0)]
    assert [r["ok"] for r in outcomes.collect()] == [True, False]
    with pytest.raises(ValueError, match="no monitor asset"):
        files.monitor_assets(spark, [("bcair", f"file://{tmp_path}/b")])


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    from hazeframe.streaming import hourly

    for n, hours in enumerate(((0, 30), (29,), (1, 31), (60,))):  # hour 1 comes two batches after hour 30 was seen
        df = spark.createDataFrame([("s", h, float(h)) for h in hours], "station string, h int, value double")
        df.select("station", F.timestamp_seconds(F.col("h") * 3600).alias("at"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = "station string, at timestamp, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    hours = hourly.hourly_last(hourly.on_time(stream, "at", "12 hours"), "station", "at", "value", "at")
    hourly.drained(hours, f"{tmp_path}/sink", f"{tmp_path}/checkpoint")
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/sink/*").collect()) == [0.0, 29.0, 30.0, 31.0]

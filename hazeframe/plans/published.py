"""Queries over published assets, health, keyed streams, publication and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import clock
from hazeframe.operators import catalog, contract, frames, quality, ranking, raster, reconcile, series, snapshot, spatial, temporal
from hazeframe.operators.staging import scratch, spread
from hazeframe.plans.contracts import VALID_SQL, monitors
from hazeframe.plans.domain import CELLS_SQL, HOUR_SQL, cells, readings
from hazeframe.plans.rasters import LUT_SQL
from hazeframe.plans.registry import query
from hazeframe.plans.sources import _streamed
from hazeframe.sources import assets, payloads, stations
from hazeframe.streaming import hourly, keyed

SIZE = 200  # items of an envelope
FOLDER = 50  # envelopes of a folder
FIRST_FOLDER = 10**12  # folder numbers are of one width, so their names sort as they do


def _write_envelopes(rows, items: str, item, path: str, extra=None, body=None) -> None:
    """rows (asset, an integer; n) as files of at most SIZE items below path/asset=<asset>, in the order of n; count is
    what the file holds plus `extra`, and `body` may replace a file's text.

    A row of the last step is a file. FOLDER files share a folder, so that neither the commit nor the listing of the
    files goes by a folder a file; rows meet by folder before items are made, in one shuffle of narrow rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("n") / SIZE)
    dealt = rows.withColumn("folder", FIRST_FOLDER + F.floor(part / FOLDER)).repartition(parts, "asset", "folder").select("asset", "folder", part.alias("part"), "n", item.alias("item"))
    text = F.concat(F.lit('{"count":'), F.count(F.lit(1)) + (F.lit(0) if extra is None else extra), F.lit(f',"{items}":['), F.array_join(F.array_sort(F.collect_list(F.struct("n", "item")))["item"], ","), F.lit("]}"))
    files = dealt.groupBy("asset", "folder", "part").agg((text if body is None else body(text)).alias("value"))
    files.sortWithinPartitions("asset", "folder", "part").drop("part").write.option("maxRecordsPerFile", 1).partitionBy("asset", "folder").text(path)


@query("S34_monitor_envelopes", f"WITH {VALID_SQL} SELECT c_custkey % 2 AS precedence, count(*) AS n FROM good WHERE valid GROUP BY 1")
def monitor_envelopes(t):
    """Monitors of two assets of many files each; a third asset is not there, which is a partial failure."""
    root = scratch(t.spark)
    rows = monitors(t)
    item = F.to_json(F.struct(*[c for c in rows.columns if c != "c_custkey"]))
    _write_envelopes(rows.withColumn("n", F.col("c_custkey")).withColumn("asset", (F.col("n") % 2).cast("int")), "monitors", item, root)
    got, _ = assets.monitors(t.spark, [("airnow", f"{root}/asset=0"), ("bcair", f"{root}/asset=1"), ("sinaica", f"{root}/asset=none")])
    return got.groupBy(F.col("precedence").cast("long").alias("precedence")).agg(F.count(F.lit(1)).alias("n"))


@query("S35_asset_outcomes", """
SELECT c_mktsegment AS source, CASE WHEN c_mktsegment = 'BUILDING' THEN 'count' WHEN c_mktsegment = 'MACHINERY' THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE count(*) END AS found FROM customer GROUP BY 1 UNION ALL SELECT 'none', 'missing', 0""")
def asset_outcomes(t):
    """What became of each asset: one states a wrong count, one is broken JSON, one is not there."""
    root = scratch(t.spark)
    names = [r[0] for r in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five segments
    is_one = lambda name: F.col("asset") == (names.index(name) if name in names else -1)
    rows = t.customer.select(F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment")).cast("int").alias("place"), "c_custkey").select((F.col("place") - 1).alias("asset"), F.col("c_custkey").alias("n"), "c_custkey")
    _write_envelopes(rows, "monitors", F.to_json(F.struct("c_custkey")), root, F.when(is_one("BUILDING"), 1).otherwise(0), lambda text: F.when(is_one("MACHINERY"), '{"monitors":[').otherwise(text))
    _, outcomes = assets.envelopes(t.spark, [*((name, f"{root}/asset={n}") for n, name in enumerate(names)), ("none", f"{root}/asset=none")], "monitors")
    return outcomes.select("source", "status", "found")


@query("S36_incident_envelopes", "SELECT 'i' || (o_orderkey % 500) AS id, max_by(floor(o_totalprice), (o_orderkey % 2, o_orderkey))::DOUBLE AS hectares FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def incident_envelopes(t):
    """Incidents of two assets; of an id the last valid one by asset, file and place wins."""
    root = scratch(t.spark)
    k = F.col("o_orderkey")
    body = F.struct(F.concat(F.lit("i"), k % 500).alias("id"), F.lit("fire").alias("name"), F.when(k % 11 != 0, "US").otherwise("XX").alias("country"), F.lit(-120.0).alias("lon"), F.lit(45.0).alias("lat"), F.lit("active").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"), F.lit("https://x").alias("sourceUrl"), F.floor("o_totalprice").cast("double").alias("areaHectares"))
    rows = t.orders.select((k % 2).cast("int").alias("asset"), k.alias("n"), "o_orderkey", "o_totalprice")
    _write_envelopes(rows, "incidents", F.to_json(body), root)
    got, _ = assets.incidents(t.spark, [("wfigs", f"{root}/asset=0"), ("cwfis", f"{root}/asset=1")])
    return got.select("id", F.col("areaHectares").alias("hectares"))


@query("S15_surviving_incidents", "SELECT 'incidents' AS part, TRUE AS ok, NULL::VARCHAR AS message, (SELECT count(DISTINCT o_orderkey % 700) FROM orders) AS incidents, 0 AS rings UNION ALL SELECT 'perimeters', FALSE, 'cut short', (SELECT count(DISTINCT o_orderkey % 700) FROM orders), 0")
def surviving_incidents(t):
    """The last page of the perimeters never came: the incidents stand, without rings."""
    key = F.col("o_orderkey") % 700
    few = t.orders.groupBy(key.alias("g")).agg(F.max("o_totalprice").alias("acres"))
    feature = F.struct(F.struct(F.col("g").cast("string").alias("IrwinID"), F.lit("fire").alias("IncidentName"), F.col("acres").alias("IncidentSize")).alias("attributes"), F.struct(F.lit(-120.0).alias("x"), F.lit(45.0).alias("y")).alias("geometry"))
    bodies = few.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))
    ring = F.array(F.array(F.array(F.lit(-120.0), F.lit(45.0)), F.array(F.lit(-119.0), F.lit(45.0)), F.array(F.lit(-119.0), F.lit(46.0))))
    shape = F.struct(F.struct(F.col("g").alias("OBJECTID"), F.lit("WF").alias("attr_IncidentTypeCategory")).alias("attributes"), F.struct(ring.alias("rings")).alias("geometry"))
    perimeters = few.select(F.to_json(F.struct(F.lit(True).alias("exceededTransferLimit"), F.array(shape).alias("features"))).alias("body"))
    known, rings, outcomes = payloads.fire_parts(bodies, perimeters, "body")
    counts = known.agg(F.count(F.lit(1)).alias("incidents")).join(rings.agg(F.count(F.lit(1)).cast("int").alias("rings")), how="cross")
    return outcomes.join(counts, how="cross")  # one row of counts


@query("R16_mask_labels", """
WITH c AS (SELECT event_id, (event_id * 37 % 256)::INT AS r, (event_id * 59 % 256)::INT AS g, (event_id * 83 % 256)::INT AS b, (event_id % 20)::INT AS a, event_id % 3 AS near FROM events),
p AS (SELECT event_id, a, CASE WHEN near = 0 THEN 32 + event_id % 30 WHEN near = 1 THEN 71 ELSE r END AS r, CASE WHEN near = 0 THEN 96 WHEN near = 1 THEN 166 - event_id % 50 ELSE g END AS g, CASE WHEN near = 0 THEN 176 WHEN near = 1 THEN 139 ELSE b END AS b FROM c),
d AS (SELECT event_id, a, abs(r - 32) + abs(g - 96) + abs(b - 176) AS d1, abs(r - 208) + abs(g - 88) + abs(b - 48) AS d2, abs(r - 71) + abs(g - 166) + abs(b - 139) AS d3 FROM p)
SELECT event_id, (CASE WHEN a < 8 OR least(d1, d2, d3) >= 36 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END)::INT AS code FROM d""")
def mask_labels(t):
    """Source of mask pixels near and far from the known colours, some too faint to count."""
    k = F.col("event_id")
    pick = lambda first, second, m: F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(k * m % 256).cast("int")
    r, g, b = pick(32 + k % 30, F.lit(71), 37), pick(F.lit(96), 166 - k % 50, 59), pick(F.lit(176), F.lit(139), 83)
    return t.events.select("event_id", raster.mask_label(r, g, b, (k % 20).cast("int")).alias("code"))


@query("R15_colour_values", f"""
WITH {LUT_SQL}, v AS (SELECT 0 AS index, 0.0::DOUBLE AS value UNION ALL SELECT (1 + n * 24 + k)::INT, lo + (hi - lo) * (k / 23.0::DOUBLE) FROM steps),
c AS (SELECT p_partkey, (p_partkey * 37 % 256)::INT AS red, (p_partkey * 59 % 256)::INT AS green, (p_partkey * 83 % 256)::INT AS blue, (p_partkey * 3 % 256)::INT AS alpha FROM part),
d AS (SELECT p_partkey, c.alpha AS own, index, abs(c.red - lut.red) + abs(c.green - lut.green) + abs(c.blue - lut.blue) + abs(c.alpha - lut.alpha) AS apart FROM c, lut),
b AS (SELECT p_partkey, own, min_by(index, (apart, index)) AS index FROM d GROUP BY ALL)
SELECT p_partkey, CASE WHEN own >= 8 THEN index END AS index, CASE WHEN own >= 8 THEN round(value, 6) END AS value FROM b JOIN v USING (index)""")
def colour_values(t):
    """Concentration of a colour by its nearest palette entry; none where the pixel hardly shows."""
    k = F.col("p_partkey")
    got = raster.colour_value(*[(k * m % 256).cast("int") for m in (37, 59, 83, 3)])
    return spread(t.part.select("p_partkey")).select("p_partkey", got["index"].alias("index"), F.round(got["value"], 6).alias("value"))


_STATES = ["ok", "stale", "error", "unavailable"]


@query("A15_health_reports", """
WITH e AS (SELECT event_id AS k FROM events), s AS (SELECT k, CASE WHEN k % 13 <> 0 THEN k % 50 END AS beat, CASE WHEN k % 13 <> 0 AND k % 6 <> 0 THEN k % 47 END AS fc, k % 13 = 0 AS nostatus, k % 17 = 0 AS nomanifest,
  CASE WHEN k % 17 <> 0 AND k % 5 <> 0 THEN k % 20 WHEN k % 13 <> 0 THEN k % 9 END AS ahead, ['fresh', 'retained', 'unavailable'][k % 3 + 1] AS integrated, 7 + k % 2 AS version, k % 4 AS one, k % 7 AS two FROM e),
i AS (SELECT *, list_filter([CASE WHEN nostatus THEN 'invalid-status' END, CASE WHEN nomanifest THEN 'invalid-manifest' END, CASE WHEN NOT nomanifest AND version <> 8 THEN 'unexpected-version' END, CASE WHEN beat > 30 THEN 'stale-heartbeat' END,
  CASE WHEN fc IS NULL OR fc > 30 THEN 'stale-forecast' END, CASE WHEN ahead IS NULL OR ahead < 6 THEN 'insufficient-forecast-coverage' END, CASE WHEN NOT nomanifest AND integrated = 'unavailable' THEN 'forecast-unavailable' END], lambda x: x IS NOT NULL) AS fatal,
  list_filter([CASE WHEN NOT nomanifest AND one <> 0 THEN 'source-airnow-' || ['ok', 'stale', 'error', 'unavailable'][one + 1] END, CASE WHEN NOT nomanifest AND two <> 0 THEN 'source-hrrr-' || CASE WHEN two > 3 THEN 'missing' ELSE ['ok', 'stale', 'error', 'unavailable'][two + 1] END END], lambda x: x IS NOT NULL) AS later FROM s)
SELECT k AS event_id, array_to_string(list_concat(fatal, later), ',') AS issues, CASE WHEN len(fatal) > 0 THEN 'unhealthy' WHEN len(later) > 0 OR k % 8 = 0 OR integrated = 'retained' THEN 'degraded' ELSE 'healthy' END AS verdict FROM i""")
def health_reports(t):
    """Reports over run statuses and manifests, some of them unreadable."""
    k = F.col("event_id")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    shifted = lambda minutes: F.timestamp_seconds(F.unix_timestamp(now) + minutes * 60)
    status = F.when(k % 13 != 0, F.struct(shifted(-(k % 50)).alias("lastAttemptAt"), F.when(k % 6 != 0, shifted(-(k % 47))).alias("lastCompleteForecastAt"), shifted(k % 9 * 60).alias("forecastLastValidTime"), F.when(k % 8 == 0, "retained").otherwise("fresh").alias("outcome")))
    of = lambda n: F.element_at(F.array(*map(F.lit, _STATES)), (n + 1).cast("int"))
    states = F.map_from_entries(F.filter(F.array(F.struct(F.lit("airnow").alias("key"), of(k % 4).alias("value")), F.struct(F.lit("hrrr").alias("key"), F.when(k % 7 <= 3, of(F.least(k % 7, F.lit(3)))).alias("value"))), lambda e: e["value"].isNotNull()))
    manifest = F.when(k % 17 != 0, F.struct((7 + k % 2).alias("version"), F.element_at(F.array(*map(F.lit, ("fresh", "retained", "unavailable"))), (k % 3 + 1).cast("int")).alias("integratedStatus"), F.when(k % 5 != 0, shifted(k % 20 * 60)).alias("lastValidTime"), states.alias("states")))
    rows = t.events.select("event_id", status.alias("s"), manifest.alias("m"))
    got = quality.health_report(now, 15, F.col("s"), F.col("m"), ["airnow", "hrrr"], F.lit(8))
    return rows.select("event_id", got.alias("h")).select("event_id", F.array_join("h.issues", ",").alias("issues"), "h.verdict")


@query("T06_closed_hours", f"""
WITH h AS (SELECT user_id::INT AS station, {HOUR_SQL} AS hour, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT * FROM h WHERE (hour + 1) * 60.0 <= (SELECT date_diff('minute', TIMESTAMP '1970-01-01', max(ts)) FROM events) - 720""")
def closed_hours(t):
    """The stream in append mode: an hour is written once, when the watermark, 12 hours behind the newest row, has passed it."""
    where = scratch(t.spark)
    stream = hourly.hourly_last(hourly.on_time(_streamed(t), "at", "12 hours"), "station", "at", "value", "at", "event_id")
    hourly.drained(stream, f"{where}/sink", f"{where}/checkpoint")
    out = t.spark.read.schema(stream.schema).parquet(f"{where}/sink/*")
    return out.select("station", series.hour_index(F.col("hour")).alias("hour"), "value")


@query("T07_streamed_amendments", f"SELECT station, hour, kind, event_id FROM (SELECT user_id::INT AS station, {HOUR_SQL} AS hour, event_type AS kind, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY station ORDER BY hour DESC, kind = 'purchase' DESC, event_id) = 1")
def streamed_amendments(t):
    """The newest reading of each station kept by a stream; an amendment (purchase) replaces its original."""
    where = scratch(t.spark)
    table = keyed.KeyedTable(t.spark, f"{where}/state", "station", "station int, hour int, kind string, event_id long")
    rows = _streamed(t).select("station", series.hour_index(F.col("ts")).alias("hour"), F.col("event_type").alias("kind"), "event_id")
    keyed.amended(rows, table, f"{where}/checkpoint", F.col("hour"), F.col("kind") == "purchase", -F.col("event_id"))
    return table.read()


@query("T12_streamed_polls", """
WITH e AS (SELECT user_id, event_id, event_type AS seen, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id FROM e WHERE before IS NULL OR before <> seen""")
def streamed_polls(t):
    """Polls whose publication changed, over batches, with the last one of each client as state."""
    where = scratch(t.spark)
    table = keyed.KeyedTable(t.spark, f"{where}/state", "user_id", "user_id long, event_id long, event_type string")
    rows = _streamed(t).select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type")
    keyed.changed(rows, table, f"{where}/sink", f"{where}/checkpoint", "event_id", "event_type")
    return t.spark.read.schema(table.schema).parquet(f"{where}/sink/*").select("user_id", "event_id")


@query("T01_published_batches", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def published_batches(t):
    """The stream published as snapshots, numbered by batch; the newest one read back."""
    where = scratch(t.spark)
    store = snapshot.SnapshotStore(t.spark, f"{where}/store")
    hourly.published(_streamed(t).select("event_type", "event_id"), store, "events", f"{where}/checkpoint", None).awaitTermination()
    return store.current()["events"].groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("T11_reconciled")
def reconciled(t):
    """Four runs over the events as stored objects, a changing third of them referred to; what waits at the end.

    Each run goes on from the state before, so SQL cannot express it; tested against plain Python.
    """
    where = scratch(t.spark)
    known = readings(t.events).select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "assets/").otherwise("frames/"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json")).alias("path"))
    store = reconcile.Reconciler(t.spark, where, ("assets", "frames"), reconcile.Limits(grace=7200.0, pending=5000, page=2000, delete=500))
    gone = None
    for run in range(4):
        left = known if gone is None else known.join(gone, "path", "left_anti")
        out = store.run(left, known.where(F.col("event_id") % 3 == run % 3), 3600.0 * (run + 1))
        gone = out.deleted.select("path") if gone is None else gone.unionByName(out.deleted.select("path"))
    return store.state(3600.0 * 5)[0].select("path", F.col("seen").cast("long").alias("seen"))


@query("S11_station_series", """
WITH s AS (SELECT c_custkey AS id, ['America/Tijuana', 'America/Hermosillo', 'America/Mexico_City'][c_custkey % 3 + 1] AS zone, [-8, -7, -6][c_custkey % 3 + 1] AS shift FROM customer),
h AS (SELECT id, unnest(generate_series(0, 13)) AS age FROM s WHERE id % 11 <> 0), k AS (SELECT id, age FROM h WHERE (id + age) % 9 <> 0 AND NOT (id % 7 = 0 AND age < 4)),
l AS (SELECT id, min(age) AS newest FROM k GROUP BY id)
SELECT s.id, CASE WHEN newest IS NULL THEN 'failed' WHEN newest > 2 THEN 'stale' WHEN (SELECT count(*) FROM k WHERE k.id = s.id AND age < 3) < 2 THEN 'sparse' ELSE 'ok' END AS outcome FROM s LEFT JOIN l USING (id)""")
def station_series(t):
    """Two days of hours of each station as the provider writes them, to monitors and outcomes."""
    k = F.col("c_custkey")
    now = F.lit("2024-01-15 18:00:00").cast("timestamp")
    zone = F.element_at(F.array(*map(F.lit, ("America/Tijuana", "America/Hermosillo", "America/Mexico_City"))), (k % 3 + 1).cast("int"))
    own = t.customer.select(k.alias("id"), zone.alias("zone"), F.col("c_name").alias("name"), F.lit("a").alias("agency"), F.lit(-100.0).alias("lon"), F.lit(20.0).alias("lat"))
    hours = own.where("id % 11 <> 0").select("id", "zone", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("age")).where("(id + age) % 9 <> 0 AND NOT (id % 7 = 0 AND age < 4)")
    local = F.from_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(now) - F.col("age") * 3600), F.col("zone"))
    row = F.struct((5 + F.col("id") % 40).cast("string").alias("valor"), F.date_format(local, "yyyy-MM-dd").alias("fecha"), F.hour(local).cast("string").alias("hora"))
    bodies = hours.groupBy("id").agg(F.concat(F.lit("var dat = "), F.to_json(F.collect_list(row)), F.lit(";")).alias("body"))
    _, outcomes = stations.monitors(bodies, own, now)
    return outcomes


@query("K02_monitor_envelopes", """
WITH i AS (SELECT c_custkey // 200 AS part, c_custkey AS k, '{"id":' || c_custkey || ',"name":"' || c_name || '"}' AS item FROM customer),
p AS (SELECT part, '{"count":' || count(*) || ',"monitors":[' || string_agg(item, ',' ORDER BY k) || '],"sourceCount":' || count(*) || '}' AS payload FROM i GROUP BY part)
SELECT part, 'assets/' || left(sha256(payload), 20) || '/monitors.json' AS path, strlen(payload) AS bytes FROM p""")
def monitor_documents(t):
    """Monitors as published documents with their counts, addressed by content."""
    rows = t.customer.select(F.floor(F.col("c_custkey") / 200).alias("part"), F.col("c_custkey").alias("k"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("item"))
    return snapshot.envelopes(rows, "part", "item", "k", "monitors", 1_000_000).select("part", "path", F.col("bytes").cast("long").alias("bytes"))


@query("K10_status_document", "SELECT (SELECT count(*) FROM events) AS rows, (SELECT max(event_id) FROM events) AS newest, 'fresh' AS outcome, TRUE AS told")
def status_document(t):
    """The status of a run, replaced in place and read back."""
    root = scratch(t.spark)
    folder = snapshot.Folder(t.spark, root)
    snapshot.write_status(folder, t.spark.createDataFrame([("old", 1)], "outcome string, rows long"))
    told = snapshot.write_status(folder, t.events.agg(F.lit("fresh").alias("outcome"), F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("newest")))
    return t.spark.read.schema("rows long, newest long, outcome string").json(f"{root}/status.json").withColumn("told", F.lit(told))


@query("J03_stored_fields", f"""
WITH h AS (SELECT {HOUR_SQL} AS valid, max(event_id) AS a, min(event_id) AS b FROM events GROUP BY 1)
SELECT valid, 'f' || a AS first, CASE WHEN valid % 3 <> 0 THEN 's' || b END AS second, CASE WHEN valid % 3 <> 0 THEN (valid // 6)::INT END AS second_run FROM h""")
def stored_fields(t):
    """The fields of both models for every hour; the second one only where a run covers it."""
    per = readings(t.events).groupBy(F.col("hour").alias("valid")).agg(F.max("event_id").alias("a"), F.min("event_id").alias("b"))
    run = F.floor(F.col("valid") / 6).cast("int")
    hours = per.select("valid", F.when(F.col("valid") % 3 != 0, run).alias("second_run"))
    first = per.select(F.explode(F.array(F.lit("r1"), F.lit("r0"))).alias("run"), "valid", "a").select("run", "valid", F.concat(F.when(F.col("run") == "r1", "f").otherwise("old"), "a").alias("field"))
    second = per.select(F.explode(F.array(run, run - 1)).alias("run"), "valid", run.alias("own"), "b").select("run", "valid", F.concat(F.when(F.col("run") == F.col("own"), "s").otherwise("old"), "b").alias("field"))
    return temporal.paired_fields(hours, first, second, "r1")


@query("V07_reusable_results", """
SELECT l_orderkey, l_linenumber, l_linenumber % 7 <> 0 AND l_returnflag = 'N' AND l_linestatus = 'O' AND (l_orderkey % 4 = 0) AND l_linenumber % 5 <> 0 AS reusable FROM lineitem""")
def reusable_results(t):
    """Previous results that may stand: whole, of the same versions, and without a version for the source that is off."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    before = F.when(n % 7 != 0, F.struct(F.col("l_returnflag").alias("palette"), F.col("l_linestatus").alias("policy"), F.when(k % 4 != 0, "v1").alias("off"), F.when(n % 5 == 0, F.lit(True)).alias("incomplete")))
    return t.lineitem.select("l_orderkey", "l_linenumber", contract.reusable(before, {"palette": F.lit("N"), "policy": F.lit("O"), "off": None}).alias("reusable"))


@query("S41_least_stations", "WITH g AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 20 <= 12), n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey FROM g, n WHERE (SELECT count(*) FROM g) >= n.n // 4")
def least_stations(t):
    """Cached stations, if a quarter of all at least are still good."""
    rows = t.supplier.select("s_suppkey", F.lit("p1").alias("parser"), F.when(F.col("s_suppkey") % 3 != 0, "sig").otherwise("old").alias("signature"), (100 - F.col("s_suppkey") % 20).alias("hour"))
    return contract.cached_set(rows, "p1", F.lit("sig"), F.lit(100), t.supplier.count() // 4).select("s_suppkey")


@query("S33_landmark_faults", """
WITH l AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN 'X' ELSE 'Q' END || (p_partkey - CASE WHEN p_partkey % 89 = 0 THEN 1 ELSE 0 END) AS qid, ['CAN', 'USA', 'MEX', 'FRA'][CASE WHEN p_partkey % 83 = 0 THEN 4 ELSE p_partkey % 3 + 1 END] AS country,
  ['natural', 'park', 'cultural'][p_partkey // 3 % 3 + 1] AS category, (p_partkey // 3 % 21)::INT AS rank, CASE WHEN p_partkey % 79 = 0 THEN 10.0 ELSE -100.0 END AS lon FROM part),
k AS (SELECT *, country <> 'FRA' AS known, rank BETWEEN 1 AND 20 AS ranked FROM l), c AS (SELECT unnest(['CAN', 'USA', 'MEX']) AS country),
g AS (SELECT country, rank, count(*) AS n FROM k WHERE known AND ranked GROUP BY ALL)
SELECT qid AS subject, unnest(list_filter([CASE WHEN qid LIKE 'X%' THEN 'id' END, CASE WHEN NOT known THEN 'classification' END, CASE WHEN NOT ranked THEN 'rank' END, CASE WHEN lon > 0 THEN 'place' END], lambda x: x IS NOT NULL)) AS rule FROM k
UNION ALL SELECT qid, 'repeated id' FROM k GROUP BY qid HAVING count(*) > 1
UNION ALL SELECT country || ':' || rank, 'repeated rank' FROM g WHERE n > 1
UNION ALL SELECT c.country || ':' || r, 'missing rank' FROM c, generate_series(1, 20) s(r) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.country = c.country AND g.rank = r)
UNION ALL SELECT c.country || ':' || category, 'category count' FROM c, (VALUES ('natural', 7), ('park', 7), ('cultural', 6)) v(category, due) WHERE due <> (SELECT count(*) FROM k WHERE k.country = c.country AND k.category = v.category AND known)""")
def landmark_faults(t):
    """A list far too long with all sorts of faults."""
    k = F.col("p_partkey")
    third = F.floor(k / 3)
    one = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int"))
    rows = t.part.select(F.concat(F.when(k % 97 == 0, "X").otherwise("Q"), k - F.when(k % 89 == 0, 1).otherwise(0)).alias("qid"), one(("CAN", "USA", "MEX", "FRA"), F.when(k % 83 == 0, 4).otherwise(k % 3 + 1)).alias("country"), one(("natural", "park", "cultural"), third % 3 + 1).alias("category"), (third % 21).cast("int").alias("rank"), F.when(k % 79 == 0, 10.0).otherwise(-100.0).alias("lon"), F.lit(45.0).alias("lat"))
    return catalog.landmark_faults(rows, ["CAN", "USA", "MEX"])


@query("S40_checked_hours", """
WITH q AS (SELECT o_orderkey, (o_orderkey % 60 - 5)::INT AS hour FROM orders),
c AS (SELECT l_orderkey, count_if(l_linenumber % 3 <> 0) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, hour, CASE WHEN hour NOT BETWEEN 0 AND 48 THEN 'hour' WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 7 * 20 > 60 THEN 'valid-time' WHEN coalesce(n, 0) = 0 THEN 'cells' END AS fault FROM q LEFT JOIN c ON l_orderkey = o_orderkey""")
def checked_hours(t):
    """Every order as a forecast hour with its line items as cells."""
    k = F.col("o_orderkey")
    run = F.timestamp_seconds(F.lit(1704067200) + k * 86400)  # a run of its own for each order
    asked = t.orders.select(run.alias("run"), F.timestamp_seconds(F.unix_timestamp(run) + (k % 60 - 5) * 3600).alias("valid"), "o_orderkey")
    fields = asked.where("o_orderkey % 17 <> 0").select("run", "valid", F.timestamp_seconds(F.unix_timestamp("valid") + F.col("o_orderkey") % 7 * 20).alias("stated"))
    values = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).otherwise(float("nan")).alias("value"))
    got = catalog.native_hours(asked.select("run", "valid"), fields, asked.join(values, "o_orderkey").select("run", "valid", "value"))
    return got.select(((F.unix_timestamp("run") - 1704067200) / 86400).cast("long").alias("o_orderkey"), "hour", "fault")


@query("K04_published_frames", """
WITH p AS (SELECT DISTINCT l_linenumber::INT AS hour, (l_partkey % 16)::INT AS tile, (l_suppkey % 9)::INT AS py, (l_partkey // 16 % 9)::INT AS px FROM lineitem),
b AS (SELECT hour, tile, left(sha256(string_agg(((hour + px * py) % 5) || ':' || (px % 4), ',' ORDER BY py, px)), 20) AS h FROM p WHERE hour > 2 GROUP BY ALL)
SELECT hour, FALSE AS reused, string_agg('assets/' || h || '/best-' || (tile % 4) || '-' || (tile // 4), ' ' ORDER BY tile) AS paths FROM b GROUP BY hour UNION ALL SELECT hour, TRUE, 'old' FROM (SELECT DISTINCT l_linenumber::INT AS hour FROM lineitem WHERE l_linenumber <= 2)""")
def published_frames(t):
    """Tiles of every hour as addressed assets; the frames of two hours are reused."""
    rows = t.lineitem.select(F.col("l_linenumber").cast("int").alias("hour"), (F.col("l_partkey") % 16).cast("int").alias("tile"), (F.col("l_suppkey") % 9).cast("int").alias("py"), (F.floor(F.col("l_partkey") / 16) % 9).cast("int").alias("px")).distinct()
    tiles = rows.select("hour", "tile", "py", "px", ((F.col("hour") + F.col("px") * F.col("py")) % 5).alias("index"), (F.col("px") % 4).alias("code"))
    old = rows.select("hour").distinct().select("hour", F.array(F.struct(F.lit(0).alias("column"), F.lit(0).alias("row"), F.lit("old").alias("path"))).alias("tiles"))
    got = frames.published(tiles, old, old.where("hour <= 2").select("hour"), 4)
    return got.select("hour", "reused", F.array_join("tiles.path", " ").alias("paths"))


@query("R09_detail_frames", f"""
WITH {CELLS_SQL}, w AS (SELECT cx AS x, cy AS y, first, second, (cx % 5) / 4.0 AS weight, (cx + cy) % 9 <> 0 AS covered FROM cells WHERE cx < 63 AND cy < 39),
m AS (SELECT x, y, CASE WHEN covered THEN CASE WHEN first IS NOT NULL AND second IS NOT NULL THEN first + weight * greatest(second - first, 0) WHEN first IS NOT NULL THEN first ELSE second END END AS v,
  CASE WHEN NOT covered THEN 0 WHEN first IS NOT NULL AND second > first AND weight > 0 THEN 3 WHEN first IS NOT NULL THEN 1 WHEN second IS NOT NULL THEN 2 ELSE 0 END AS code FROM w),
s AS (SELECT *, unnest(list_filter([CASE WHEN y < 20 THEN 0 END, CASE WHEN y >= 19 THEN 1 END], lambda k: k IS NOT NULL)) AS r FROM m), q AS (SELECT *, unnest(list_filter([CASE WHEN x < 32 THEN 0 END, CASE WHEN x >= 31 THEN 1 END], lambda k: k IS NOT NULL)) AS c FROM s)
SELECT 'base' AS part, (x // 2)::INT AS px, (y // 2)::INT AS py, floor(v * 1000 + 0.3217::DOUBLE)::BIGINT AS value_milli, code FROM m WHERE x % 2 = 0 AND y % 2 = 0
UNION ALL SELECT r || '-' || c, (x - c * 31)::INT, (y - r * 19)::INT, floor(v * 1000 + 0.3217::DOUBLE)::BIGINT, code FROM q""")
def detail_frames(t):
    """Base raster and four tiles of one merged detail grid."""
    grid = cells(t.lineitem).where("cx < 63 AND cy < 39").withColumnsRenamed({"cx": "x", "cy": "y"})
    base, tiles = raster.detail_frame(grid, F.col("first"), F.col("second"), (F.col("x") % 5) / 4.0, (F.col("x") + F.col("y")) % 9 != 0, 32, 20)
    milli = F.floor(F.col("value") * 1000 + 0.3217).alias("value_milli")
    rows = tiles.select(F.concat_ws("-", "tile_row", "tile_column").alias("part"), "px", "py", milli, "code")
    return base.select(F.lit("base").alias("part"), F.col("x").alias("px"), F.col("y").alias("py"), milli, "code").unionByName(rows)


def incident_points(t):
    """Orders as incidents on screens of some 200, placed by their ids."""
    k = F.col("o_orderkey")
    rows = t.orders.select(F.floor(k / 800).alias("screen"), k.alias("id"), F.concat(F.when(k % 2 == 0, "US:").otherwise("CA:"), k).alias("name"), (k * 73 % 1280).cast("double").alias("x"), (k * 151 % 720).cast("double").alias("y"))
    return ranking.numbered(rows, "screen", F.asc("name")).withColumnRenamed("rank", "ord")


@query("R29_incident_clusters")
def incident_clusters(t):
    """Incidents of a screen in the order of their ids; order decides, so SQL cannot express it."""
    return spatial.greedy_clusters(incident_points(t), "screen", 60.0)


@query("D06_canonical_hours", "SELECT event_id, unnest(generate_series(0, 36)) + ((date_diff('day', DATE '1970-01-01', ts::DATE) * 24 + hour(ts))) AS hour FROM events")
def canonical_hours(t):
    """The hours of an outlook that begins with each event."""
    hours = F.explode(clock.canonical_hours(F.col("ts").cast("timestamp"), 36))
    return t.events.select("event_id", hours.alias("at")).select("event_id", (F.unix_timestamp("at") / 3600).cast("long").alias("hour"))


@query("D07_normalised_times", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate + to_hours((o_orderkey % 24 - CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 0 END)::BIGINT), '%Y-%m-%dT%H:00:00Z') END AS at FROM orders""")
def normalised_times(t):
    k = F.col("o_orderkey")
    own = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    text = F.when(k % 4 == 0, F.concat(own, F.lit("Z"))).when(k % 4 == 1, F.concat(own, F.lit("+02:00"))).when(k % 4 == 2, own).otherwise("soon")
    return t.orders.select("o_orderkey", clock.normalised_iso(text).alias("at"))


@query("W11_outlooks", "SELECT o_orderkey, o_orderkey % 7 IN (0, 1) OR o_orderkey % 5 NOT IN (1, 2, 3) AS kept FROM orders")
def outlooks(t):
    """Runs with every hour, one hour short, one hour off, out of order, without frames, and unavailable."""
    k = F.col("o_orderkey")
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    due = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda h: clock.iso(F.timestamp_seconds(start + h * 3600)))
    off = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda h: clock.iso(F.timestamp_seconds(start + h * 3600 + F.when(h == 5, 60).otherwise(0))))
    times = F.when(k % 7 == 0, F.slice(due, 1, 0)).when(k % 5 == 1, F.slice(due, 1, 12)).when(k % 5 == 2, off).when(k % 5 == 3, F.reverse(due)).otherwise(due)
    generated = clock.iso(F.timestamp_seconds(start + 1800))
    return t.orders.select("o_orderkey", contract.canonical_outlook(generated, times, F.when(k % 7 == 1, "unavailable").otherwise("fresh"), 12).alias("kept"))

"""Queries over contracts: validators, manifest rules, fallbacks, retention, publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import geo, text
from hazeframe.operators import contract, quality
from hazeframe.operators.staging import spread
from hazeframe.plans.domain import HOUR_SQL, readings
from hazeframe.plans.registry import query


def monitors(t):
    """Customers as monitor rows, each eleventh or so with one defect."""
    k = F.col("c_custkey")
    health = k % 7 == 0
    rows = t.customer.select(
        F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("m"), k)).alias("id"), F.col("c_name").alias("name"), F.lit("agency").alias("agency"),
        F.when(k % 29 == 0, 10.0).otherwise(-100.0).alias("lon"), F.lit(45.0).alias("lat"), F.when(k % 23 == 0, "soon").otherwise("2024-01-01T00:00:00Z").alias("observedAt"),
        F.when(health, "Low").when(k % 19 == 0, "Fine").otherwise("Good").alias("category"), F.when(health, contract.HEALTH).when(k % 5 != 0, contract.EPA).alias("indexSystem"),
        F.when(k % 5 != 0, (k % 50).cast("double")).alias("indexValue"), F.lit(None).cast("string").alias("indexMethod"), (k % 50).cast("double").alias("aqi"), F.when(k % 17 == 0, "guess").otherwise("provider").alias("aqiMethod"),
        F.when(k % 13 != 0, F.lit(4.0)).alias("concentration"), F.lit(None).cast("double").alias("nowcastConcentration"), F.lit("ug/m3").alias("unit"), F.when(health, "aqhi").otherwise("airnow").alias("source"), F.lit(None).cast("string").alias("sourceUrl"), F.when(health, "CA").otherwise("US").alias("country"), k,
    )
    return rows


VALID_SQL = """
m AS (SELECT *, c_custkey AS k, c_custkey % 7 = 0 AS health, CASE WHEN c_custkey % 7 = 0 THEN 'ca-aqhi' WHEN c_custkey % 5 <> 0 THEN 'us-epa-pm25-aqi' END AS sys, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 50)::DOUBLE END AS v FROM customer),
good AS (SELECT *, (k % 31 <> 0 AND k % 29 <> 0 AND k % 23 <> 0 AND k % 17 <> 0 AND
  CASE WHEN health THEN k % 5 <> 0 AND k % 50 > 0 ELSE k % 13 <> 0 AND k % 19 <> 0 END) AS valid FROM m)"""


@query("P14_valid_monitors", f"WITH {VALID_SQL} SELECT c_custkey, valid FROM good")
def valid_monitors(t):
    return monitors(t).select("c_custkey", contract.valid_monitor().alias("valid"))


@query("M24_normalised_monitors", f"WITH {VALID_SQL} SELECT c_custkey, CASE WHEN sys IS NULL OR v IS NULL THEN 'us-epa-pm25-aqi' ELSE sys END AS system, CASE WHEN sys IS NULL OR v IS NULL THEN (k % 50)::DOUBLE ELSE v END AS value FROM good WHERE valid")
def normalised_monitors(t):
    """What a monitor asset gives: valid rows, legacy ones normalised (S34)."""
    got = contract.normalised(monitors(t).where(contract.valid_monitor()))
    return got.select("c_custkey", F.col("indexSystem").alias("system"), F.col("indexValue").alias("value"))


@query("P13_monitors_of_mode", f"WITH {VALID_SQL} SELECT c_custkey, sys = 'ca-aqhi' OR NOT health AS local, coalesce(sys, 'us-epa-pm25-aqi') = 'us-epa-pm25-aqi' AS comparable FROM good WHERE valid")
def of_mode(t):
    got = contract.normalised(monitors(t).where(contract.valid_monitor()))
    return got.select("c_custkey", contract.in_mode("local").alias("local"), contract.in_mode("comparable").alias("comparable"))


@query("P15_valid_incidents", "SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS valid FROM orders")
def valid_incidents(t):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.concat(F.lit("i"), k).alias("id"), F.lit("fire").alias("name"), F.when(k % 3 == 0, "MX").otherwise("CA").alias("country"), F.lit(-120.0).alias("lon"), F.when(k % 5 == 0, 95.0).otherwise(50.0).alias("lat"), F.lit("out").alias("status"), F.when(k % 7 != 0, "2024-02-03T04:05:06Z").alias("updatedAt"), F.lit("https://host/x").alias("sourceUrl"), F.when(k % 11 == 0, -1.0).when(k % 2 == 0, 7.0).alias("areaHectares"))
    return rows.select("o_orderkey", contract.valid_incident().alias("valid"))


def manifests(t):
    """Suppliers as manifests in JSON: every k-th breaks one rule, for k of a few primes. A supplier of a few bytes becomes
    a manifest of a hundred thousand, so they are dealt over all tasks first."""
    k = F.col("s_suppkey")
    time = lambda h: F.concat(F.lit("2024-01-0"), (1 + F.floor(h / 24)).cast("string"), F.lit("T"), F.lpad((h % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    state = F.struct(F.lit("ok").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("checkedAt"), F.when(k % 13 == 0, "ftp://x").otherwise("https://x").alias("provenance"))
    names = F.when(k % 7 == 0, F.array(*map(F.lit, contract.SOURCES[:-1]))).otherwise(F.array(*map(F.lit, contract.SOURCES)))
    tile = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.when(k % 11 == 0, F.floor(i / 4)).otherwise(i % 4).cast("int").alias("column"), F.when(k % 11 == 0, i % 4).otherwise(F.floor(i / 4)).cast("int").alias("row"), F.lit("/d").alias("textureUrl"), F.lit("/m").alias("sourceMaskUrl")))
    contributors = F.when(k % 19 == 0, F.array(F.lit("hrrr"), F.lit("hrrr"))).otherwise(F.array(F.lit("hrrr"), F.lit("firework")))
    hour = lambda i: F.when((k % 17 == 0) & (i == 5), 4).otherwise(i)
    frames = F.transform(F.sequence(F.lit(0), F.lit(36)), lambda i: F.struct(time(hour(i)).alias("validTime"), F.lit("/t").alias("textureUrl"), F.lit("/m").alias("sourceMaskUrl"), F.transform(contributors, lambda s: F.struct(s.alias("source"))).alias("contributors"), tile.alias("detailTiles")))
    best = F.struct(frames.alias("frames"), F.lit("fresh").alias("integratedStatus"), F.when(k % 23 == 0, 24).otherwise(36).alias("horizonHours"), F.lit("2024-01-01T00:00:00Z").alias("modelRun"), F.lit("/legend").alias("legendUrl"), *[F.lit(v).alias(n) for n, v in contract.POLICY.items()], F.lit(200).alias("featherDistanceKm"))
    bare = F.struct(F.array(F.struct(time(F.lit(0)).alias("validTime"), F.when(k % 3 == 0, "/t").alias("textureUrl"))).alias("frames"), F.lit("2024-01-01T00:00:00Z").alias("modelRun"))
    sets = F.create_map(F.lit("aqhi"), F.struct(F.lit("/a").alias("url"), F.lit("2024-01-01T00:00:00Z").alias("observedAt"), F.when(k % 29 == 0, 0).otherwise(9).alias("count"), F.lit(contract.COUNT_VERSION).alias("countVersion")))
    body = F.struct(F.lit(8).alias("version"), F.when(k % 5 == 0, "test").otherwise("live").alias("mode"), F.lit("2024-01-01T00:00:00Z").alias("generatedAt"), F.struct(*[F.lit(v).alias(n) for n, v in zip(("west", "east", "south", "north"), geo.FORECAST_BOX, strict=True)]).alias("bounds"), F.map_from_arrays(names, F.transform(names, lambda _: state)).alias("sources"), F.struct(sets.alias("monitorSets")).alias("air"), best.alias("forecast"), F.struct(best.alias("best"), bare.alias("hrrr"), F.when(k % 31 != 0, bare).alias("firework")).alias("forecasts"))
    return spread(t.supplier.select("s_suppkey")).select("s_suppkey", F.to_json(body).alias("body")).select("s_suppkey", F.from_json("body", contract.MANIFEST).alias("m")).select("s_suppkey", "m.*")


V01_SQL = """
WITH r AS (SELECT s_suppkey AS k, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'mode' END, CASE WHEN k % 7 = 0 THEN 'sources-complete' END, CASE WHEN k % 13 = 0 THEN 'source-state' END, CASE WHEN k % 29 = 0 THEN 'health-set' END,
  CASE WHEN k % 11 = 0 THEN 'best:tiles' END, CASE WHEN k % 17 = 0 THEN 'best:times' END, CASE WHEN k % 19 = 0 THEN 'best:contributors' END, CASE WHEN k % 23 = 0 THEN 'best:horizon' END,
  CASE WHEN k % 3 = 0 THEN 'hrrr:no-textures' END, CASE WHEN k % 3 = 0 AND k % 31 <> 0 THEN 'firework:no-textures' END, CASE WHEN k % 31 = 0 THEN 'models' END], lambda x: x IS NOT NULL)) AS rule FROM supplier)"""


@query("V01_manifest_rules", V01_SQL + " SELECT k AS s_suppkey, rule FROM r")
def manifest_rules(t):
    """Broken rules of whole manifests, forecast runs included (V02)."""
    return quality.violations(manifests(t), "s_suppkey", contract.manifest_rules())


@query("V03_valid_manifests", V01_SQL + " SELECT s_suppkey, s_suppkey NOT IN (SELECT k FROM r) AS valid FROM supplier")
def valid_manifests(t):
    every = F.lit(True)
    for ok in contract.manifest_rules().values():
        every = every & F.coalesce(ok, F.lit(False))
    return manifests(t).select("s_suppkey", every.alias("valid"))


@query("V04_normalised_manifests", "SELECT s_suppkey, 37 AS best, 1 AS hrrr, CASE WHEN s_suppkey % 31 = 0 THEN 0 ELSE 1 END AS firework, 'fresh' AS status FROM supplier")
def normalised_manifests(t):
    got = contract.normalised_manifest(manifests(t))
    return got.select("s_suppkey", *[F.size(f"forecasts.{m}.frames").alias(m) for m in ("best", "hrrr", "firework")], F.col("forecast.integratedStatus").alias("status"))


@query("U06_monitor_urls", "SELECT s_suppkey, '/a' AS url FROM supplier")
def monitor_urls(t):
    return contract.monitor_urls(manifests(t), "s_suppkey", "local")


@query("J22_frame_runs", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'h' ELSE 'own' END AS hrrr, 'own' AS firework FROM supplier")
def frame_runs(t):
    own = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.struct(F.lit("hrrr").alias("source"), F.lit("h").alias("modelRun"))))
    frame = F.struct(F.lit("own").alias("modelRun"), own.alias("contributors"))
    return t.supplier.select("s_suppkey", contract.frame_run(frame, F.lit("hrrr")).alias("hrrr"), contract.frame_run(frame, F.lit("firework")).alias("firework"))


@query("T04_fallbacks", """
WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'firework' WHEN event_id % 3 = 1 THEN 'airnow' ELSE 'wfigs' END AS source, event_id % 5 <> 0 AS had, CASE WHEN event_id % 7 <> 0 THEN event_id % 24 END AS age, event_id % 11 <> 0 AS ahead, event_id % 13 = 0 AS key_missing FROM events),
f AS (SELECT *, source = 'firework' AND had AND NOT ahead AS expired, CASE source WHEN 'firework' THEN 18 WHEN 'airnow' THEN 2 ELSE 6 END AS top FROM e)
SELECT k AS event_id, CASE WHEN expired THEN 'unavailable' WHEN had THEN CASE WHEN age IS NULL OR age > top THEN 'stale' ELSE 'error' END WHEN key_missing THEN 'unavailable' ELSE 'error' END AS status, had AND NOT expired AS retained FROM f""")
def fallbacks(t):
    k = F.col("event_id")
    source = F.when(k % 3 == 0, "firework").when(k % 3 == 1, "airnow").otherwise("wfigs")
    got = contract.fallback(source, k % 5 != 0, k % 5 != 0, F.when(k % 7 != 0, k % 24), k % 11 != 0, k % 13 == 0)
    return t.events.select("event_id", got.alias("f")).select("event_id", "f.status", "f.retained")


@query("T05_retained_runs", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN 'retained' ELSE 'unavailable' END AS status, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN 37 ELSE 0 END AS frames FROM supplier")
def retained_runs(t):
    k = F.col("s_suppkey")
    got = manifests(t).select("s_suppkey", contract.retained_run(F.col("forecasts.best"), k % 2 == 0, F.when(k % 3 == 0, 5).otherwise(50), F.lit(10)).alias("r"))
    return got.select("s_suppkey", F.col("r.integratedStatus").alias("status"), F.size("r.frames").alias("frames"))


@query("P11_latest_plausible", """
WITH e AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 YEAR WHEN event_id % 7 = 0 THEN TIMESTAMP '1999-01-01' ELSE ts END AS seen FROM events)
SELECT user_id, epoch(date_trunc('second', coalesce(max(CASE WHEN year(seen) > 2000 AND seen <= TIMESTAMP '2024-02-01 00:05:00' THEN seen END), TIMESTAMP '2024-02-01 00:00:00')))::BIGINT AS latest FROM e GROUP BY user_id""")
def latest_plausible(t):
    ts = F.col("ts").cast("timestamp")
    at = F.when(F.col("event_id") % 5 == 0, ts + F.expr("interval 10 years")).when(F.col("event_id") % 7 == 0, F.lit("1999-01-01").cast("timestamp")).otherwise(ts)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = contract.latest_plausible(t.events.select("user_id", at.alias("at")), "user_id", "at", now, now)
    return got.select("user_id", F.unix_timestamp("latest").alias("latest"))


@query("A08_prior_counts", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS known, s_suppkey AS counted FROM supplier")
def prior_counts(t):
    k = F.col("s_suppkey")
    sets = F.create_map(F.lit("aqhi"), F.struct(k.alias("count"), F.when(k % 2 == 0, "v1").otherwise("v0").alias("countVersion")))
    rows = t.supplier.select("s_suppkey", sets.alias("sets"))
    return rows.select("s_suppkey", contract.prior_count(F.col("sets"), "aqhi", "v1").alias("known"), contract.prior_count(F.col("sets"), "aqhi").alias("counted"))


@query("T12_changed_polls", """
WITH e AS (SELECT user_id, event_id, event_type AS seen, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id FROM e WHERE before IS NULL OR before <> seen""")
def changed_polls(t):
    """Polls of a pointer whose publication key (T13) is another than at the poll before."""
    polls = t.events.select("user_id", "event_id", contract.publication_key("event_type").alias("key"))
    return contract.changed(polls, "user_id", "event_id", "key").select("user_id", "event_id")


@query("T13_publication_keys", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS key FROM part""")
def publication_keys(t):
    return t.part.select("p_partkey", contract.publication_key("p_brand", "p_size").alias("key"))


@query("A19_protected_paths", "SELECT DISTINCT 'context/assets/' || (o_custkey % 100) || '.json' AS path FROM orders WHERE o_custkey % 3 = 0")
def protected(t):
    k = F.col("o_custkey")
    url = F.concat(F.when(k % 3 == 0, "https://host/context/assets/").otherwise("https://host/other/"), k % 100, F.lit(".json?v=1"))
    docs = t.orders.select(F.to_json(F.struct(F.struct(url.alias("textureUrl"), F.lit("plain").alias("name")).alias("frame"))).alias("body"))
    return contract.protected_paths(docs, "body", text.asset_path)


@query("F17_url_leaves", "SELECT o_orderkey, 'https://h/' || o_orderkey || ',/m' AS urls FROM orders")
def url_leaves(t):
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("https://h/"), "o_orderkey").alias("url"), F.lit("x").alias("curl")).alias("a"), F.array(F.struct(F.lit("/m").alias("maskUrl"))).alias("b")))
    return t.orders.select("o_orderkey", F.array_join(text.url_leaves(body), ",").alias("urls"))


@query("J19_publish_or_reuse", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus AND l_quantity <= 16 AND l_quantity >= 16 THEN 'reuse' ELSE 'publish' END AS action FROM lineitem")
def publish_or_reuse(t):
    rows = t.lineitem.withColumn("tiles", F.col("l_quantity").cast("int"))
    return contract.reuse_or_publish(rows, [("l_returnflag", "l_linestatus")], "tiles").select("l_orderkey", "l_linenumber", "action")


@query("S41_cached_stations", f"WITH m AS (SELECT max({HOUR_SQL}) AS now FROM events) SELECT event_id FROM events, m WHERE event_id % 2 = 0 AND event_type = 'view' AND now - {HOUR_SQL} <= 12")
def cached_stations(t):
    now = readings(t.events).agg(F.max("hour").alias("now"))  # one row
    rows = readings(t.events).select("event_id", "hour", F.col("kind").alias("signature"), F.when(F.col("event_id") % 2 == 0, "p2").otherwise("p1").alias("parser"))
    return contract.cached(rows.crossJoin(F.broadcast(now)), "p2", F.lit("view"), F.col("now")).select("event_id")


@query("V08_issue_texts", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Fires were not published.' WHEN 1 THEN 'Sky failed to update.' WHEN 2 THEN 'Sky is stale.' WHEN 3 THEN 'The scheduled data update is late.' ELSE 'An automatic data-health check reported a problem.' END AS text FROM events""")
def issue_texts(t):
    k = F.col("event_id") % 5
    issue = F.when(k == 0, "source-wfigs-missing").when(k == 1, "source-hrrr-error").when(k == 2, "source-hrrr-stale").when(k == 3, "stale-heartbeat").otherwise("other")
    return t.events.select("event_id", contract.issue_text(issue, F.when(k == 0, "Fires").otherwise("Sky")).alias("text"))


@query("T14_playback_phases", """
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
    CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'pause' WHEN 'purchase' THEN 'endpoint' WHEN 'signup' THEN 'ready' ELSE 'interaction' END AS kind, event_id % 2 = 0 AS ready FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 'idle' AS phase FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT s.user_id, e.n, CASE
    WHEN kind = 'play' THEN CASE WHEN ready THEN 'playing' ELSE 'buffering' END
    WHEN kind = 'pause' AND phase IN ('playing', 'buffering') THEN 'manual-paused'
    WHEN kind = 'interaction' AND phase IN ('playing', 'buffering') THEN 'interaction-paused'
    WHEN kind = 'ready' AND phase = 'buffering' THEN 'playing'
    WHEN kind = 'endpoint' AND phase = 'playing' THEN 'waiting' ELSE phase END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, arg_max(phase, n) AS phase FROM s GROUP BY user_id""")
def playback_phases(t):
    """Phase of each user's playback after all events, folded in order."""
    kind = F.when(F.col("event_type") == "view", "play").when(F.col("event_type") == "click", "pause").when(F.col("event_type") == "purchase", "endpoint").when(F.col("event_type") == "signup", "ready").otherwise("interaction")
    event = F.struct("event_id", kind.alias("type"), F.lit(True).alias("can_play"), F.lit(False).alias("at_end"), F.lit(False).alias("detail"), (F.col("event_id") % 2 == 0).alias("ready"), F.lit(None).cast("string").alias("phase"))
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(event)).alias("e")).select("user_id", contract.folded_phase(F.col("e")).alias("phase"))


@query("P17_lambert_grids", "SELECT p_partkey, p_size % 3 <> 0 AND abs(1799 - p_partkey % 600 - 1799) <= 400 AS ok FROM part")
def lambert_grids(t):
    return t.part.select("p_partkey", geo.lambert_grid_ok(F.lit(1799) - F.col("p_partkey") % 600, F.lit(1059), F.lit(21.1), F.when(F.col("p_size") % 3 != 0, F.lit(-122.7)).otherwise(F.lit(float("nan")))).alias("ok"))


@query("P18_geographic_grids", "SELECT p_partkey, p_size % 7 > 0 AND p_size % 7 <= 5 AND -170 + 19 * (p_size % 7) <= 180.5 AND -150 + 0 * p_size < -45 AND 80 - 9 * (p_size % 7) >= -90.5 AND -170 + 19 * (p_size % 7) >= -145 AND 80 - 9 * (p_size % 7) <= 72 AS ok FROM part")
def geographic_grids(t):
    step = (F.col("p_size") % 7).cast("double")
    return t.part.select("p_partkey", geo.geographic_grid_ok(F.lit(-170.0), F.lit(80.0), step, step, F.lit(20), F.lit(10)).alias("ok"))


@query("P20_safe_paths", "SELECT p_partkey, p_partkey % 4 = 0 AS ok, p_partkey < 1000000 AND p_partkey % 4 <> 1 AS number FROM part")
def safe_paths(t):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("context/"), k, F.lit(".json"))).when(k % 4 == 1, F.concat(F.lit("/x/"), k)).when(k % 4 == 2, F.concat(F.lit("a/../"), k)).otherwise(F.concat(F.lit("a//"), k))
    return t.part.select("p_partkey", text.safe_path(path).alias("ok"), text.station_number(F.when(k % 4 == 1, F.concat(F.lit("x"), k)).otherwise(k.cast("string"))).alias("number"))


@query("F14_list_signature", "SELECT c_nationkey, sha256(string_agg(c_custkey || chr(9) || c_name, chr(10) ORDER BY c_custkey)) AS signature FROM customer GROUP BY c_nationkey")
def signatures(t):
    entries = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    return t.customer.groupBy("c_nationkey").agg(text.list_signature(entries).alias("signature"))


@query("K02_monitor_counts", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS sources FROM customer")
def monitor_counts(t):
    """Counts that go with a published monitor table."""
    return t.customer.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("sources"))

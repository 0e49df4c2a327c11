"""Queries over snapshots: addressing, reuse, fallback, contract rules, sweeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.operators import quality, series, snapshot
from hazeframe.plans.domain import HOUR_SQL, readings
from hazeframe.plans.registry import query


@query("K01_addressed_assets", "SELECT 'assets/' || left(sha256(c_mktsegment), 20) || '.json' AS path, strlen(c_mktsegment) AS bytes FROM customer GROUP BY c_mktsegment")
def assets(t):
    return snapshot.addressed(t.customer, F.col("c_mktsegment")).select("path", F.col("bytes").cast("long").alias("bytes"))


@query("K03_canonical_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS body FROM nation""")
def canonical(t):
    return t.nation.select("n_nationkey", snapshot.canonical("n_regionkey", "n_name", "n_nationkey").alias("body"))


@query("J18_recompute", f"""
WITH n AS (SELECT {HOUR_SQL} AS hour, max(event_id) AS version FROM events GROUP BY 1), p AS (SELECT hour, CASE WHEN hour % 5 = 0 THEN NULL ELSE version - (hour % 2) END AS version FROM n WHERE hour % 7 <> 0)
SELECT n.hour, n.version FROM n LEFT JOIN p ON p.hour = n.hour WHERE p.hour IS NULL OR n.version IS DISTINCT FROM p.version""")
def recompute(t):
    now = readings(t.events).groupBy("hour").agg(F.max("event_id").alias("version"))
    before = now.where("hour % 7 <> 0").select("hour", F.when(F.col("hour") % 5 != 0, F.col("version") - F.col("hour") % 2).alias("version"))
    return snapshot.to_recompute(now, before, "hour", ["version"])


@query("T03_last_good", f"""
WITH n AS (SELECT (user_id % 50)::INT AS source, max({HOUR_SQL}) AS hour, (user_id % 50) % 3 <> 0 AS ok FROM events GROUP BY ALL), p AS (SELECT source, hour - 10 AS hour FROM n WHERE source % 2 = 0)
SELECT n.source, CASE WHEN ok THEN 'ok' WHEN p.source IS NOT NULL THEN 'stale' ELSE 'unavailable' END AS status, CASE WHEN ok THEN n.hour ELSE p.hour END AS hour FROM n LEFT JOIN p USING (source)""")
def last_good(t):
    now = t.events.groupBy((F.col("user_id") % 50).cast("int").alias("source")).agg(F.max(series.hour_index(F.col("ts"))).alias("hour")).withColumn("ok", F.col("source") % 3 != 0)
    before = now.where("source % 2 = 0").select("source", (F.col("hour") - 10).alias("hour"))
    return quality.last_good(now, before, "source", "hour")


@query("T11_sweep", f"""
WITH k AS (SELECT event_id, {HOUR_SQL} AS seen FROM events), m AS (SELECT max(seen) AS now FROM k)
SELECT event_id, seen FROM k, m WHERE event_id % 3 <> 0 AND now - seen >= 48 ORDER BY seen, event_id LIMIT 500""")
def sweep(t):
    known = readings(t.events).select("event_id", F.col("hour").alias("seen"))
    now = known.agg(F.max("seen")).first()[0] or 0
    return snapshot.sweep(known, known.where("event_id % 3 = 0"), "event_id", "seen", now, 48, 500)


@query("V01_violations", """
SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT o_totalprice < 300000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_custkey % 4 = 0 THEN 'customer' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def violations(t):
    return quality.violations(t.orders, "o_orderkey", {"price": F.col("o_totalprice") < 300000, "status": F.col("o_orderstatus").isin("O", "F"), "customer": F.col("o_custkey") % 4 != 0})


@query("A20_completeness", f"""
WITH h AS (SELECT DISTINCT {HOUR_SQL} AS hour FROM events WHERE event_type = 'purchase'), s AS (SELECT unnest(generate_series((SELECT min({HOUR_SQL}) FROM events), (SELECT max({HOUR_SQL}) FROM events)))::INT AS hour)
SELECT count(*) AS expected, count(h.hour) AS actual, array_to_string(list_sort(list(s.hour) FILTER (WHERE h.hour IS NULL)), ',') AS missing FROM s LEFT JOIN h USING (hour)""")
def completeness(t):
    hours = t.events.select("event_type", series.hour_index(F.col("ts")).alias("hour"))
    required = hours.agg(F.explode(F.sequence(F.min("hour"), F.max("hour"))).alias("hour"))
    got = quality.complete(hours.where("event_type = 'purchase'"), required, "hour")
    return got.select("expected", "actual", F.when(F.size("missing") > 0, F.array_join("missing", ",")).alias("missing"))  # none: null


@query("V06_versions_equal", "SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) IS NOT DISTINCT FROM ('A', 'F') AS reusable FROM lineitem")
def versions(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.struct("l_returnflag", "l_linestatus").eqNullSafe(F.struct(F.lit("A"), F.lit("F"))).alias("reusable"))

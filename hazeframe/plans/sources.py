"""Queries over raw payloads and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import clock
from hazeframe.operators.staging import scratch, spread
from hazeframe.plans.domain import HOUR_SQL
from hazeframe.plans.registry import query
from hazeframe.sources import files, payloads
from hazeframe.streaming import hourly, keyed


@query("S03_json_properties", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def properties(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("S03_station_records", """
SELECT 'S' || s_suppkey AS id, s_suppkey::DOUBLE AS value, (s_suppkey % 200)::INT AS aqi, 'US' AS country FROM supplier WHERE s_suppkey % 3 <> 0""")
def station_records(t):
    """JSON records built from suppliers, with ozone rows that the parser must drop."""
    k = F.col("s_suppkey")
    record = F.struct(F.when(k % 3 == 0, "OZONE").otherwise("PM2.5").alias("Parameter"), F.lit(40.0).alias("Latitude"), F.lit(-100.0).alias("Longitude"), (k % 200).alias("AQI"), k.cast("double").alias("Value"), F.lit("UG/M3").alias("Unit"), F.lit("2024-01-01T00:00:00").alias("UTC"), F.concat(F.lit("S"), k).alias("FullAQSCode"), F.lit("USA").alias("CountryCode"))
    raw = t.supplier.select(F.to_json(F.array(record)).alias("body"))
    return payloads.station_records(raw, "body", F.lit("2024-01-02").cast("timestamp")).select("id", "value", "aqi", "country")


@query("S08_html_links", """SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages""")
def links(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("S08_select_options", "SELECT n_nationkey, n_nationkey::VARCHAR AS value, n_name AS label FROM nation")
def select_options(t):
    html = F.concat(F.lit("<select id='other'><option value='x'>no</option></select><select id=\"estacion\"><option value=\""), "n_nationkey", F.lit("\">"), "n_name", F.lit("</option></select>"))
    return t.nation.select("n_nationkey", F.explode(payloads.options(html, "estacion")).alias("o")).select("n_nationkey", "o.value", "o.label")


@query("S09_json_literal", "SELECT n_nationkey, n_name AS name, n_regionkey AS v FROM nation")
def literal(t):
    body = F.concat(F.lit("<script>var x = [{\"name\":\""), "n_name", F.lit("\",\"v\":"), "n_regionkey", F.lit("}]; f(x)</script>"))
    rows = t.nation.select("n_nationkey", F.explode(payloads.json_literal(body, "array<struct<name:string,v:int>>")).alias("r"))
    return rows.select("n_nationkey", "r.name", "r.v")


@query("S14_fires", "SELECT 'F' || o_orderkey AS id, round(floor(o_totalprice) * 0.404685642, 3) AS hectares FROM orders WHERE o_orderkey % 10 <> 0")
def fires(t):
    """Feature collections built from orders, one in ten a prescribed burn."""
    k = F.col("o_orderkey")
    feature = F.struct(F.struct(k.alias("OBJECTID"), F.concat(F.lit("{F"), k, F.lit("}")).alias("IrwinID"), F.when(k % 10 == 0, "RX").otherwise("WF").alias("IncidentTypeCategory"), F.floor("o_totalprice").cast("double").alias("IncidentSize")).alias("attributes"), F.struct(F.lit(-120.0).alias("x"), F.lit(45.0).alias("y")).alias("geometry"))
    raw = t.orders.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))
    return payloads.fires(raw, "body").select("id", "hectares")


@query("S20_dimension_values", "SELECT n_nationkey, unnest(generate_series(0, n_nationkey)) * 3 AS hour FROM nation")
def dimension(t):
    spec = F.concat(F.lit("2024-01-01T00:00:00Z/"), F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01T00:00:00Z").cast("timestamp")) + F.col("n_nationkey") * 10800), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("/PT3H"))
    rows = t.nation.select("n_nationkey", F.explode(payloads.dimension_values(spec)).alias("at"))
    return rows.select("n_nationkey", ((F.unix_timestamp("at") - F.unix_timestamp(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))) / 3600).cast("long").alias("hour"))


@query("S25_newest_cycle", f"""
WITH f AS (SELECT ({HOUR_SQL} // 24) AS cycle, ({HOUR_SQL} % 24) AS hour FROM events)
SELECT max(cycle) AS cycle FROM (SELECT cycle FROM f GROUP BY cycle HAVING list_has_all(list(hour), [0, 12, 23]))""")
def cycle(t):
    from hazeframe.operators.series import hour_index

    h = hour_index(F.col("ts"))
    files = t.events.select(F.floor(h / 24).cast("int").alias("cycle"), (h % 24).cast("int").alias("hour"))
    return payloads.newest_cycle(files, "cycle", "hour", [0, 12, 23])


@query("D02_local_times", """
SELECT o_orderkey, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('day', o_orderdate)) + 8 + o_orderkey % 24 AS hour FROM orders""")
def local_times(t):
    """Times with a fixed offset in two spellings, as hours since the epoch."""
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), hour, F.lit(":00"))).otherwise(F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" "), hour, F.lit(":00")))
    at = clock.pacific_standard(text)
    day = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date"))
    return t.orders.select("o_orderkey", (day * 24 + F.hour(at)).cast("long").alias("hour"))


def _streamed(t):
    """The events file as a stream; time becomes a timestamp, which watermarks need."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp")).withColumn("station", F.col("user_id").cast("int"))


@query("T06_streamed_hours", f"""
SELECT user_id::INT AS station, {HOUR_SQL} AS hour, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def streamed_hours(t):
    """A stream drained into hourly last writes, in complete mode over the state store."""
    where = scratch(t.spark)
    stream = hourly.hourly_last(hourly.on_time(_streamed(t), "at", "40 days"), "station", "at", "value", "at", "event_id")
    hourly.drained(stream, f"{where}/sink", f"{where}/checkpoint", "complete")
    from hazeframe.operators.series import hour_index

    out = t.spark.read.schema(stream.schema).parquet(f"{where}/sink/*")
    return out.select("station", hour_index(F.col("hour")).alias("hour"), "value")


@query("T03_streamed_last_good", """
SELECT user_id::VARCHAR AS source, event_id AS run, CASE WHEN event_id % 3 <> 0 THEN 'ok' WHEN last(CASE WHEN event_id % 3 <> 0 THEN event_type END IGNORE NULLS) OVER w IS NULL THEN 'unavailable' ELSE 'stale' END AS status,
  last(CASE WHEN event_id % 3 <> 0 THEN event_type END IGNORE NULLS) OVER w AS payload FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def streamed_last_good(t):
    """Custom state: a failed outcome repeats its source's last good payload."""
    where = scratch(t.spark)
    outcomes = _streamed(t).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("run"), (F.col("event_id") % 3 != 0).alias("ok"), F.col("event_type").alias("payload"))
    table = keyed.KeyedTable(t.spark, f"{where}/state", "source", "source string, run long, payload string")
    keyed.last_good(outcomes, table, f"{where}/sink", f"{where}/checkpoint")
    return t.spark.read.schema("source string, run long, status string, payload string").parquet(f"{where}/sink/*")


@query("S04_health_index", "SELECT 'L' || c_custkey AS id, (1 + c_custkey % 9)::DOUBLE AS value, c_custkey % 5 = 0 AS amended FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0")
def health_index(t):
    """Feature collections built from customers: old, misplaced and superseded rows go."""
    k = F.col("c_custkey")
    at = F.when(k % 3 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-02T00:00:00Z")
    props = F.struct(F.concat(F.lit("L"), k).alias("location_id"), F.col("c_name").alias("location_name_en"), at.alias("observation_datetime"), F.when(k % 5 == 0, "amendment").otherwise("observation").alias("observation_type"), (1 + k % 9).cast("double").alias("aqhi"), (k % 7 != 0).alias("latest"))
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array(F.lit(-110.0), F.lit(50.0)).alias("coordinates")).alias("geometry"), props.alias("properties"))
    raw = t.customer.select(F.to_json(F.struct(F.lit(1).alias("numberMatched"), F.lit(1).alias("numberReturned"), F.array(feature).alias("features"))).alias("body"))
    return payloads.health_index(raw, "body", F.lit("2024-01-02T01:00:00Z").cast("timestamp")).select("id", "value", "amended")


@query("S07_csv_monitors", """
WITH p AS (SELECT max(o_orderkey) AS top FROM orders),
h AS (SELECT c_custkey AS id, unnest(generate_series(0, 11)) AS age FROM customer WHERE c_custkey % 4 <> 0)
SELECT 'E' || id AS id, 473376 AS hour, (id % 30 + 5)::DOUBLE AS nowcast FROM h GROUP BY id""")
def csv_monitors(t):
    """The provincial pair of CSV files, written from customers: 12 equal hours each, one station in four of another pollutant."""
    root = scratch(t.spark)
    k = F.col("c_custkey")
    customers = spread(t.customer.select("c_custkey"))
    hours = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("age"))
    local = F.timestamp_seconds(F.lit(473376 * 3600) - F.col("age") * 3600 - 8 * 3600)
    rows = hours.select(F.date_format(local, "yyyy-MM-dd HH:mm").alias("DATE_PST"), F.concat(F.lit("E"), k).alias("EMS_ID"), F.lit("n").alias("STATION_NAME"), F.when(k % 4 == 0, "O3").otherwise("PM25").alias("PARAMETER"), (k % 30 + 5).cast("string").alias("RAW_VALUE"), F.lit("ug/m3").alias("UNITS"), F.lit("50.0").alias("LATITUDE"), F.lit("-120.0").alias("LONGITUDE"))
    rows.write.csv(f"{root}/hourly", header=True)
    customers.select(F.concat(F.lit("E"), k).alias("EMS_ID"), F.lit("n").alias("STATION_NAME"), F.lit("o").alias("STATION_OWNER"), F.when(k % 2 == 0, "49.0").otherwise("0").alias("LATITUDE"), F.when(k % 2 == 0, "-121.0").otherwise("0").alias("LONGITUDE")).write.csv(f"{root}/stations", header=True)
    got = files.csv_monitors(t.spark, f"{root}/hourly", f"{root}/stations", 473376)
    return got.select("id", F.col("hour").cast("int").alias("hour"), "nowcast")


@query("J01_located", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN -121.0 ELSE -120.0 END::DOUBLE AS lon FROM customer")
def located(t):
    k = F.col("c_custkey")
    facts = t.customer.select(k.alias("id"), F.lit(-120.0).alias("lon"), F.lit(50.0).alias("lat"))
    dim = t.customer.where("c_custkey % 3 <> 0").select(k.alias("id"), F.when(k % 5 == 0, 0.0).otherwise(-121.0).alias("lon"), F.when(k % 5 == 0, 0.0).otherwise(49.0).alias("lat"))
    return files.located(facts, dim).select("id", "lon")


@query("S24_index_field", "SELECT count(*) > 0 AS found FROM part WHERE p_type LIKE '%BRASS'")
def index_field(t):
    k = F.col("p_partkey")
    lines = t.part.select(F.concat(k, F.lit(":0:d=2024010100:"), F.when(F.col("p_type").endswith("BRASS"), "MASSDEN:8 m above ground").otherwise("TMP:2 m above ground"), F.lit(":1 hour fcst:")).alias("value"))
    return payloads.has_field(lines)

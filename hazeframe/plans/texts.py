"""Queries over text, identity and hashing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeframe.functions import air, text
from hazeframe.plans.registry import query


@query("F01_clean_text", "SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 120) AS cleaned FROM documents")
def clean(t):
    return t.documents.select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("F03_search_key", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def search_key(t):
    return t.documents.select("doc_id", text.search_key(F.col("text")).alias("key"))


@query("F06_name_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 4))), ' ') AS tokens FROM part")
def name_tokens(t):
    return t.part.select("p_partkey", F.array_join(text.name_tokens(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))


@query("F08_concentration_label", """
WITH v AS (SELECT event_id, floor(value * 100) / 100 AS v FROM events)
SELECT event_id, CASE WHEN v < 1 THEN '<1' WHEN v >= 250 THEN '250+' WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5) / 10) ELSE floor(v + 0.5)::BIGINT::VARCHAR END AS label FROM v""")
def concentration(t):
    return t.events.select("event_id", text.concentration_label(F.floor(F.col("value") * 100) / 100).alias("label"))


@query("F09_lon_lat_label", """
WITH c AS (SELECT c_custkey, (c_custkey * 37 % 36000 - 18000) / 100.0::DOUBLE AS lon, (c_custkey * 53 % 18000 - 9000) / 100.0::DOUBLE AS lat FROM customer)
SELECT c_custkey, printf('%.2f', abs(lat)) || '° ' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || printf('%.2f', abs(lon)) || '° ' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS label FROM c""")
def lon_lat(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", text.lon_lat_label((k * 37 % 36000 - 18000) / 100.0, (k * 53 % 18000 - 9000) / 100.0).alias("label"))


@query("F10_country", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' usa ' WHEN 1 THEN '124' WHEN 2 THEN '' WHEN 3 THEN 'MEX' END AS code, CASE c_custkey % 3 WHEN 0 THEN 'cc' WHEN 1 THEN 'MX' ELSE '' END AS state, CASE WHEN c_custkey % 2 = 0 THEN '840' || lpad(c_custkey::VARCHAR, 9, '0') ELSE '06-' || lpad(c_custkey::VARCHAR, 6, '0') END AS id FROM customer)
SELECT c_custkey, coalesce(CASE upper(trim(coalesce(code, ''))) WHEN 'USA' THEN 'US' WHEN '124' THEN 'CA' WHEN 'MEX' THEN 'MX' END, CASE upper(state) WHEN 'CC' THEN 'CA' WHEN 'MX' THEN 'MX' END, CASE WHEN len(replace(id, '-', '')) IN (8, 9, 12) THEN 'US' END) AS country FROM c""")
def country(t):
    k = F.col("c_custkey")
    code = F.when(k % 5 == 0, " usa ").when(k % 5 == 1, "124").when(k % 5 == 2, "").when(k % 5 == 3, "MEX")
    state = F.when(k % 3 == 0, "cc").when(k % 3 == 1, "MX").otherwise("")
    ident = F.when(k % 2 == 0, F.concat(F.lit("840"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("06-"), F.lpad(k.cast("string"), 6, "0")))
    return t.customer.select("c_custkey", text.country_of(code, state, ident).alias("country"))


@query("F13_redacted", "SELECT event_id, 'GET /v1?api_key=[REDACTED]&n=' || event_id || ' Bearer [REDACTED]' AS line FROM events")
def redacted(t):
    line = F.concat(F.lit("GET /v1?api_key="), F.md5(F.col("event_id").cast("string")), F.lit("&n="), F.col("event_id"), F.lit(" Bearer abc."), F.col("event_id"))
    return t.events.select("event_id", text.redacted(line).alias("line"))


@query("F15_short_hash", "SELECT doc_id, left(sha256(text), 20) AS short FROM documents")
def short_hash(t):
    return t.documents.select("doc_id", text.short_hash(F.col("text")).alias("short"))


@query("F16_asset_path", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'context/assets/' || event_id || '.json' END AS path FROM events")
def asset_path(t):
    k = F.col("event_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://host/context/assets/"), k, F.lit(".json?v=1#x"))).when(k % 3 == 1, F.concat(F.lit("https://host/context/assets/ bad "), k)).otherwise(F.lit("https://host/other"))
    return t.events.select("event_id", text.asset_path(url).alias("path"))


@query("P05_mass_units", "SELECT c_custkey, c_custkey % 4 < 3 AS ok FROM customer")
def mass_units(t):
    k = F.col("c_custkey") % 4
    unit = F.when(k == 0, "µg/m³").when(k == 1, "μg / m³").when(k == 2, "UG/M3").otherwise("ppb")
    return t.customer.select("c_custkey", air.is_mass_unit(unit).alias("ok"))


@query("M09_hectares", "SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) END, floor(o_totalprice) * 2) * 0.404685642, 3) AS hectares FROM orders")
def hectares(t):
    whole = F.floor("o_totalprice")
    return t.orders.select("o_orderkey", air.hectares(F.when(F.col("o_orderkey") % 3 == 0, whole), whole * 2).alias("hectares"))

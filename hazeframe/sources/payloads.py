"""Parsers of provider payloads, as DataFrame expressions over raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions import air, clock, geo, text
from hazeframe.operators.spatial import clipped_ring

STATION_RECORD = "Parameter:string,Latitude:double,Longitude:double,AQI:int,Value:double,Concentration:double,Unit:string,UTC:string,DateObserved:string,FullAQSCode:string,SiteCode:string,SiteName:string,AgencyName:string,CountryCode:string,StateCode:string"
HEALTH_FEATURES = "numberMatched int, numberReturned int, links array<struct<rel:string,href:string>>, features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<location_id:string,location_name_en:string,observation_datetime:string,observation_type:string,aqhi:double,latest:boolean>>>"
FIRE_FEATURES = "error string, features array<struct<attributes:struct<OBJECTID:bigint,IrwinID:string,IncidentName:string,IncidentTypeCategory:string,IncidentSize:double,FinalAcres:double,DailyAcres:double,CalculatedAcres:double,DiscoveryAcres:double,ModifiedOnDateTime_dt:bigint>,geometry:struct<x:double,y:double,rings:array<array<array<double>>>>>>"


def station_records(raw: DataFrame, body: str, now: Column) -> DataFrame:
    """Monitors from JSON arrays of station records: PM2.5 only, finite, not negative, in bounds, not from the future."""
    rows = raw.select(F.posexplode(F.from_json(body, f"array<struct<{STATION_RECORD}>>")).alias("ord", "r")).select("ord", "r.*")
    value = air.usable(F.coalesce("Value", "Concentration"))
    ident = text.first_identifier(F.col("FullAQSCode"), F.col("SiteCode"))
    at = clock.first_time(F.col("UTC"), F.col("DateObserved"))
    out = rows.select(
        "ord", ident.alias("id"), text.clean(F.col("SiteName")).alias("name"), F.col("Longitude").alias("lon"), F.col("Latitude").alias("lat"),
        at.alias("observed"), value.alias("value"), F.col("AQI").alias("aqi"), text.country_of(F.col("CountryCode"), F.col("StateCode"), ident).alias("country"),
        F.upper("Parameter").isin("PM2.5", "PM25").alias("_pm"), (F.col("Unit").isNull() | air.is_mass_unit(F.col("Unit"))).alias("_unit"),
    )
    good = F.col("_pm") & F.col("_unit") & F.col("value").isNotNull() & F.col("id").isNotNull() & (F.col("aqi") >= 0) & geo.in_monitor_regions(F.col("lon"), F.col("lat")) & (F.col("observed") <= now + F.expr("interval 15 minutes"))
    return out.where(good).drop("_pm", "_unit")


def health_index(raw: DataFrame, body: str, now: Column) -> DataFrame:
    """Canadian health index from feature collections. A truncated or paged response gives no rows but fails the read."""
    doc = raw.select(F.from_json(body, HEALTH_FEATURES).alias("d")).select("d.*")
    whole = (F.col("numberReturned") == F.size("features")) & (F.coalesce("numberMatched", "numberReturned") <= F.col("numberReturned")) & ~F.coalesce(F.exists("links", lambda x: x["rel"] == "next"), F.lit(False))
    checked = doc.withColumn("features", F.when(F.coalesce(whole, F.lit(False)), F.col("features")).otherwise(F.raise_error(F.lit("incomplete response"))))
    rows = checked.select(F.posexplode("features").alias("ord", "f")).select("ord", "f.properties.*", F.col("f.geometry.coordinates").alias("xy"), F.col("f.geometry.type").alias("shape"))
    at = clock.first_time(F.col("observation_datetime"))
    out = rows.select("ord", F.col("location_id").alias("id"), text.clean(F.col("location_name_en")).alias("name"), F.get("xy", F.lit(0)).alias("lon"), F.get("xy", F.lit(1)).alias("lat"), at.alias("observed"), air.usable(F.col("aqhi")).alias("value"), (F.col("observation_type") == "amendment").alias("amended"), "latest", "shape")
    good = (F.col("shape") == "Point") & F.col("latest") & (F.col("value") > 0) & geo.in_monitor_regions(F.col("lon"), F.col("lat")) & F.col("observed").between(now - F.expr("interval 2 hours"), now + F.expr("interval 15 minutes"))
    return out.where(good).drop("latest", "shape")


def fires(raw: DataFrame, body: str) -> DataFrame:
    """Incidents: no prescribed burns; first known area in hectares; last row of an id wins; centre of all vertices."""
    doc = raw.select(F.from_json(body, FIRE_FEATURES).alias("d")).select("d.*")
    doc = doc.withColumn("features", F.when(F.col("error").isNull(), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("provider error: "), text.redacted(F.col("error"))))))
    rows = doc.select(F.posexplode("features").alias("ord", "f")).select("ord", "f.attributes.*", "f.geometry")
    points = F.flatten("geometry.rings")
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    acres = [air.usable(F.col(c)) for c in ("IncidentSize", "FinalAcres", "DailyAcres", "CalculatedAcres", "DiscoveryAcres")]
    out = rows.select("ord", text.first_identifier(F.col("IrwinID"), F.col("OBJECTID").cast("string")).alias("id"), F.col("IncidentName").alias("name"), air.hectares(*acres).alias("hectares"), F.coalesce("geometry.x", F.when(F.size(points) > 0, mean(0))).alias("lon"), F.coalesce("geometry.y", F.when(F.size(points) > 0, mean(1))).alias("lat"), (F.col("ModifiedOnDateTime_dt") / 1000).alias("updated"), F.upper(F.coalesce("IncidentTypeCategory", F.lit(""))).alias("_kind"))
    out = out.where(~((F.col("_kind") == "RX") | F.col("_kind").contains("PRESCRIB")) & F.col("id").isNotNull()).drop("_kind")
    return out.groupBy("id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "id"]), "ord").alias("r")).select("id", "r.*")


PERIMETERS = "error string, exceededTransferLimit boolean, features array<struct<attributes:struct<OBJECTID:bigint,attr_IncidentTypeCategory:string,poly_IncidentTypeCategory:string,IncidentTypeCategory:string>,geometry:struct<rings:array<array<array<double>>>>>>"


def fire_parts(incidents: DataFrame, perimeters: DataFrame | None, body: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidents, rings (feature, ring, points) and outcomes (part, ok, message) of the two halves of a fire feed.

    A fault in the incidents fails the read, as in fires(). The perimeters, a body a page, may be absent (None), no JSON,
    an error of the provider, cut short (every page says that more follow) or wrongly paged (an object without a number,
    or a number twice): then there are no rings at all, the outcome says why, and the incidents stand. Prescribed burns
    have no rings; points that are not finite go; rings are cut to the display box and need three corners.
    """
    spark = incidents.sparkSession
    known = fires(incidents, body)
    fine = spark.createDataFrame([("incidents", True, None)], "part string, ok boolean, message string")
    if perimeters is None:
        lost = spark.createDataFrame([("perimeters", False, "not loaded")], fine.schema)
        return known, spark.createDataFrame([], "feature long, ring int, points array<struct<x:double,y:double>>"), fine.unionAll(lost)
    doc = perimeters.select(body, F.from_json(body, PERIMETERS).alias("d"), F.try_parse_json(body).isNotNull().alias("json"))
    fault = F.when(~F.col("json"), "no JSON").when(F.col("d.error").isNotNull(), F.concat(F.lit("provider error: "), text.redacted(F.col("d.error")))).when(F.col("d.features").isNull(), "no features")
    doc = doc.select("d", fault.alias("fault"))
    pages = doc.agg(F.min("fault").alias("fault"), F.coalesce(F.bool_and(F.coalesce("d.exceededTransferLimit", F.lit(False))), F.lit(False)).alias("open"))
    objects = doc.select(F.explode("d.features.attributes.OBJECTID").alias("o")).agg((F.count(F.lit(1)) != F.count_distinct("o")).alias("off"))
    fault = F.coalesce("fault", F.when(F.col("open"), "cut short"), F.when(F.col("off"), "invalid paging"))
    verdict = pages.join(objects, how="cross").select(fault.alias("fault"))  # one row of each
    kinds = [F.col(f"f.attributes.{c}") for c in ("attr_IncidentTypeCategory", "poly_IncidentTypeCategory", "IncidentTypeCategory")]
    kind = F.upper(F.coalesce(*[F.nullif(k, F.lit("")) for k in kinds], F.lit("WF")))
    features = doc.select(F.monotonically_increasing_id().alias("_doc"), F.posexplode("d.features").alias("_f", "f")).where(~(kind.contains("RX") | kind.contains("PRESCRIB")))
    rings = features.select(F.xxhash64("_doc", "_f").alias("feature"), F.posexplode("f.geometry.rings").alias("ring", "raw"))
    finite = F.filter("raw", lambda p: F.coalesce(geo.finite(F.get(p, F.lit(0))) & geo.finite(F.get(p, F.lit(1))), F.lit(False)))
    points = rings.select("feature", "ring", F.transform(finite, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("points"))
    cut = clipped_ring(points.where(F.size("points") > 0), "points", geo.DISPLAY_BOX).where(F.size("clipped") >= 3).select("feature", "ring", F.col("clipped").alias("points"))
    kept = cut.join(verdict.where("fault IS NULL").select(F.lit(True).alias("_ok")), how="cross").drop("_ok")  # one row or none
    second = verdict.select(F.lit("perimeters").alias("part"), F.col("fault").isNull().alias("ok"), F.col("fault").alias("message"))
    return known, kept, fine.unionAll(second)


CANADIAN_FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<national_fire_id:string,agency_fire_id:string,firename:string,fireid:string,id:string,fire_was_prescribed:int,fire_size:double,hectares:double,area:double,sizeha:double,status_date:string,record_start:string,lastrepdate:string,updated:string,date:string,stage_of_control_status:string,stage_of_control:string,stageofcontrol:string,status:string>>>"


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Rings, as arrays of (x, y) pairs, of a Polygon's or MultiPolygon's coordinates in JSON; no rings for others."""
    none = F.array().cast("array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>")).when(kind == "MultiPolygon", many)
    return F.coalesce(F.transform(rings, lambda ring: F.filter(ring, lambda p: F.coalesce(geo.finite(F.get(p, F.lit(0))) & geo.finite(F.get(p, F.lit(1))), F.lit(False)))), none)


def canadian_fires(raw: DataFrame, body: str) -> DataFrame:
    """Incidents: no prescribed burns; the first row of an id in a body counts, and goes if it has no place in the
    display box or no time; area in hectares; point, or the mean of all vertices."""
    rows = raw.select(F.from_json(body, CANADIAN_FEATURES).alias("d")).select(F.posexplode("d.features").alias("ord", "f")).select("ord", "f.properties.*", "f.geometry")
    ident = text.first_identifier(F.col("national_fire_id"), F.col("agency_fire_id"), F.col("firename"), F.col("fireid"), F.col("id"))
    point = F.from_json("geometry.coordinates", "array<double>")
    vertices = F.flatten(rings_of(F.col("geometry.type"), F.col("geometry.coordinates")))
    mean = lambda k: F.aggregate(vertices, F.lit(0.0), lambda a, p: a + p[k]) / F.size(vertices)
    at = lambda k: F.when(F.col("geometry.type") == "Point", F.get(point, F.lit(k))).when(F.size(vertices) > 0, mean(k))
    area = F.coalesce(*[air.usable(F.col(c)) for c in ("fire_size", "hectares", "area", "sizeha")])
    status = F.coalesce("stage_of_control_status", "stage_of_control", "stageofcontrol", "status", F.lit("Reported wildfire"))
    updated = clock.first_time(*[F.col(c) for c in ("status_date", "record_start", "lastrepdate", "updated", "date")])
    out = rows.where(F.coalesce("fire_was_prescribed", F.lit(0)) != 1).select("ord", ident.alias("ident"), F.coalesce("agency_fire_id", "firename", "fireid", F.lit("Reported wildfire")).alias("name"), at(0).alias("lon"), at(1).alias("lat"), status.alias("status"), area.alias("hectares"), updated.alias("updated"))
    first = out.where("ident IS NOT NULL").groupBy("ident").agg(F.min_by(F.struct("name", "lon", "lat", "status", "hectares", "updated"), "ord").alias("r"))
    kept = first.select(F.concat(F.lit("CA:"), "ident").alias("id"), "r.*")
    return kept.where(geo.in_display(F.col("lon"), F.col("lat")) & F.col("updated").isNotNull())


def with_legacy(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns that changed their names: the first of the given ones that the table has, else null."""
    have = [F.coalesce(*[F.col(c) for c in own if c in rows.columns], F.lit(None)).alias(name) for name, own in names.items()]
    return rows.select(*[c for c in rows.columns if c not in {x for own in names.values() for x in own}], *have)


def first_named(entries: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key, name: the first entry of each key, replaced by the first one with a name if it has none."""
    return entries.groupBy(key).agg(F.min_by(name, F.struct((F.coalesce(name, F.lit("")) == "").alias("empty"), order)).alias(name))


PARAMETERS, STATION = "array<struct<id:string,nombre:string>>", "array<struct<lat:string,Latitud:string,long:string,lon:string,Longitud:string,edo:string,estado:string,munc:string,municipio:string,redNom:string,nombre:string>>"


def station_metadata(rows: DataFrame) -> DataFrame:
    """id, name, agency, lon, lat, state, municipality of stations (id, fallback, parameters, meta: JSON arrays) that
    measure PM2.5, have a numeric id and lie in bounds."""
    measured = F.exists(F.from_json("parameters", PARAMETERS), lambda p: F.upper(F.coalesce(F.nullif(p["id"], F.lit("")), p["nombre"])).rlike(r"2\.5|^PM\s*25$"))
    body = F.when(F.btrim("meta").startswith("["), F.col("meta")).otherwise(F.concat(F.lit("["), "meta", F.lit("]")))
    m = rows.where(text.station_number(F.col("id")) & measured).withColumn("m", F.get(F.from_json(body, STATION), F.lit(0)))
    number = lambda *names: F.coalesce(*[F.expr(f"try_cast(nullif(m.{n}, '') as double)") for n in names])
    out = m.select("id", text.clean(F.coalesce("m.nombre", F.nullif("fallback", F.lit("")), "id")).alias("name"), text.clean(F.coalesce("m.redNom", F.lit("INECC/SINAICA"))).alias("agency"), number("long", "lon", "Longitud").alias("lon"), number("lat", "Latitud").alias("lat"), F.coalesce("m.edo", "m.estado").alias("state"), F.coalesce("m.munc", "m.municipio").alias("municipality"))
    return out.where(geo.in_monitor_regions(F.col("lon"), F.col("lat")))


def capabilities(raw: DataFrame, key: str, body: str, layer: str) -> DataFrame:
    """key, run, times: newest reference time and sorted distinct valid times of one layer of an XML description."""
    own = f"//*[local-name()='Layer'][*[local-name()='Name']='{layer}']/*[local-name()='Dimension' or local-name()='Extent']"
    lower = "translate(@name,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    of = lambda *names: F.xpath(F.col(body), F.lit(f"{own}[{' or '.join(f'{lower}={n!r}' for n in names)}]/text()"))
    found = raw.select(key, F.btrim(F.get(of("time"), F.lit(0))).alias("time"), F.btrim(F.get(of("reference_time", "reference-time"), F.lit(0))).alias("reference"))
    times = found.select(key, dimension_values(F.col("time")).alias("times"), dimension_values(F.coalesce("reference", F.lit(""))).alias("runs"))
    run = F.coalesce(F.array_max("runs"), F.get("times", F.lit(0)))
    return times.where(F.size("times") > 0).select(key, run.alias("run"), F.array_sort(F.array_distinct("times")).alias("times"))


def options(html: Column, select_id: str) -> Column:
    """(value, label) structs of the options inside one select element."""
    inner = F.regexp_extract(html, rf"(?is)<select[^>]*\bid=[\"']{select_id}[\"'][^>]*>(.*?)</select>", 1)
    found = F.regexp_extract_all(inner, F.lit(r"(?is)<option[^>]*\bvalue=[\"']?[^\"'>]*[\"']?[^>]*>[^<]*"), F.lit(0))
    return F.transform(found, lambda o: F.struct(F.regexp_extract(o, r"(?i)value=[\"']?([^\"'>]*)", 1).alias("value"), F.btrim(F.regexp_extract(o, r">([^<]*)$", 1)).alias("label")))


def json_literal(body: Column, schema: str) -> Column:
    """A JSON array body, or the first array of objects inside script text; never evaluated."""
    inside = F.regexp_extract(body, r"(?s)(\[\s*\{.*?\}\s*\])", 1)
    return F.from_json(F.when(F.btrim(body).startswith("["), body).otherwise(inside), schema)


def dimension_values(spec: Column, most: int = 500) -> Column:
    """Instants of start/end/PTnH or of a comma list; `most` is the format's own limit."""
    parts = F.split(spec, "/")
    hours = F.regexp_extract(F.get(parts, F.lit(2)), r"PT(\d+)H", 1).cast("int")
    stepped = F.transform(F.sequence(F.lit(0), F.least(F.lit(most - 1), F.floor((F.unix_timestamp(F.to_timestamp(F.get(parts, F.lit(1)))) - F.unix_timestamp(F.to_timestamp(F.get(parts, F.lit(0))))) / (hours * 3600)).cast("int"))), lambda i: F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.get(parts, F.lit(0)))) + i * hours * 3600))
    listed = F.slice(F.transform(F.split(spec, ","), lambda v: F.try_to_timestamp(F.btrim(v))), 1, most)
    return F.when(F.size(parts) == 3, stepped).otherwise(listed)


def newest_cycle(files: DataFrame, cycle: str, hour: str, probes: list[int]) -> DataFrame:
    """The newest cycle for which all probe hours exist; one row."""
    have = files.groupBy(cycle).agg(F.collect_set(hour).alias("_h"))
    whole = F.size(F.array_except(F.array(*[F.lit(p) for p in probes]), F.col("_h"))) == 0
    return have.where(whole).agg(F.max(cycle).alias(cycle))


def has_field(lines: DataFrame, variable: str = "MASSDEN", level: str = "8 m above ground") -> DataFrame:
    """found: whether any index line names the variable at the level; one row."""
    return lines.agg(F.coalesce(F.bool_or(F.col("value").contains(f":{variable}:") & F.col("value").contains(level)), F.lit(False)).alias("found"))

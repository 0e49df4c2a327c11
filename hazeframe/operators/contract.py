"""Contract operators: row validators, manifest rules, normalisation, fallbacks, retention and publication keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions import clock, geo
from hazeframe.operators.quality import STALE_HOURS

# Fixed values of the publication contract, version 8.
AIR_SOURCES = ["airnow", "bcair", "sinaica", "aqhi"]
SOURCES = [*AIR_SOURCES, "wfigs", "cwfis", "firework", "hrrr"]
STATUSES = ["ok", "stale", "error", "unavailable"]
EPA, HEALTH = "us-epa-pm25-aqi", "ca-aqhi"
EPA_CATEGORIES = ["good", "moderate", "unhealthy for sensitive groups", "unhealthy", "very unhealthy", "hazardous", "beyond the aqi"]
HEALTH_CATEGORIES = ["low", "moderate", "high", "very high"]
METHODS = ["provider", "epa-nowcast-2024"]
COUNT_VERSION = "eccc-aqhi-latest-v1"
POLICY = {"selectionPolicy": "feathered-max-v1", "sourceMaskVersion": "contribution-v2", "coveragePolicy": "land-plus-coastal-water-v1"}
HORIZON, TILES = 36, 16
MONITOR = "id string, name string, agency string, lon double, lat double, observedAt string, category string, indexSystem string, indexValue double, indexMethod string, aqi double, aqiMethod string, concentration double, nowcastConcentration double, unit string, source string, sourceUrl string, country string"
INCIDENT = "id string, name string, country string, lon double, lat double, status string, updatedAt string, sourceUrl string, areaHectares double"
STATE = "struct<status:string,checkedAt:string,observedAt:string,provenance:string>"
FRAME = "struct<validTime:string,modelRun:string,textureUrl:string,sourceMaskUrl:string,values:string,contributors:array<struct<source:string,modelRun:string>>,detailTiles:array<struct<column:int,row:int,textureUrl:string,sourceMaskUrl:string>>>"
RUN = f"struct<frames:array<{FRAME}>,integratedStatus:string,horizonHours:int,modelRun:string,legendUrl:string,selectionPolicy:string,sourceMaskVersion:string,coveragePolicy:string,featherDistanceKm:int>"
MANIFEST = f"version int, mode string, generatedAt string, bounds struct<west:double,east:double,south:double,north:double>, sources map<string,{STATE}>, air struct<monitorsUrl:string,observedAt:string,monitorSets:map<string,struct<url:string,observedAt:string,count:bigint,countVersion:string>>>, forecast {RUN}, forecasts struct<best:{RUN},hrrr:{RUN},firework:{RUN}>"


def is_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text).isNotNull(), F.lit(False))


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(https?://[^\s]+|/[^\s]*)$"), F.lit(False))


def _optional(value: Column, ok: Column) -> Column:
    return value.isNull() | F.coalesce(ok, F.lit(False))


def _amount(value: Column) -> Column:
    return geo.finite(value) & (value >= 0)


def valid_monitor() -> Column:
    """Over the columns of MONITOR: place, time and category, and either an index of a known system or a legacy index."""
    c = F.col
    category, measured = F.lower(c("category")), _amount(c("concentration")) & c("unit").isNotNull()
    whole = (c("id") != "") & c("name").isNotNull() & c("agency").isNotNull() & geo.in_monitor_regions(c("lon"), c("lat")) & is_time(c("observedAt"))
    legacy = c("indexSystem").isNull() & _amount(c("aqi")) & measured & category.isin(EPA_CATEGORIES)
    health = (c("indexSystem") == HEALTH) & (c("indexValue") > 0) & (c("source") == "aqhi") & (c("country") == "CA") & category.isin(HEALTH_CATEGORIES)
    epa = (c("indexSystem") == EPA) & category.isin(EPA_CATEGORIES) & measured
    shaped = F.coalesce(legacy, F.lit(False)) | F.coalesce(_amount(c("indexValue")) & (health | epa), F.lit(False))
    extras = _optional(c("source"), c("source").isin(AIR_SOURCES)) & _optional(c("sourceUrl"), is_url(c("sourceUrl"))) & _optional(c("aqiMethod"), c("aqiMethod").isin(METHODS)) & _optional(c("indexMethod"), c("indexMethod").isin(METHODS)) & _optional(c("country"), c("country").isin("US", "CA", "MX")) & _optional(c("nowcastConcentration"), _amount(c("nowcastConcentration")))
    return F.coalesce(whole & shaped & extras, F.lit(False))


def valid_incident() -> Column:
    """Over the columns of INCIDENT."""
    c = F.col
    place = geo.finite(c("lon")) & geo.finite(c("lat")) & c("lon").between(-180, 180) & c("lat").between(-90, 90)
    return F.coalesce((c("id") != "") & c("name").isNotNull() & c("country").isin("US", "CA") & place & c("status").isNotNull() & is_time(c("updatedAt")) & is_url(c("sourceUrl")) & _optional(c("areaHectares"), _amount(c("areaHectares"))), F.lit(False))


def normalised(monitors: DataFrame) -> DataFrame:
    """Legacy rows get the comparable system, their index as value and the provider's method."""
    legacy = F.col("indexSystem").isNull() | F.col("indexValue").isNull()
    return monitors.withColumns({
        "indexSystem": F.when(legacy, EPA).otherwise(F.col("indexSystem")),
        "indexValue": F.when(legacy, F.coalesce("aqi", F.lit(0.0))).otherwise(F.col("indexValue")),
        "indexMethod": F.when(legacy, F.coalesce("aqiMethod", F.lit("provider"))).otherwise(F.col("indexMethod")),
    })


def in_mode(mode: str) -> Column:
    """local: health index, or the US network at home; comparable: the one system that all places share."""
    if mode == "local":
        return (F.col("indexSystem") == HEALTH) | ((F.col("source") == "airnow") & (F.col("country") == "US"))
    return F.col("indexSystem") == EPA


def air_sources(mode: str | None) -> list[str]:
    return {"local": ["airnow", "aqhi"], "comparable": ["airnow", "bcair", "sinaica"]}.get(mode or "", AIR_SOURCES)


def monitor_urls(manifests: DataFrame, key: str, mode: str | None = None) -> DataFrame:
    """key, url: distinct assets of a mode's sources."""
    own = F.array(*[F.coalesce(F.col("air.monitorSets")[s]["url"], F.col("air.monitorsUrl") if s == "airnow" else F.lit(None)) for s in air_sources(mode)])
    return manifests.select(key, F.explode(F.array_distinct(F.filter(own, lambda u: u.isNotNull() & (u != "")))).alias("url"))


def run_rules(run: Column, public: bool, horizon: int = HORIZON) -> dict[str, Column]:
    """Rules of a forecast run; public runs carry textures, masks and 4 x 4 detail tiles, others metadata only."""
    frames = F.coalesce(run["frames"], F.array().cast(f"array<{FRAME}>"))
    times = F.transform(frames, lambda f: F.try_to_timestamp(f["validTime"]))
    some = F.size(frames) > 0
    needs = lambda ok: ~some | F.coalesce(ok, F.lit(False))
    positions = F.transform(F.sequence(F.lit(0), F.lit(TILES - 1)), lambda i: F.struct((i % 4).cast("int").alias("column"), F.floor(i / 4).cast("int").alias("row")))
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    rules = {
        "status": _optional(run["integratedStatus"], run["integratedStatus"].isin("fresh", "retained", "unavailable")),
        "model-run": needs(is_time(run["modelRun"])),
        "times": F.coalesce(~F.exists(times, lambda x: x.isNull()), F.lit(False)) & (F.array_sort(F.array_distinct(times)) == times),
        "contributors": F.forall(frames, lambda f: F.coalesce(F.forall(f["contributors"], lambda c: F.coalesce(c["source"].isin("firework", "hrrr"), F.lit(False)) & _optional(c["modelRun"], is_time(c["modelRun"]))) & unique(f["contributors"]["source"]), F.lit(True))),
        "private-fields": F.forall(frames, lambda f: f["values"].isNull()),
    }
    if public:
        rules |= {
            "legend": needs(is_url(run["legendUrl"])),
            "policy": needs(F.lit(True) & (run["featherDistanceKm"] == 200)),
            **{name: needs(run[name] == value) for name, value in POLICY.items()},
            "horizon": F.coalesce(run["horizonHours"] == horizon, F.lit(False)) & ((F.coalesce(run["integratedStatus"], F.lit("")) == "unavailable") | (F.size(frames) == horizon + 1)),
            "textures": F.forall(frames, lambda f: is_url(f["textureUrl"]) & is_url(f["sourceMaskUrl"])),
            "tiles": F.forall(frames, lambda f: F.coalesce((F.transform(f["detailTiles"], lambda d: F.struct(d["column"].alias("column"), d["row"].alias("row"))) == positions) & F.forall(f["detailTiles"], lambda d: is_url(d["textureUrl"]) & is_url(d["sourceMaskUrl"])), F.lit(False))),
        }
    else:
        rules["no-textures"] = F.forall(frames, lambda f: f["textureUrl"].isNull() & f["sourceMaskUrl"].isNull())
    return rules


def manifest_rules() -> dict[str, Column]:
    """Rules over the columns of MANIFEST; with quality.violations() they give one row for each broken rule."""
    c = F.col
    west, east, south, north = geo.FORECAST_BOX
    box = (c("bounds.west") == west) & (c("bounds.east") == east) & (c("bounds.south") == south) & (c("bounds.north") == north)
    states, sets = F.map_values("sources"), c("air.monitorSets")
    state_ok = F.forall(states, lambda s: F.coalesce(s["status"].isin(STATUSES), F.lit(False)) & is_time(s["checkedAt"]) & F.coalesce(s["provenance"].startswith("http"), F.lit(False)) & _optional(s["observedAt"], is_time(s["observedAt"])))
    set_ok = F.forall(F.map_entries(sets), lambda e: e["key"].isin(AIR_SOURCES) & is_url(e["value"]["url"]) & _optional(e["value"]["observedAt"], is_time(e["value"]["observedAt"])) & _optional(e["value"]["count"], e["value"]["count"] >= 0))
    own = sets["aqhi"]
    rules = {
        "version": c("version") == 8, "mode": c("mode").isin("demo", "live"), "generated": is_time(c("generatedAt")), "bounds": box,
        "sources-complete": F.size(F.array_except(F.array(*map(F.lit, SOURCES)), F.map_keys("sources"))) == 0,
        "sources-known": F.size(F.array_except(F.map_keys("sources"), F.array(*map(F.lit, SOURCES)))) == 0, "source-state": state_ok,
        "monitors": c("air").isNotNull() & (c("air.monitorsUrl").isNull() | (is_url(c("air.monitorsUrl")) & is_time(c("air.observedAt")))),
        "monitor-sets": sets.isNull() | set_ok,
        "health-set": own.isNull() | ((own["countVersion"] == COUNT_VERSION) & (own["count"] > 0) & own["observedAt"].isNotNull()),
        "health-set-missing": (c("sources")["aqhi"]["status"] != "ok") | own.isNotNull(),
        "models": c("forecasts.best").isNotNull() & c("forecasts.hrrr").isNotNull() & c("forecasts.firework").isNotNull(),
        "forecast-is-best": F.to_json("forecast").eqNullSafe(F.to_json("forecasts.best")),
    }
    for model in ("best", "hrrr", "firework"):
        rules |= {f"{model}:{name}": ok for name, ok in run_rules(c(f"forecasts.{model}"), model == "best").items()}
    return rules


def normalised_manifest(manifests: DataFrame) -> DataFrame:
    """Missing models become empty runs, a missing best one an unavailable run; forecast is always the best one."""
    empty = lambda status: F.from_json(F.lit('{"frames":[]' + (f',"integratedStatus":"{status}"' if status else "") + "}"), RUN)
    models = F.struct(*[F.coalesce(F.col(f"forecasts.{m}"), empty("unavailable" if m == "best" else "")).alias(m) for m in ("best", "hrrr", "firework")])
    return manifests.withColumn("forecasts", models).withColumn("forecast", F.col("forecasts.best"))


def frame_run(frame: Column, source: Column) -> Column:
    """Model run of a frame's contributor, else the frame's own, else empty."""
    own = F.get(F.filter(frame["contributors"], lambda c: c["source"] == source), F.lit(0))["modelRun"]
    return F.coalesce(own, frame["modelRun"], F.lit(""))


def fallback(source: Column, had_state: Column, had_section: Column, observed_age_hours: Column, last_valid_ahead: Column, key_missing: Column) -> Column:
    """(status, retained) of a source that failed: its earlier section stays if there is one and, for forecasts, its
    last frame is not past; stale beyond the source's limit, else error."""
    limit = F.element_at(F.create_map(*[x for k, v in STALE_HOURS.items() for x in (F.lit(k), F.lit(v))]), source)
    forecast = source.isin("firework", "hrrr")
    old = observed_age_hours.isNull() | (observed_age_hours > limit)
    expired = forecast & had_section & ~F.coalesce(last_valid_ahead, F.lit(False))
    kept = had_state & had_section & ~expired
    status = F.when(expired, "unavailable").when(kept, F.when(old, "stale").otherwise("error")).when(key_missing, "unavailable").otherwise("error")
    return F.struct(status.alias("status"), kept.alias("retained"))


def retained_run(previous: Column, complete: Column, valid_until: Column, now: Column) -> Column:
    """The earlier run, marked retained, if it is complete and not past; else an unavailable one without frames."""
    usable = previous.isNotNull() & F.coalesce(complete, F.lit(False)) & F.coalesce(valid_until >= now, F.lit(False))
    return F.when(usable, previous.withField("integratedStatus", F.lit("retained"))).otherwise(F.from_json(F.lit('{"frames":[],"integratedStatus":"unavailable"}'), RUN))


def latest_plausible(rows: DataFrame, key: str, time: str, now: Column, default: Column) -> DataFrame:
    """key, latest: newest time after the year 2000 and at most 5 minutes ahead of now, else the default."""
    good = (F.year(time) > 2000) & (F.col(time) <= now + F.expr("interval 5 minutes"))
    return rows.groupBy(key).agg(F.coalesce(F.max(F.when(good, F.col(time))), F.first(default)).alias("latest"))


def prior_count(sets: Column, source: str, version: str | None = None) -> Column:
    """A source's count in the snapshot before; null if it was counted by another rule."""
    item = sets[source]
    return item["count"] if version is None else F.when(item["countVersion"] == version, item["count"])


def publication_key(*columns: str) -> Column:
    """Equal for snapshots that show the same."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def changed(polls: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Polls whose key differs from the one before; the first always counts."""
    before = F.lag(key).over(Window.partitionBy(by).orderBy(order))
    return polls.withColumn("_before", before).where(~F.col(key).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def protected_paths(documents: DataFrame, body: str, path_of) -> DataFrame:
    """path: distinct stored objects that the JSON documents name in any URL."""
    leaves = documents.select(F.explode(F.regexp_extract_all(body, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))).alias("url"))
    return leaves.select(path_of(F.col("url")).alias("path")).where("path IS NOT NULL").distinct()


def reuse_or_publish(df: DataFrame, versions: list[tuple[str, str]], tiles: str) -> DataFrame:
    """Adds action: reuse where a previous frame has the same versions (null-safe) and all its tiles, else publish."""
    same = F.lit(True)
    for now, before in versions:
        same = same & F.col(now).eqNullSafe(F.col(before))
    return df.withColumn("action", F.when(same & (F.coalesce(F.col(tiles), F.lit(0)) == TILES), "reuse").otherwise("publish"))


def cached(df: DataFrame, parser: str, signature: Column, now_hour: Column, hours: int = 12) -> DataFrame:
    """Cached rows (parser, signature, hour) that are still good."""
    return df.where((F.col("parser") == parser) & (F.col("signature") == signature) & (now_hour - F.col("hour") <= hours))


def cached_set(df: DataFrame, parser: str, signature: Column, now_hour: Column, least: int, hours: int = 12) -> DataFrame:
    """cached(), or no rows at all where fewer than `least` of them are good: a set that collapsed is fetched anew."""
    good = cached(df, parser, signature, now_hour, hours)
    enough = good.agg((F.count(F.lit(1)) >= least).alias("_ok")).where("_ok")  # one row or none
    return good.join(enough, how="cross").drop("_ok")


def reusable(previous: Column, required: dict[str, Column | None]) -> Column:
    """Whether a previous result may stand: it is there, whole, and bears every required value; None means it must have
    none, as for the version of a source that is off."""
    same = F.lit(True)
    for name, value in required.items():
        same = same & previous[name].eqNullSafe(F.lit(None) if value is None else value)
    return previous.isNotNull() & same & ~F.coalesce(previous["incomplete"], F.lit(False))


def canonical_outlook(generated: Column, times: Column, status: Column, horizon: int) -> Column:
    """Whether a run's frames (ISO times, in order) are every whole hour from the generation's on, up to the horizon; a
    run without frames, or one that is unavailable, has nothing to keep."""
    due = F.transform(clock.canonical_hours(F.to_timestamp(generated), horizon), clock.iso)
    idle = F.coalesce(status == "unavailable", F.lit(False)) | (F.coalesce(F.size(times), F.lit(0)) <= 0)
    return idle | F.coalesce(times == due, F.lit(False))


# Texts of health issues.
ISSUES = {"stale-heartbeat": "The scheduled data update is late.", "stale-forecast": "The latest complete forecast is stale.", "insufficient-forecast-coverage": "Forecast coverage is shorter than six hours.", "forecast-unavailable": "The integrated smoke forecast is unavailable.", "unexpected-version": "The published data version does not match this app."}


def issue_text(issue: Column, label: Column) -> Column:
    """Text of a health issue; source-<name>-<status> issues name the source by its label."""
    name, status = F.regexp_extract(issue, r"^source-([a-z]+)-(stale|error|unavailable|missing)$", 1), F.regexp_extract(issue, r"-([a-z]+)$", 1)
    many = name.isin("wfigs", "cwfis")
    said = F.when(status == "missing", F.when(many, "were not published").otherwise("was not published")).when(status == "error", "failed to update").otherwise(F.concat(F.when(many, "are ").otherwise("is "), status))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv]), issue)
    return F.when(name != "", F.concat(label, F.lit(" "), said, F.lit("."))).otherwise(F.coalesce(known, F.lit("An automatic data-health check reported a problem.")))


# Phases of playback while it runs, and its transitions as (event, phases it acts in or None for all, next
# phase). Of the names in brackets, start and play are settled by what is ready, given by the event's own phase.
ACTIVE = ["preparing-detail", "buffering", "playing", "fading-out", "resetting", "fading-in"]
TRANSITIONS = [
    ("play", None, "[play]"),
    ("pause", ACTIVE, "manual-paused"),
    ("interaction", ACTIVE, "interaction-paused"),
    ("asset-failure", ACTIVE, "interaction-paused"),
    ("ready", ["buffering"], "playing"),
    ("detail-hidden", ["preparing-detail"], "[start]"),
    ("endpoint", ["playing"], "waiting"),
    ("fade-complete", ["fading-out"], "resetting"),
    ("fade-complete", ["fading-in"], "playing"),
    ("reset-complete", ["resetting"], "fading-in"),
    ("set", None, "[given]"),
]


def next_phase(phase: Column, event: Column) -> Column:
    """Playback phase after an event (type, can_play, at_end, detail, ready, phase), by TRANSITIONS; else it stays."""
    start = F.when(event["ready"], "playing").otherwise("buffering")
    play = F.when(~F.coalesce(event["can_play"], F.lit(False)), phase).when(event["at_end"], "waiting").when(event["detail"], "preparing-detail").otherwise(start)
    named = {"[start]": start, "[play]": play, "[given]": event["phase"]}
    out = phase
    for kind, phases, to in TRANSITIONS:
        acts = (event["type"] == kind) & (phase.isin(phases) if phases else F.lit(True))
        out = F.when(acts, named.get(to, F.lit(to))).otherwise(out)
    return out


def folded_phase(events: Column, start: str = "idle") -> Column:
    """Phase after an array of events in order; a session's events are few."""
    return F.aggregate(events, F.lit(start), lambda phase, e: next_phase(phase, e))

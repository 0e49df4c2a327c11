"""Quality operators: collapse guards, freshness, constraint tables, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.operators.staging import staged

# Hours after which a source is stale; least previous count for the collapse guard.
STALE_HOURS = {"airnow": 2, "bcair": 2, "sinaica": 2, "aqhi": 2, "wfigs": 6, "cwfis": 6, "firework": 18, "hrrr": 6}
GUARD_MINIMUM = {"airnow": 20, "bcair": 8, "sinaica": 10, "aqhi": 25}


def collapse_guard(counts: DataFrame, key: str, run: str, n: str, minimum: int, ratio: float = 0.5) -> DataFrame:
    """Adds previous and collapsed: a count under ratio of the run before, if that had at least minimum rows."""
    before = F.lag(n).over(Window.partitionBy(key).orderBy(run))
    out = counts.withColumn("previous", before)
    return out.withColumn("collapsed", F.coalesce((F.col("previous") >= minimum) & (F.col(n) < F.col("previous") * ratio), F.lit(False)))


def aged_status(status: Column, age_hours: Column, limit: Column) -> Column:
    """ok turns stale strictly beyond the limit."""
    return F.when((status == "ok") & (age_hours > limit), "stale").otherwise(status)


def last_good(now: DataFrame, previous: DataFrame, key: str, payload: str) -> DataFrame:
    """Keep a failed source's previous payload, marked stale; without one it is unavailable.

    now: key, ok, payload. previous: key, payload. Keys that now lacks are unavailable and never restored.
    """
    old = previous.select(key, F.col(payload).alias("_old"), F.lit(True).alias("_had"))
    joined = now.join(old, key, "left")
    status = F.when(F.col("ok"), "ok").when(F.col("_had"), "stale").otherwise("unavailable")
    return joined.select(key, status.alias("status"), F.when(F.col("ok"), F.col(payload)).otherwise(F.col("_old")).alias(payload))


def carried(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds carried: the newest non-null value of the key up to each row, by order.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows is spread over many tasks; each range
    hands its last value on through a table of one row for each key and range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id()))  # written numbers hold
    up = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy(key, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows a key
    handed = ends.select(key, "_part", F.last("_end", ignorenulls=True).over(before).alias("_handed"))
    near = dealt.withColumn("_near", F.last(value, ignorenulls=True).over(up))
    return near.join(handed, [key, "_part"], "left").withColumn("carried", F.coalesce("_near", "_handed")).drop("_near", "_handed", "_part")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: one row for each broken rule; a null condition counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def health(heartbeat_min: Column, forecast_min: Column, coverage_hours: Column, interval_min: int, sources_bad: Column, outcome: Column) -> tuple[Column, Column]:
    """issues and verdict: any fatal issue is unhealthy, other trouble degraded."""
    fresh = max(30, 2 * interval_min)
    issues = F.array_compact(F.array(
        F.when(heartbeat_min > fresh, "stale-heartbeat"),
        F.when(forecast_min.isNull() | (forecast_min > fresh), "stale-forecast"),
        F.when(coverage_hours.isNull() | (coverage_hours < 6), "insufficient-forecast-coverage"),
    ))
    verdict = F.when(F.size(issues) > 0, "unhealthy").when((sources_bad > 0) | (outcome != "fresh"), "degraded").otherwise("healthy")
    return issues, verdict


def health_report(now: Column, every_minutes: int, status: Column, manifest: Column, sources: list[str], expected_version: Column | None = None) -> Column:
    """(issues, verdict) of a run status and the manifest it published, either of them null if it cannot be read.

    status: lastAttemptAt, lastCompleteForecastAt, forecastLastValidTime, outcome. manifest: version, integratedStatus,
    lastValidTime, and states, a map of source to status. A heartbeat or forecast older than twice the interval (30
    minutes at least), under six hours of forecast ahead, a version other than the one expected, and an unavailable
    forecast are fatal: unhealthy. Sources that are not ok, a run that was not fresh and a retained forecast degrade.
    The sources' issues follow the fatal ones.
    """
    fresh = max(30, 2 * every_minutes)
    late = lambda at: (F.unix_timestamp(now) - F.unix_timestamp(at)) > fresh * 60
    until = F.coalesce(manifest["lastValidTime"], status["forecastLastValidTime"])
    fatal = {
        "invalid-status": status.isNull(),
        "invalid-manifest": manifest.isNull(),
        "unexpected-version": manifest["version"] != expected_version if expected_version is not None else F.lit(False),
        "stale-heartbeat": late(status["lastAttemptAt"]),
        "stale-forecast": status["lastCompleteForecastAt"].isNull() | late(status["lastCompleteForecastAt"]),
        "insufficient-forecast-coverage": until.isNull() | (F.unix_timestamp(until) - F.unix_timestamp(now) < 6 * 3600),
        "forecast-unavailable": manifest["integratedStatus"] == "unavailable",
    }
    first = F.array_compact(F.array(*[F.when(F.coalesce(off, F.lit(False)), name) for name, off in fatal.items()]))
    state = lambda s: F.coalesce(F.get(F.filter(F.map_entries(manifest["states"]), lambda e: e["key"] == s), F.lit(0))["value"], F.lit("missing"))
    later = F.array_compact(F.array(*[F.when(manifest.isNotNull() & (state(s) != "ok"), F.concat(F.lit(f"source-{s}-"), state(s))) for s in sources]))
    poor = (F.size(later) > 0) | F.coalesce(status["outcome"] != "fresh", F.lit(True)) | F.coalesce(manifest["integratedStatus"] == "retained", F.lit(False))
    verdict = F.when(F.size(first) > 0, "unhealthy").when(poor, "degraded").otherwise("healthy")
    return F.struct(F.concat(first, later).alias("issues"), verdict.alias("verdict"))


def complete(df: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """expected, actual, missing (sorted list): required keys against those present; one row."""
    have = df.select(key).distinct().withColumn("_have", F.lit(True))
    joined = required.select(key).distinct().join(have, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("expected"), F.count("_have").alias("actual"), F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col(key)))).alias("missing"))

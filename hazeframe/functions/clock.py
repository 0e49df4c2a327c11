"""Time scalars: parsing, hours, freshness labels, playback positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pacific_standard(text: Column) -> Column:
    """UTC of a local time with a fixed offset of -8 hours, in one of four spellings."""
    forms = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]) + F.expr("interval 8 hours")


def local_hour(date: Column, hour: Column, zone: Column) -> Column:
    """UTC of a local date and hour in a zone with daylight saving."""
    return F.to_utc_timestamp(F.to_timestamp(date) + F.make_dt_interval(hours=hour), zone)


def first_time(*texts: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(t) for t in texts])


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60)


def age_label(minutes: Column) -> Column:
    m = F.greatest(F.lit(0), minutes)
    return F.when(m < 1, "now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))


def state_label(status: Column, observed: Column, now: Column) -> Column:
    m = F.greatest(F.lit(0), minutes_between(now, observed))
    aged = F.when(m < 60, F.concat(m.cast("string"), F.lit("m old"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h old")))
    return (
        F.when(status == "unavailable", "Unavailable")
        .when(status == "error", F.when(observed.isNotNull(), "Update failed").otherwise("Error"))
        .when(observed.isNull(), F.when(status == "stale", "Stale").otherwise("Current"))
        .otherwise(aged)
    )


def advanced(position: Column, elapsed: Column, span: Column, speed: float = 1.0) -> Column:
    """Playback position after a tick of at most 250 ms at 3600 times real time."""
    tick = F.least(F.lit(250), F.greatest(F.lit(0), elapsed))
    return F.when(span <= 0, 0).when(position >= span, span).otherwise(F.least(span, F.greatest(F.lit(0), position) + tick * 3600 * speed))


def newest_time(*times: Column) -> Column:
    """The latest of several optional instants."""
    return F.greatest(*times)


def observation_age(minutes: Column) -> Column:
    m = F.greatest(F.lit(0), minutes)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min old"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" hr "), (m % 60).cast("string"), F.lit(" min old")))


def cycle_file(run: Column, hour: Column) -> Column:
    """Folder and file name of one forecast hour of a model cycle."""
    return F.concat(F.date_format(run, "'/hrrr.'yyyyMMdd'/conus/hrrr.t'HH"), F.lit("z.wrfsfcf"), F.lpad(hour.cast("string"), 2, "0"), F.lit(".grib2"))


def timeline_span(times: Column) -> Column:
    """Last minus first of a sorted array of instants; 0 for fewer than two."""
    return F.when(F.size(times) < 2, 0).otherwise(F.greatest(F.lit(0), F.element_at(times, -1) - F.element_at(times, 1)))


def position_of(times: Column, at: Column) -> Column:
    """Distance of an instant from the timeline's start, kept on the timeline; 0 on an empty one."""
    return F.when(F.size(times) == 0, 0).otherwise(F.least(timeline_span(times), F.greatest(F.lit(0), at - F.element_at(times, 1))))


def live_position(times: Column, at: Column) -> Column:
    """position, available: available where the timeline holds that very instant."""
    return F.struct(position_of(times, at).alias("position"), F.array_contains(times, at).alias("available"))


def stepped_position(times: Column, position: Column, delta: Column) -> Column:
    """Position of the next (delta 1) or previous (-1) instant of the timeline, kept on it."""
    at = F.element_at(times, 1) + position
    after, before = F.filter(times, lambda t: t > at), F.filter(times, lambda t: t < at)
    target = F.when(delta > 0, F.coalesce(F.get(after, F.lit(0)), F.element_at(times, -1))).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1)), F.element_at(times, 1)))
    return F.when(F.size(times) == 0, 0).otherwise(target - F.element_at(times, 1))


def refreshed_position(old: Column, new: Column, position: Column, now: Column, live: Column, same: Column) -> Column:
    """Where playback stands after a new timeline replaced the old one: live, unmoved, or at the same instant."""
    kept = F.when(same, position).otherwise(position_of(new, F.element_at(old, 1) + position))
    return F.when(F.size(new) == 0, 0).when(live, position_of(new, now)).when(F.coalesce(F.size(old), F.lit(0)) <= 0, 0).otherwise(kept)


def canonical_hours(now: Column, horizon: int = 72) -> Column:
    """The whole hours from now's on, horizon + 1 of them, as timestamps."""
    start = F.floor(F.unix_timestamp(now) / 3600) * 3600
    return F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda h: F.timestamp_seconds(start + h * 3600))


def normalised_iso(text: Column) -> Column:
    """A time with any offset, or without one in UTC, as ISO text in UTC; null if it is no time."""
    zoned = F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\z"), text).otherwise(F.concat(text, F.lit("Z")))
    return iso(F.try_to_timestamp(zoned))

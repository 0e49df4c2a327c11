"""Air-quality scalars: NowCast, index formulas, categories, unit and area conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public PM2.5 index: tenths of µg/m³ (low, high) and index (low, high).
BREAKPOINTS = [(0, 90, 0, 50), (91, 354, 51, 100), (355, 554, 101, 150), (555, 1254, 151, 200), (1255, 2254, 201, 300), (2255, 3254, 301, 500)]
CATEGORIES = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"), (200, "Unhealthy"), (300, "Very Unhealthy"), (500, "Hazardous")]
ACRE_HECTARES = 0.404685642


def usable(v: Column) -> Column:
    """Finite and not negative, else null."""
    return F.when((v >= 0) & (v < float("inf")), v)


def tenths(v: Column) -> Column:
    """Tenths truncated towards zero as an integer; the rounding only removes binary noise before truncation."""
    return F.round(v * 10, 6).cast("int")


def nowcast(slots: Column) -> Column:
    """NowCast of an array of 12 hourly values, newest first, null for a gap.

    Two of the newest three hours must be there. Gaps keep their exponent. Null if there is too little data.
    """
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  worked out once, not for each use
    recent = F.size(F.filter(F.slice(slots, 1, 3), lambda v: v.isNotNull()))

    def weight(ends: Column) -> Column:
        high, low = ends["high"], ends["low"]
        return F.when(high == 0, F.when(low == 0, 1.0).otherwise(0.5)).otherwise(F.greatest(F.lit(0.5), F.try_divide(low, high)))

    def mean(w: Column) -> Column:
        pairs = F.transform(slots, lambda v, i: F.struct(v.alias("v"), F.when(v.isNotNull(), F.pow(w, i)).otherwise(0.0).alias("w")))
        add = lambda a, x: F.struct((a["t"] + F.coalesce(x["v"] * x["w"], F.lit(0.0))).alias("t"), (a["w"] + x["w"]).alias("w"))
        return F.aggregate(pairs, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w")), add, lambda a: F.try_divide(a["t"], a["w"]))

    ends = bound(F.filter(slots, lambda v: v.isNotNull()), lambda known: F.struct(F.array_max(known).alias("high"), F.array_min(known).alias("low")))
    value = bound(bound(ends, weight), mean)
    value = bound(value, lambda v: F.when((v > -5) & (v < 0), 0.0).otherwise(v))
    return F.when(recent >= 2, tenths(value) / 10)


def pm25_index(tenth: Column) -> Column:
    """Piecewise linear index of truncated tenths, half up; the last slope continues, below 0 counts as 0."""
    out = F.lit(None).cast("int")
    tenth = F.when(tenth.isNotNull(), F.greatest(F.lit(0), tenth))
    for n, (klo, khi, ilo, ihi) in reversed(list(enumerate(BREAKPOINTS))):
        line = (F.floor(((ihi - ilo) * (tenth - klo) * 2 + (khi - klo)) / F.lit(2 * (khi - klo))) + ilo).cast("int")
        out = F.when(tenth >= klo if n == len(BREAKPOINTS) - 1 else tenth <= khi, line).otherwise(out)
    return F.when(tenth >= 0, out)


def index_category(index: Column) -> Column:
    out = F.lit("Beyond the AQI")
    for top, name in reversed(CATEGORIES):
        out = F.when(index <= top, name).otherwise(out)
    return F.when(index.isNotNull(), out)


def health_index_display(v: Column) -> Column:
    """"10+" above 10, else 1 to 10, half up."""
    return F.when(v > 10, "10+").otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.floor(v + 0.5))).cast("string"))


def health_index_category(v: Column) -> Column:
    shown = F.floor(v + 0.5)
    return F.when(v > 10, "Very High").when(shown <= 3, "Low").when(shown <= 6, "Moderate").otherwise("High")


def hectares(*acres: Column) -> Column:
    """First known area in hectares, three decimals."""
    return F.round(F.coalesce(*acres) * ACRE_HECTARES, 3)


def risk_rank(system: Column, category: Column) -> Column:
    c = F.lower(category)
    health = F.when(c == "very high", 3).when(c == "high", 2).when(c == "moderate", 1).otherwise(0)
    other = F.when(c.isin("unhealthy", "very unhealthy", "hazardous", "beyond the aqi"), 3).when(c == "unhealthy for sensitive groups", 2).when(c == "moderate", 1).otherwise(0)
    return F.when(system == "ca-aqhi", health).otherwise(other)


def severity(system: Column, value: Column) -> Column:
    return F.least(F.lit(1.0), value / F.when(system == "ca-aqhi", 11.0).otherwise(500.0))


def index_colour(index: Column) -> Column:
    out = F.lit("#7e0023")
    for top, colour in [(300, "#8f3f97"), (200, "#ff0000"), (150, "#ff7e00"), (100, "#ffff00"), (50, "#00e400")]:
        out = F.when(index <= top, colour).otherwise(out)
    return out


def index_label(system: Column, value: Column) -> Column:
    return F.concat(F.when(system == "ca-aqhi", "AQHI ").otherwise("AQI "), value)


def is_mass_unit(unit: Column) -> Column:
    """µg/m³ in any of its spellings."""
    plain = F.upper(F.regexp_replace(F.translate(unit, "µμ³", "uu3"), r"\s", ""))
    return plain == "UG/M3"


def micrograms(kilograms: Column) -> Column:
    return kilograms / 1e-9


def blend(low: Column, high: Column, t: Column, low_covered: Column, high_covered: Column) -> Column:
    """Coverage-aware interpolation: one covered side stands alone, none gives null."""
    mix = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    a, b = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))
    return F.when(low_covered & high_covered, a + (b - a) * mix).when(high_covered, b).when(low_covered, a)


def faint_alpha(v: Column) -> Column:
    return F.lit(40 / 255) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def surface_blend(low: Column, high: Column, t: Column) -> Column:
    """Blend of two samples (value, covered, coverage): one covered side stands alone, none gives null."""
    mix = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    both = F.struct(*[(F.lit(True) if c == "covered" else low[c] + (high[c] - low[c]) * mix).alias(c) for c in ("value", "covered", "coverage")])
    return F.when(low["covered"] & high["covered"], both).when(high["covered"], high).when(low["covered"], low)

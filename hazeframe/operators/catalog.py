"""Curated sets that must be whole, and forecast hours that must be what was asked for: rules over rows and over sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions import geo

RANKS = 20  # fixed value: landmarks of a country
TIERS = {5: "detail-major", 10: "detail-regional", 15: "detail-local"}  # fixed values: up to which rank; "local" beyond
PER_CATEGORY = {"natural": 7, "park": 7, "cultural": 6}  # fixed values: of which sorts


def landmark_faults(records: DataFrame, countries: list[str]) -> DataFrame:
    """subject, rule: what is wrong with a landmark list (qid, country, category, rank, lon, lat); none for a good one.

    Rules over a row name its qid: its form, country and category, rank, place. Rules over the set name what repeats (a
    qid, or a country's rank) or the country and what it lacks: a rank from 1 to RANKS or the right number of a category.
    Only rows of known countries count for the latter.
    """
    known = F.coalesce(F.col("country").isin(countries) & F.col("category").isin(list(PER_CATEGORY)), F.lit(False))
    ranked = F.coalesce(F.col("rank").between(1, RANKS), F.lit(False))
    own = {"id": F.coalesce(F.col("qid").rlike(r"\AQ[0-9]+\z"), F.lit(False)), "classification": known, "rank": ranked, "place": geo.in_display(F.col("lon"), F.col("lat"))}
    rows = records.select("qid", F.explode(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in own.items()]))).alias("rule")).select(F.coalesce("qid", F.lit("")).alias("subject"), "rule")
    again = records.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND qid IS NOT NULL").select(F.col("qid").alias("subject"), F.lit("repeated id").alias("rule"))
    taken = records.where(ranked & known).groupBy("country", "rank").agg(F.count(F.lit(1)).alias("n"))
    both = taken.where("n > 1").select(F.concat_ws(":", "country", "rank").alias("subject"), F.lit("repeated rank").alias("rule"))
    spark = records.sparkSession
    due = spark.createDataFrame([(c,) for c in countries], "country string").select("country", F.explode(F.sequence(F.lit(1), F.lit(RANKS))).alias("rank"))
    lacking = due.join(taken, ["country", "rank"], "left_anti").select(F.concat_ws(":", "country", "rank").alias("subject"), F.lit("missing rank").alias("rule"))
    right = spark.createDataFrame([(c, k, n) for c in countries for k, n in PER_CATEGORY.items()], "country string, category string, due long")
    have = records.where(known).groupBy("country", "category").agg(F.count(F.lit(1)).alias("n"))
    off = right.join(have, ["country", "category"], "left").where("coalesce(n, 0) <> due").select(F.concat_ws(":", "country", "category").alias("subject"), F.lit("category count").alias("rule"))
    return rows.unionByName(again).unionByName(both).unionByName(lacking).unionByName(off)


def landmarks(records: DataFrame, countries: list[str]) -> DataFrame:
    """id, name, lon, lat, country, category, tier, place (order by rank, then qid) of a list without a fault; else it fails."""
    bad = landmark_faults(records, countries).orderBy("rule", "subject").first()
    if bad is not None:
        raise ValueError(f"{bad['rule']}: {bad['subject']}")
    # a good list has RANKS rows a country
    place = F.row_number().over(Window.partitionBy().orderBy("rank", "qid"))
    tier = F.lit("local")
    for last, name in reversed(TIERS.items()):
        tier = F.when(F.col("rank") <= last, name).otherwise(tier)
    return records.select(F.concat(F.lit("wikidata:"), "qid").alias("id"), "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "country", "category", tier.alias("tier"), place.alias("place"))


def native_hours(requests: DataFrame, fields: DataFrame, cells: DataFrame, longest: int = 48, slack: int = 60) -> DataFrame:
    """run, valid, hour, fault of the forecast hours asked for (run, valid: timestamps).

    fields: run, valid, stated (the time the decoded field gives itself); cells: run, valid, value. The hour is whole hours
    from run to valid, from 0 to longest; the field must be there, state its time to within slack seconds, and hold one
    finite value at least. fault names the first rule that fails, null for a good hour.
    """
    usable = cells.groupBy("run", "valid").agg(F.count_if(geo.finite(F.col("value"))).alias("_n"))
    hour = F.floor((F.unix_timestamp("valid") - F.unix_timestamp("run")) / 3600).cast("int")
    both = requests.join(fields.select("run", "valid", "stated"), ["run", "valid"], "left").join(usable, ["run", "valid"], "left").withColumn("hour", hour)
    fault = F.when(~F.col("hour").between(0, longest), "hour").when(F.col("stated").isNull(), "missing").when(F.abs(F.unix_timestamp("stated") - F.unix_timestamp("valid")) > slack, "valid-time").when(F.coalesce("_n", F.lit(0)) == 0, "cells")
    return both.select("run", "valid", "hour", fault.alias("fault"))

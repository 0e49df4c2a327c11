"""Published assets: envelopes {count, monitors[], sourceCount} and {incidents[]}, one JSON document a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.operators import contract
from hazeframe.operators.staging import staged
from hazeframe.sources.files import exists

OK, MISSING, CORRUPT, COUNT = "ok", "missing", "corrupt", "count"


def envelopes(spark: SparkSession, assets: list[tuple[str, str]], items: str) -> tuple[DataFrame, DataFrame]:
    """Items (source, precedence, path, ord, item as JSON) and outcomes (source, precedence, status, stated, found).

    An asset is a file, or a folder of files, named with its source; precedence is its place in the list. Its items keep
    their order by file and place in the file, however the files are read. An asset that is not there is missing, and
    one with a file that is no JSON object or whose items are no list is corrupt: either has no items. One whose files
    state another count than they hold is marked, and its items are used. An envelope without items is an empty one.
    """
    there = [(n, source, path) for n, (source, path) in enumerate(assets) if exists(spark, path)]
    outcomes = [(source, n, MISSING) for n, (source, path) in enumerate(assets) if not exists(spark, path)]
    lost = spark.createDataFrame(outcomes, "source string, precedence int, status string").select("*", F.lit(None).cast("long").alias("stated"), F.lit(0).cast("long").alias("found"))
    bodies = None
    for n, source, path in there:
        own = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        own = own.select(F.lit(source).alias("source"), F.lit(n).alias("precedence"), F.col("_metadata.file_path").alias("path"), "value")
        bodies = own if bodies is None else bodies.unionByName(own)
    if bodies is None:
        empty = spark.createDataFrame([], "source string, precedence int, path string, ord int, item string")
        return empty, lost
    doc = F.try_parse_json("value")
    listed = F.try_variant_get(doc, f"$.{items}", "array<variant>")
    held = F.try_variant_get(doc, f"$.{items}", "variant")
    absent = held.isNull() | F.is_variant_null(held)
    good = F.btrim("value").startswith("{") & doc.isNotNull() & (listed.isNotNull() | absent)
    parsed = staged(bodies.select("source", "precedence", "path", F.coalesce(good, F.lit(False)).alias("good"), F.transform(listed, lambda x: F.to_json(x)).alias("items"), F.try_variant_get(doc, "$.count", "long").alias("stated")))
    files = parsed.groupBy("source", "precedence").agg(F.bool_and("good").alias("good"), F.sum(F.when(F.col("stated").isNotNull(), F.coalesce(F.size("items"), F.lit(0)) != F.col("stated")).otherwise(False).cast("int")).alias("off"), F.sum("stated").alias("stated"), F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("found"))
    status = F.when(~F.col("good"), CORRUPT).when(F.col("off") > 0, COUNT).otherwise(OK)
    seen = files.select("source", "precedence", status.alias("status"), "stated", F.when(F.col("good"), F.col("found")).otherwise(0).cast("long").alias("found"))
    # an asset without a single file has no row yet
    named = spark.createDataFrame([(source, n) for n, source, _ in there], "source string, precedence int")
    seen = named.join(seen, ["source", "precedence"], "left").select("source", "precedence", F.coalesce("status", F.lit(MISSING)).alias("status"), "stated", F.coalesce("found", F.lit(0).cast("long")).alias("found"))
    broken = files.where(~F.col("good")).select("source", "precedence")
    rows = parsed.join(broken, ["source", "precedence"], "left_anti").select("source", "precedence", "path", F.posexplode("items").alias("ord", "item"))
    return rows, seen.unionByName(lost)


def loaded(outcomes: DataFrame) -> bool:
    """Whether all assets are whole; False for a partial failure. If not one could be read, the load fails."""
    counts = {r["status"]: r["n"] for r in outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not counts.get(OK) and not counts.get(COUNT):
        raise ValueError("no asset could be read")
    return set(counts) <= {OK}


def monitors(spark: SparkSession, assets: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Monitors of all assets that can be read, normalised, and the outcomes. Rows that break the contract go; the order
    of precedence, path and ord, in which stations are merged, stays with them."""
    rows, outcomes = envelopes(spark, assets, "monitors")
    loaded(outcomes)
    clash = rows.select(F.col("source").alias("asset"), "precedence", "path", "ord", F.from_json("item", contract.MONITOR).alias("m"))
    return contract.normalised(clash.select("asset", "precedence", "path", "ord", "m.*").where(contract.valid_monitor())), outcomes


def incidents(spark: SparkSession, assets: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Incidents of all assets that can be read, and the outcomes; of an id the last valid one in order wins.

    Files are numbered in order, so that a row's place is one number and the last one of an id a hash aggregation; whole
    incidents are read again for the winners only, and never sorted.
    """
    rows, outcomes = envelopes(spark, assets, "incidents")
    loaded(outcomes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.select("precedence", "path").distinct().repartitionByRange(parts, "precedence", "path").sortWithinPartitions("precedence", "path")
    numbered = staged(names.withColumn("file", F.monotonically_increasing_id()))  # written numbers hold
    parsed = F.explode(F.array(F.from_json("item", contract.INCIDENT)))  # a filter over its fields parses an item once, not for each field
    known = rows.select("precedence", "path", "ord", parsed.alias("m")).select("precedence", "path", "ord", "m.*").where(contract.valid_incident())
    place = F.col("file").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("ord")
    last = known.select("precedence", "path", "ord", "id").join(numbered, ["precedence", "path"]).groupBy("id").agg(F.max(place).alias("place"))
    first = F.floor(F.col("place") / F.lit(2**31).cast("decimal(10,0)")).cast("long")
    won = staged(last.select(first.alias("file"), F.pmod("place", F.lit(2**31).cast("decimal(10,0)")).cast("int").alias("ord")).join(numbered, "file").drop("file"))
    whole = rows.join(won, ["precedence", "path", "ord"]).select(F.from_json("item", contract.INCIDENT).alias("m"))
    return whole.select("m.*"), outcomes

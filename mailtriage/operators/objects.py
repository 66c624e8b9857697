"""Listing of stored objects, existence checks and the intake filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtriage.functions.text import size_label
from mailtriage.sources.workspace import workspace


def _matching(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.startswith(F.col("key"), F.lit(prefix))) if prefix else objects


def list_objects(
    objects: DataFrame,
    prefix: str = "",
    max_items: int = 100,
    detail: str = "basic",
    bucket: str | None = None,
) -> DataFrame:
    """The first ``max_items`` objects in key order, numbered by age (oldest is 1). The cut comes
    first; the numbering window sees at most ``max_items`` rows."""
    if detail not in ("basic", "full"):
        raise ValueError(f"detail must be 'basic' or 'full', not {detail!r}")
    page = _matching(objects, prefix).orderBy("key").limit(max_items)
    number = F.row_number().over(Window.orderBy("last_modified", "key"))
    if detail == "basic":
        return page.select(number.alias("number"), "key")
    # Shown in UTC, whatever the session's time zone.
    modified = F.to_utc_timestamp(F.col("last_modified"), F.current_timezone())
    path = F.concat(F.lit(f"s3://{bucket}/"), F.col("key")) if bucket else F.col("key")
    return page.select(
        number.alias("number"),
        "key",
        "size",
        size_label(F.col("size")).alias("size_label"),
        F.date_format(modified, "yyyy-MM-dd HH:mm:ss").alias("last_modified"),
        path.alias("path"),
    )


def listing_summary(objects: DataFrame, prefix: str = "", max_items: int = 100) -> DataFrame:
    """One row: objects returned by a listing, whether it is empty, whether more objects match."""
    matched = F.count(F.lit(1))
    return _matching(objects, prefix).agg(
        F.least(matched, F.lit(max_items).cast("bigint")).alias("returned"),
        (matched == 0).alias("is_empty"),
        (matched > max_items).alias("truncated"),
    )


def present_objects(requested: DataFrame, objects: DataFrame, on: str = "key") -> DataFrame:
    """Requested rows whose object is stored."""
    return requested.join(objects.select(on), on, "left_semi")


def missing_objects(requested: DataFrame, objects: DataFrame, on: str = "key") -> DataFrame:
    """Requested rows whose object is not stored."""
    return requested.join(objects.select(on), on, "left_anti")


def requested_objects(objects: DataFrame, requested: DataFrame, on: str = "key") -> DataFrame:
    """Stored objects that are asked for, each once. Repeated requests for one key are folded before
    the shuffle, so a key that fills a large part of ``requested`` costs one row per task (the hash
    beside the key leaves the join its own shuffle, see ``single_responses``). The objects' rows
    are shuffled unless Spark finds one side small enough to broadcast, so they should hold no contents."""
    asked = requested.select(on, F.xxhash64(on).alias("_hash")).distinct().select(on)
    return objects.join(asked, on, "left_semi")


def store_listing(listing: DataFrame, table: str, buckets: int = 200, on: str = "key") -> DataFrame:
    """Keep a listing as a table in buckets of its key, in the session's warehouse, and return it: checks and replays that
    join on the key read it where it lies and shuffle the requests alone. ``buckets`` is for the size of the listing; a
    session joins without a shuffle if its ``spark.sql.shuffle.partitions`` is not larger. An older table of that name is
    replaced."""
    listing.write.bucketBy(buckets, on).sortBy(on).mode("overwrite").saveAsTable(table)
    return listing.sparkSession.table(table)


def work_units(listing: DataFrame, unit_bytes: int, key: str = "key", size: str = "size") -> DataFrame:
    """Adds ``unit``: objects in key order, numbered by how many times ``unit_bytes`` their forerunners hold. So a unit
    holds less than ``unit_bytes`` before its last object, and an object that is larger ends one: what comes next goes to
    a later unit. The running sum has two levels, within ranges of keys and over the ranges; no task sees all objects.
    The listing is written once to the shared folder, so that its ranges stay what they are."""
    order, spark = [key, size], listing.sparkSession
    ranged = listing.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    ranged = ranged.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    path = workspace(spark, "listing-ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    in_range = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_sum"))  # one row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.coalesce(F.sum("_size").over(in_range), F.lit(0)))
    unit = F.floor((F.col("_own") + F.col("_before")) / F.lit(unit_bytes)).cast("long")
    return own.join(sums, "_range").withColumn("unit", unit).drop("_size", "_range", "_own", "_before")


def addressed_to(to_addresses: Column, recipients: Sequence[str]) -> Column:
    """True when one of the recipients is among the addresses (an array of lower-case strings)."""
    return F.arrays_overlap(to_addresses, F.array(*(F.lit(r.lower()) for r in recipients)))


def intake(mail: DataFrame, recipients: Sequence[str]) -> DataFrame:
    """Parsed mail addressed to one of the recipients, or whose recipients are not known (it could not be read, and
    its error has to be reported); all mail when none is named. Given to ``parse_mail``, the recipients spare the work
    on other mail."""
    known = F.col("to_addrs").isNotNull()
    return mail.where(~known | addressed_to(F.col("to_addrs"), recipients)) if recipients else mail

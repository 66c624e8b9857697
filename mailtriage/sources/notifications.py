"""Object-created notifications: read them, and build them for a replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage import constants as k

# What a consumer needs of a notification; other fields are skipped while parsing.
LOCATION_SCHEMA = (
    "Records ARRAY<STRUCT<s3: STRUCT<bucket: STRUCT<name: STRING>, object: STRUCT<key: STRING>>>>"
)


def parse_notifications(events: DataFrame, event_col: str = "event", all_records: bool = False) -> DataFrame:
    """Adds ``bucket``, ``key`` and ``error`` to the notification rows. Only the first record counts
    unless ``all_records``; keys are taken as they are, without URL decoding."""
    records = F.from_json(F.col(event_col), LOCATION_SCHEMA)["Records"]
    if all_records:
        located = events.withColumn("_record", F.explode_outer(records))
    else:
        located = events.withColumn("_record", F.get(records, F.lit(0)))
    s3 = F.col("_record.s3")
    located = located.withColumns({"bucket": s3["bucket"]["name"], "key": s3["object"]["key"]})
    missing = F.col("bucket").isNull() | F.col("key").isNull()
    return located.withColumn("error", F.when(missing, F.lit("no object in notification"))).drop("_record")


def notification(bucket: Column, key: Column) -> Column:
    """The notification of one object as JSON text, for replaying it."""

    def principal() -> Column:
        return F.struct(F.lit(k.NOTIFICATION_PRINCIPAL).alias("principalId"))

    store = F.struct(
        F.lit(k.NOTIFICATION_SCHEMA_VERSION).alias("s3SchemaVersion"),
        F.lit(k.NOTIFICATION_CONFIGURATION).alias("configurationId"),
        F.struct(
            bucket.alias("name"),
            principal().alias("ownerIdentity"),
            F.concat(F.lit(k.NOTIFICATION_ARN_PREFIX), bucket).alias("arn"),
        ).alias("bucket"),
        F.struct(
            key.alias("key"),
            F.lit(0).alias("size"),
            F.lit(k.NOTIFICATION_TAG).alias("eTag"),
            F.lit(None).cast("string").alias("versionId"),
            F.lit(k.NOTIFICATION_TAG).alias("sequencer"),
        ).alias("object"),
    )
    record = F.struct(
        F.lit(k.NOTIFICATION_VERSION).alias("eventVersion"),
        F.lit(k.NOTIFICATION_SOURCE).alias("eventSource"),
        F.lit(k.NOTIFICATION_REGION).alias("awsRegion"),
        F.lit(k.NOTIFICATION_TIME).alias("eventTime"),
        F.lit(k.NOTIFICATION_NAME).alias("eventName"),
        principal().alias("userIdentity"),
        F.struct(F.lit(k.NOTIFICATION_ADDRESS).alias("sourceIPAddress")).alias("requestParameters"),
        F.struct(
            F.lit(k.NOTIFICATION_REQUEST_ID).alias("x-amz-request-id"),
            F.lit(k.NOTIFICATION_TAG).alias("x-amz-id-2"),
        ).alias("responseElements"),
        store.alias("s3"),
    )
    return F.to_json(F.struct(F.array(record).alias("Records")), {"ignoreNullFields": "false"})


def build_notifications(objects: DataFrame, bucket: str, key_col: str = "key") -> DataFrame:
    """A replay manifest: one notification per listed object."""
    return objects.select(key_col, notification(F.lit(bucket), F.col(key_col)).alias("event"))

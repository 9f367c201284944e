"""Fixed schemas: nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The fact table. `event_date` is its partition column, `ingest_batch` names the micro-batch
# that stored the row.
EVENT_FIELDS = [
    T.StructField("event_id", T.StringType(), False),
    T.StructField("organization_id", T.LongType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("occurred_at", T.TimestampType(), False),
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("metadata", T.StringType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("anonymous_id", T.StringType(), True),
    T.StructField("actor_id", T.StringType(), True),
]
EVENTS = T.StructType(EVENT_FIELDS)
STORED_EVENTS = T.StructType(
    EVENT_FIELDS
    + [
        T.StructField("ingest_batch", T.StringType(), True),
        T.StructField("event_date", T.DateType(), False),
    ]
)
# No tenant has this number; a row with it stands in for a date without any other.
NOBODY = -(1 << 63)

# What one batch adds to a day: events of a type, and links of anonymous ids.
DAILY = T.StructType(
    [
        T.StructField("organization_id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("ingest_batch", T.StringType(), True),
        T.StructField("count", T.LongType(), False),
        T.StructField("last_at", T.TimestampType(), False),
        T.StructField("event_date", T.DateType(), False),
    ]
)
LINKS = T.StructType(
    [
        T.StructField("organization_id", T.LongType(), False),
        T.StructField("anonymous_id", T.StringType(), True),
        T.StructField("since", T.TimestampType(), False),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("event_date", T.DateType(), False),
    ]
)

ORGANIZATIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("api_key_hash", T.StringType(), False),
        T.StructField("api_key_prefix", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

# A record as it arrives. Every field is VARIANT so that a wrong type is a
# finding about one field and not the loss of the record.
REQUEST = T.StructType(
    [
        T.StructField(name, T.VariantType())
        for name in ("eventId", "eventType", "occurredAt", "userId", "anonymousId", "metadata")
    ]
)
REQUEST_BATCH = T.StructType([T.StructField("events", T.ArrayType(REQUEST))])

# A record between attribution and storage: a request plus its tenant.
TENANT_EVENT = T.StructType(
    REQUEST.fields + [T.StructField("organizationId", T.VariantType())]
)

CORRUPT = T.StructField("_corrupt_record", T.StringType())

AUDIT = T.StructType(
    [
        T.StructField("received", T.LongType(), False),
        T.StructField("invalid", T.LongType(), False),
        T.StructField("rejected", T.LongType(), False),
        T.StructField("persisted", T.LongType(), False),
        T.StructField("deduplicated", T.LongType(), False),
    ]
)
# `admitted` names the batches of messages that a batch of rows accounts for.
BATCH_AUDIT = T.StructType(
    AUDIT.fields
    + [
        T.StructField("ingest_batch", T.StringType(), False),
        T.StructField("admitted", T.ArrayType(T.StringType()), True),
    ]
)

# A message on its way from the stream that reads it to the stream that stores it (`kind` is
# `event`, or `rejected` with its text), the counts of a batch of them (`counts`), or an id that
# is stored already (`known`).
ARRIVALS = T.StructType(
    [T.StructField(field.name, field.dataType) for field in EVENT_FIELDS if field.name not in ("received_at", "actor_id")]
    + [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("reason", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("arrived_in", T.StringType()),
        T.StructField("received", T.LongType()),
        T.StructField("invalid", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("valid", T.LongType()),
    ]
)

# A message that was not stored, and why; `day` is the partition column.
LETTERS = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ingest_batch", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

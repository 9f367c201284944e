"""From raw records to rows of the event table, as DataFrame transforms.

The same functions serve a batch load and every micro-batch of a stream.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.ids import derived_id, is_uuid
from footfall.functions.metadata import canonical
from footfall.functions.text import api_key_hash, blank, blank_to_null, utf16_length
from footfall.plans.skew import known, lookup
from footfall.schema import CORRUPT, REQUEST_BATCH, TENANT_EVENT

# Fixed value: the longest event type or id, in UTF-16 units.
MAX_TEXT = 200

# How an instant may be written. A number counts seconds.
ISO_INSTANT = (
    r"^[+-]?\d{4,6}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d{0,9})?([Zz]|[+-]\d\d(:?\d\d(:?\d\d)?)?)$"
)
EPOCH_SECONDS = r"^-?\d+(\.\d+)?$"
# The storable range: instants whose microseconds since 1970 fit a 64-bit number, that is, the
# years -290308 to 294247. Anything else is a wrong value of its field and no more than that.

# Strict JSON: no single quotes, no NaN.
STRICT_JSON = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT.name,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}

POSITION = ["partition", "offset"]


# --- decoding ---------------------------------------------------------------


def decode(records: DataFrame, shape: T.StructType = TENANT_EVENT) -> DataFrame:
    """Parse the JSON in ``value`` into ``record``; NULL where it is not a JSON object.

    A record that cannot be read costs only itself, not its neighbours.
    """
    with_corrupt = T.StructType(shape.fields + [CORRUPT])
    parsed = F.from_json("value", with_corrupt, STRICT_JSON)
    rows = records.withColumn("record", parsed)
    readable = F.col("record").isNotNull() & F.col(f"record.{CORRUPT.name}").isNull()
    return rows.withColumn("record", F.when(readable, F.col("record")))


def decode_batches(records: DataFrame) -> DataFrame:
    """Records that hold ``{"events": [...]}`` as one row per event, with its place in
    the list in ``position``.

    A list is taken as a whole: ``list_errors`` is not empty for all of its events if
    there are none or if one of them is not acceptable. An unreadable record or an
    empty list stays as one row without ``record``.
    """
    rows = decode(records, REQUEST_BATCH)
    listed = F.col("record.events")
    refused = F.exists(listed, lambda event: F.size(request_errors(event)) > 0)
    errors = (
        F.when(F.col("record").isNull(), F.array(error("body", "cannot be read")))
        .when(F.coalesce(F.size(listed), F.lit(0)) <= 0, F.array(error("events", "must not be empty")))
        .when(refused, F.array(error("events", "hold an event that is not acceptable")))
        .otherwise(F.array().cast(ERRORS))
    )
    return (
        rows.withColumn("list_errors", errors)
        .select("*", F.posexplode_outer(listed).alias("position", "event"))
        .withColumn("record", F.col("event"))
        .drop("event")
    )


# --- checks and defaults ----------------------------------------------------

ERRORS = "array<struct<field:string,message:string>>"


def error(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def raw_text(value: Column) -> Column:
    """A JSON value as text, whatever its type."""
    return F.try_variant_get(value, "$", "string")


def text_of(value: Column, raw: Column | None = None) -> Column:
    """A JSON string, number or boolean as text; NULL for what is nested."""
    raw = raw_text(value) if raw is None else raw
    # The type is only looked up where the text leaves it open.
    doubtful = raw.startswith("{") | raw.startswith("[")
    return F.when(~(doubtful & F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")), raw)


def _given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def instant_of(text: Column) -> Column:
    """The instant a text or number stands for; NULL for any other and beyond the range."""
    micros = (text.try_cast("decimal(30,9)") * 1_000_000).try_cast("long")
    return F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp")).when(
        text.rlike(EPOCH_SECONDS), F.timestamp_micros(micros)
    )


def request_errors(record: Column) -> Column:
    """What is wrong with a request, field by field; empty if nothing is."""
    event_type, event_id = text_of(record["eventType"]), text_of(record["eventId"])
    checks = [
        F.when(blank(event_type), error("eventType", "is required")),
        F.when(
            utf16_length(event_type) > MAX_TEXT,
            error("eventType", f"must be at most {MAX_TEXT} characters"),
        ),
        F.when(
            _given(record["eventId"]) & ~F.coalesce(is_uuid(event_id), F.lit(False)),
            error("eventId", "must be a UUID"),
        ),
        F.when(
            _given(record["occurredAt"]) & instant_of(text_of(record["occurredAt"])).isNull(),
            error("occurredAt", "must be an ISO-8601 instant"),
        ),
        F.when(
            _given(record["metadata"]) & canonical(record["metadata"]).isNull(),
            error("metadata", "must be an object"),
        ),
    ]
    for field in ("userId", "anonymousId"):
        text = text_of(record[field])
        checks.append(
            F.when(
                (_given(record[field]) & text.isNull()) | (utf16_length(text) > MAX_TEXT),
                error(field, f"must be a text of at most {MAX_TEXT} characters"),
            )
        )
    return F.array_compact(F.array(*checks))


def validate(records: DataFrame) -> DataFrame:
    """Decoded requests with their ``errors``."""
    unreadable = F.array(error("body", "cannot be read"))
    found = F.when(F.col("record").isNull(), unreadable).otherwise(request_errors(F.col("record")))
    if "list_errors" in records.columns:
        own = F.when(F.col("record").isNull(), F.array().cast(ERRORS)).otherwise(found)
        found = F.concat("list_errors", own)
    return records.withColumn("errors", found)


def with_defaults(records: DataFrame, source: list[str], arrived_at: Column) -> DataFrame:
    """Requests as event columns.

    A missing id is derived from the ``source`` columns, which name the record, and a
    missing time is ``arrived_at``; both are the same when a batch is run again.
    """
    record = F.col("record")
    event_id = F.lower(text_of(record["eventId"]))
    return records.withColumns(
        {
            "event_id": F.coalesce(event_id, derived_id(*map(F.col, source))),
            "event_type": text_of(record["eventType"]),
            "occurred_at": F.coalesce(instant_of(text_of(record["occurredAt"])), arrived_at),
            "metadata": F.coalesce(canonical(record["metadata"]), F.lit("{}")),
            "user_id": text_of(record["userId"]),
            "anonymous_id": text_of(record["anonymousId"]),
        }
    ).drop("record")


# --- tenants ----------------------------------------------------------------


def attribute(
    requests: DataFrame,
    organizations: DataFrame,
    spread_by: list[str],
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``organization_id`` from the key in ``api_key``; NULL for an unknown or missing
    one. Nothing in the body can name a tenant."""
    keys = organizations.select(
        F.col("api_key_hash").alias("_key_hash"), F.col("id").alias("organization_id")
    )
    hashed = F.when(~blank(F.col("api_key")), api_key_hash(F.col("api_key")))
    return lookup(
        requests.withColumn("_key_hash", hashed),
        keys,
        "_key_hash",
        spread_by,
        broadcast_rows,
    ).drop("_key_hash")


def with_known_tenant(
    rows: DataFrame,
    organizations: DataFrame,
    spread_by: list[str],
) -> DataFrame:
    """``known_tenant``: whether the organization of a row exists."""
    tenants = organizations.select(
        F.col("id").cast("string").alias("_tenant"), F.lit(True).alias("_exists")
    )
    found = lookup(
        rows.withColumn("_tenant", F.col("organization_id").cast("string")),
        tenants,
        "_tenant",
        spread_by,
    )
    exists = F.coalesce("_exists", F.lit(False))
    return found.withColumn("known_tenant", exists).drop("_tenant", "_exists")


# --- the record between the two halves ---------------------------------------


def to_messages(events: DataFrame) -> DataFrame:
    """Events as ``(key, value)``: keyed by tenant, so that a tenant keeps its order."""
    body = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("organization_id").alias("organizationId"),
        F.col("event_type").alias("eventType"),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurredAt"),
        F.parse_json("metadata").alias("metadata"),
        F.col("user_id").alias("userId"),
        F.col("anonymous_id").alias("anonymousId"),
    )
    return events.select(
        F.col("organization_id").cast("string").alias("key"), F.to_json(body).alias("value")
    )


def from_messages(messages: DataFrame) -> DataFrame:
    """Messages as event columns, with what happened to each in ``outcome``.

    ``invalid`` is a message that cannot be read: not a JSON object, or with a field of
    a wrong type. ``rejected``, with a ``reason``, is one that lacks what the event
    table requires. Any other is ``valid``.
    """
    record = F.col("record")
    # The texts are columns of their own, as they are looked at more than once.
    texts = {
        "event_id": "eventId",
        "event_type": "eventType",
        "occurred_at": "occurredAt",
        "user_id": "userId",
        "anonymous_id": "anonymousId",
    }
    readings = {name: raw_text(record[field]) for name, field in texts.items()}
    readings["organization_id"] = F.try_variant_get(record["organizationId"], "$", "bigint")
    readings["metadata"] = canonical(record["metadata"])
    values = {
        "event_id": F.when(is_uuid(F.col("event_id")), F.lower("event_id")),
        "occurred_at": instant_of(F.col("occurred_at")),
    } | {
        name: text_of(record[texts[name]], F.col(name))
        for name in ("event_type", "user_id", "anonymous_id")
    }
    fields = texts | {"organization_id": "organizationId", "metadata": "metadata"}
    needed = ("event_id", "organization_id", "event_type", "occurred_at")
    wrong_type = [F.col(name).isNull() & _given(record[field]) for name, field in fields.items()]
    missing = [F.col(name).isNull() for name in needed]
    outcome = (
        F.when(record.isNull() | reduce(or_, wrong_type), "invalid")
        .when(reduce(or_, missing), "rejected")
        .otherwise("valid")
    )
    names = (F.when(F.col(name).isNull(), F.lit(name)) for name in needed)
    reason = F.concat(F.lit("no "), F.concat_ws(", ", *names))
    return (
        decode(messages)
        .withColumns(readings)
        .withColumns(values)
        .withColumn("outcome", outcome)
        .withColumns(
            {
                "metadata": F.coalesce("metadata", F.lit("{}")),
                "user_id": blank_to_null(F.col("user_id")),
                "anonymous_id": blank_to_null(F.col("anonymous_id")),
                "reason": F.when(F.col("outcome") == "rejected", reason),
            }
        )
        .drop("record")
    )


# --- duplicates --------------------------------------------------------------

KEY = ["organization_id", "event_id"]


def first_deliveries(rows: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """One row per tenant and event id: the one that arrived first.

    Catalyst keeps only the first row of each id per task before the shuffle, so an
    id sent over and over does not gather in one task.
    """
    in_order = Window.partitionBy(*KEY).orderBy(*(arrival or POSITION))
    return rows.withColumn("_delivery", F.row_number().over(in_order)).where(
        F.col("_delivery") == 1
    ).drop("_delivery")


def unseen(
    rows: DataFrame,
    stored: DataFrame,
    keys: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Rows whose id is not in the event table yet, however long ago it was stored.

    First the ids that are stored already are picked out, reading two columns of the
    table where they lie; the table itself is never shuffled for a small batch.
    ``keys`` may be given where the ids of ``rows`` are at hand more cheaply, and
    ``small`` where their number has been compared with BROADCAST_ROWS already.
    """
    seen = known(stored, rows if keys is None else keys, KEY, small)
    return rows.join(seen, KEY, "left_anti")


def as_stored(rows: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Event columns as the table holds them: blank ids empty, actor derived."""
    return rows.withColumns(
        {
            "user_id": blank_to_null(F.col("user_id")),
            "anonymous_id": blank_to_null(F.col("anonymous_id")),
            "received_at": F.current_timestamp() if received_at is None else received_at,
        }
    ).withColumn("actor_id", F.coalesce("user_id", "anonymous_id"))


# --- accounts ----------------------------------------------------------------


def audit_counts(outcomes: DataFrame, persisted: Column) -> DataFrame:
    """``received, invalid, rejected, persisted, deduplicated`` of classified rows."""
    counted = outcomes.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("outcome") == "invalid").alias("invalid"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("outcome") == "valid").alias("valid"),
    )
    return counted.select(
        "received",
        "invalid",
        "rejected",
        persisted.alias("persisted"),
        (F.col("valid") - persisted).alias("deduplicated"),
    )


def reconcile(audit: DataFrame) -> DataFrame:
    """Totals over all batches, and whether every record is accounted for."""
    names = ["received", "invalid", "rejected", "persisted", "deduplicated"]
    totals = audit.agg(*(F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in names))
    outcomes = sum((F.col(name) for name in names[2:]), F.col(names[1]))
    return totals.withColumn("balanced", F.col("received") == outcomes)

"""The driver's tables seen as tenants and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import api_key_hash, api_key_prefix
from footfall.schema import EVENTS, ORGANIZATIONS

TENANTS = (1, 2, 3)

UUID_TEXT = (
    "regexp_replace(md5(cast({id} as string)), "
    "'^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"
)


def sample_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of `events`, spread over three tenants.

    Sign-ups, purchases and every fifth row name their user; one row in eleven has no
    anonymous id. So anonymous history, links and rows of nobody all occur.
    """
    raw = spark.read.parquet(f"{folder}/events.parquet")
    return _as_events(
        raw.selectExpr(
            UUID_TEXT.format(id="event_id") + " as event_id",
            "user_id % 3 + 1 as organization_id",
            "event_type",
            "cast(ts as timestamp) as occurred_at",
            """concat('{"country":"', case event_id % 4 when 0 then 'SE' when 1 then 'NO'
                 when 2 then 'DK' else 'US' end, '","k":', event_id % 100, ',"plan":"',
               case when event_id % 100 < 85 then 'free' when event_id % 100 < 95 then 'pro'
                 else 'enterprise' end, '"', case when event_id % 7 = 0 then ',"beta":true'
                 when event_id % 7 = 1 then ',"beta":"true"' else '' end, '}') as metadata""",
            """case when event_type in ('signup', 'purchase') or event_id % 5 = 0
                 then concat('u-', user_id) end as user_id""",
            """case when event_id % 11 <> 0
                 then concat('a-', user_id, '-', event_id % 2) end as anonymous_id""",
        )
    )


def sample_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of `orders`: the years that weekly and monthly buckets need."""
    raw = spark.read.parquet(f"{folder}/orders.parquet")
    return _as_events(
        raw.selectExpr(
            UUID_TEXT.format(id="o_orderkey") + " as event_id",
            "o_custkey % 3 + 1 as organization_id",
            "o_orderstatus as event_type",
            "cast(o_orderdate as timestamp) as occurred_at",
            """concat('{"priority":"', o_orderpriority, '"}') as metadata""",
            "concat('c-', o_custkey) as user_id",
            "cast(null as string) as anonymous_id",
        )
    )


def _as_events(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("received_at", F.expr("occurred_at + interval 1 second"))
        .withColumn("actor_id", F.coalesce("user_id", "anonymous_id"))
        .select(EVENTS.names)
    )


def api_key(organization_id: str) -> str:
    return f"concat('st_sample_key_', {organization_id})"


def sample_organizations(spark: SparkSession, folder: str) -> DataFrame:
    """One organization per nation, numbered from 1."""
    raw = spark.read.parquet(f"{folder}/nation.parquet")
    key = F.expr(api_key("n_nationkey + 1"))
    return raw.select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"),
        F.col("n_name").alias("name"),
        api_key_hash(key).alias("api_key_hash"),
        api_key_prefix(key).alias("api_key_prefix"),
        F.timestamp_micros(F.lit(0)).alias("created_at"),
    ).select(ORGANIZATIONS.names)


# --- raw records, with every kind of defect somewhere ------------------------

TOPIC_NAME = "sample"

# Case number `event_id % 53` decides what is wrong with a record.
REQUEST_VALUE = """
    case event_id % 53
      when 0 then '{"eventType":"cut off'
      when 13 then '[1]'
      when 14 then ''
      else concat('{"ignored":{"a":[1,2]}',
        case event_id % 53
          when 1 then ',"eventType":" \\\\t "'
          when 2 then ''
          when 11 then concat(',"eventType":"', repeat('x', 201), '"')
          when 15 then concat(',"eventType":"', repeat('y', 200), '"')
          else concat(',"eventType":"', event_type, '"') end,
        case event_id % 53
          when 3 then ',"eventId":"not-a-uuid"'
          when 7 then ''
          when 16 then ',"eventId":null'
          else concat(',"eventId":"', upper({uuid}), '"') end,
        case event_id % 53
          when 4 then ',"occurredAt":"yesterday"'
          when 8 then ''
          when 17 then ',"occurredAt":1704067200.25'
          when 18 then ',"occurredAt":"2024-01-15T12:30:00+02:00"'
          when 19 then ',"occurredAt":"2024-02-30T00:00:00Z"'
          else concat(',"occurredAt":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"') end,
        case event_id % 53
          when 6 then concat(',"userId":"', repeat('u', 201), '"')
          when 10 then ',"userId":"   "'
          when 20 then ',"userId":{"id":1}'
          when 21 then concat(',"userId":', user_id)
          else concat(',"userId":"u-', user_id, '"') end,
        case event_id % 53
          when 5 then ',"metadata":[1,2]'
          when 9 then ''
          when 12 then ',"metadata":{"plan":"free","k":1,"plan":"pro"}'
          when 22 then ',"metadata":"{}"'
          else concat(',"metadata":{"plan":"pro","k":', event_id % 100, '}') end,
        '}') end
"""


def sample_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per row of `events`, from tenants 1 to 30, of which 25 exist."""
    raw = spark.read.parquet(f"{folder}/events.parquet")
    key = api_key("user_id % 30 + 1")
    return raw.selectExpr(
        f"""case event_id % 59 when 0 then null when 1 then 'nobody'
              when 2 then concat(' ', {key}, '\\t') else {key} end as api_key""",
        REQUEST_VALUE.replace("{uuid}", UUID_TEXT.format(id="event_id")) + " as value",
        f"'{TOPIC_NAME}' as topic",
        "cast(event_id % 8 as int) as partition",
        "event_id as offset",
        "cast(ts as timestamp) + interval 5 seconds as timestamp",
    )


def sample_request_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The requests of four neighbouring rows as one list each; where a list would hold
    text that is not JSON it breaks off, and each thirteenth list is empty."""
    single = sample_requests(spark, folder)
    numbered = single.withColumn("list", F.expr("offset div 4"))
    body = F.expr("array_join(transform(array_sort(collect_list(struct(offset, value))), x -> x.value), ',')")
    return numbered.groupBy("list").agg(body.alias("body")).select(
        "list",
        F.when(F.col("list") % 13 == 0, '{"events":[]}')
        .otherwise(F.concat(F.lit('{"events":['), "body", F.lit("]}")))
        .alias("value"),
    )


def sample_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of `events` as a message, delivered one to three times.

    A repeated delivery differs in its event type, so that it shows which one was kept.
    Some messages cannot be read, lack something or name a tenant that does not exist.
    """
    raw = spark.read.parquet(f"{folder}/events.parquet")
    value = """
        case event_id % 53
          when 0 then '{"eventId":'
          when 1 then 'null'
          else concat('{"eventId":"', {uuid}, '"',
            case event_id % 53 when 2 then '' else concat(',"organizationId":', user_id % 30 + 1) end,
            case event_id % 53 when 3 then ',"eventType":null'
              else concat(',"eventType":"', event_type, if(delivery = 0, '', '-again'), '"') end,
            case event_id % 53 when 4 then ''
              else concat(',"occurredAt":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"') end,
            case event_id % 53 when 5 then ',"metadata":7' when 6 then '' when 9 then ',"metadata":null'
              else concat(',"metadata":{"k":', event_id % 100, ',"plan":"pro"}') end,
            case event_id % 53 when 7 then ',"userId":""' else concat(',"userId":"u-', user_id, '"') end,
            ',"anonymousId":"a-', user_id, '"}') end
    """.replace("{uuid}", UUID_TEXT.format(id="event_id"))
    deliveries = raw.withColumn("delivery", F.explode(F.expr("sequence(0, cast(event_id % 3 as int))")))
    return deliveries.selectExpr(
        "cast(user_id % 30 + 1 as string) as key",
        value + " as value",
        f"'{TOPIC_NAME}' as topic",
        "cast(user_id % 8 as int) as partition",
        "event_id * 4 + delivery as offset",
        "cast(ts as timestamp) + interval 5 seconds as timestamp",
    )


# Times that are unusual or wrong, as they stand in a record. The last ones are numbers beyond
# the storable range.
ODD_TIMES = (
    '"0000-01-01T00:00:00Z"',
    '"-0001-06-15T12:00:00Z"',
    '"+12000-01-01T00:00:00Z"',
    "1714521600",
    "1714521600000",
    "1714521600.25",
    '"9223372036854"',
    "9223372036855",
    "-9223372036855",
    "12345678901234567",
    "12345678901234567890123456789",
)


def odd_time_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of `events` as a record; eleven of twelve have an unusual time."""
    raw = spark.read.parquet(f"{folder}/events.parquet")
    odd = F.get(F.array(*map(F.lit, ODD_TIMES)), (F.col("event_id") % 12 - 1).cast("int"))
    usual = F.date_format("ts", "'\"'yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z\"'")
    value = F.concat(
        F.lit('{"eventId":"'), F.expr(UUID_TEXT.format(id="event_id")),
        F.lit('","organizationId":1,"eventType":"'), F.col("event_type"),
        F.lit('","occurredAt":'), F.coalesce(odd, usual), F.lit(',"metadata":{}}'),
    )
    return raw.select(
        F.lit("1").alias("key"), value.alias("value"), F.lit(TOPIC_NAME).alias("topic"),
        (F.col("event_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )

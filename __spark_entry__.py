"""

Queries about one tenant run for each tenant of the sample and carry its number in
``organization_id``, so that together they cover the whole of their table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import operators as op
from footfall.functions.metadata import canonical
from footfall.functions.text import api_key_hash, api_key_prefix
from footfall.operators import ingest, maintenance, partials
from footfall.schema import REQUEST
from footfall.session import configure
from footfall.sources import sample_tables as sample
from footfall.sources.load import load_events
from footfall.sources.messages import file_messages, write_files
from footfall.sources.store import Store
from footfall.streaming.ingest import accept, classify, consume

try:  # the operators of the training-data pipeline may be left out of an installation
    import corpus_pipeline
    from footfall.llm import queries as pipeline
except ImportError:
    corpus_pipeline = pipeline = None

MONTH = ("2024-01-01", "2024-02-01")
YEARS = ("1995-01-01", "2001-08-02")
# A range that begins and ends inside a day.
UNEVEN = ("2024-01-03T07:30:00", "2024-01-20T11:00:00")
STEPS = ["view", "signup", "purchase"]

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the three-step funnel over stitched people."""
    return queries()["funnel_3step"](spark, "/root/testdata/sf0.001")


def _per_tenant(ask: Callable[[DataFrame, int], DataFrame], table=sample.sample_events) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder)
        answers = [
            ask(events, tenant).withColumn("organization_id", F.lit(tenant).cast("long"))
            for tenant in sample.TENANTS
        ]
        return reduce(DataFrame.unionByName, answers)

    return run


def _on(ask: Callable[[DataFrame], DataFrame], table=sample.sample_events) -> Query:
    return lambda spark, folder: ask(table(spark, folder))


def _prepared(query: Query) -> Query:
    """Session settings first; instants come back without a zone, as UTC wall clock."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = query(configure(spark), folder)
        return result.select(
            *(
                F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
                for name, kind in result.dtypes
            )
        )

    return run


def _rounded(steps: DataFrame) -> DataFrame:
    return steps.select(
        *(F.round(name, 7).alias(name) if kind == "double" else F.col(name) for name, kind in steps.dtypes)
    )


def _funnel(steps: list[str], window: str | None, **narrowed) -> Query:
    return _per_tenant(lambda e, t: _rounded(op.funnel(e, t, steps, window, *MONTH, **narrowed)))


def _funnel_totals(events: DataFrame, tenant: int) -> DataFrame:
    steps = op.funnel(events, tenant, STEPS, "5h", *MONTH)
    return _rounded(op.funnel_totals(steps, STEPS, "5h"))


def _errors_as_text(rows: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(" "), e["message"])), "; ")
    return rows.withColumn("errors", text)


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    judged = accept(sample.sample_requests(spark, folder), sample.sample_organizations(spark, folder))
    stored = ingest.as_stored(judged.where(F.size("errors") == 0), F.col("timestamp"))
    return stored.select("partition", "offset", "event_id", "organization_id", "event_type", "occurred_at",
                         "metadata", "user_id", "anonymous_id", "actor_id", "received_at")


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    checked = ingest.validate(ingest.decode(sample.sample_requests(spark, folder), REQUEST))
    return _errors_as_text(checked).select("offset", "errors")


def _validated_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = ingest.validate(ingest.decode_batches(sample.sample_request_lists(spark, folder)))
    return _errors_as_text(lists).select("list", F.coalesce("position", F.lit(-1)).alias("position"), "errors")


def _attributed(spark: SparkSession, folder: str, broadcast_rows: int | None = None) -> DataFrame:
    requests = sample.sample_requests(spark, folder)
    organizations = sample.sample_organizations(spark, folder)
    found = ingest.attribute(requests, organizations, ["offset"], broadcast_rows)
    return found.select("offset", F.coalesce("organization_id", F.lit(0)).alias("organization_id"))


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return classify(sample.sample_messages(spark, folder), sample.sample_organizations(spark, folder))


def _odd_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = classify(sample.odd_time_requests(spark, folder), sample.sample_organizations(spark, folder))
    return rows.select("offset", "outcome", F.coalesce(F.unix_micros("occurred_at"), F.lit(0)).alias("micros"))


def _odd_requests(spark: SparkSession, folder: str) -> DataFrame:
    checked = ingest.validate(ingest.decode(sample.odd_time_requests(spark, folder), REQUEST))
    return _errors_as_text(checked).select("offset", "errors")


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the messages add to a table which holds every event but the clicks."""
    valid = _classified(spark, folder).where("outcome = 'valid'")
    stored = sample.sample_events(spark, folder).where("event_type <> 'click'")
    return ingest.unseen(ingest.first_deliveries(valid), stored)


def _reconciled(spark: SparkSession, folder: str) -> DataFrame:
    persisted = _fresh(spark, folder).agg(F.count(F.lit(1)).alias("persisted"))
    counts = ingest.audit_counts(_classified(spark, folder), F.lit(persisted.scalar()))
    return ingest.reconcile(counts)


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events sent as messages and read back."""
    sent = ingest.to_messages(sample.sample_events(spark, folder))
    read = ingest.from_messages(sent)
    return read.select("key", "event_id", "organization_id", "event_type", "occurred_at", "metadata",
                       "user_id", "anonymous_id", "outcome")


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.parquet(f"{folder}/events.parquet")
    twice = F.concat(F.lit('{"z":1,"a":"x","z":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return raw.select("event_id", canonical(F.try_parse_json(twice)).alias("metadata"))


def _without_tenant(spark: SparkSession, folder: str) -> DataFrame:
    organizations, events = maintenance.remove_tenant(
        sample.sample_organizations(spark, folder), sample.sample_events(spark, folder), 2
    )
    left = events.groupBy(F.col("organization_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    return organizations.join(left, "id", "left").select("id", "name", F.coalesce("events", F.lit(0).cast("long")).alias("events"))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.parquet(f"{folder}/customer.parquet")
    key = F.concat(F.lit(" st_"), "c_name", F.lit("\t"))
    return raw.select("c_custkey", api_key_hash(key).alias("api_key_hash"),
                      api_key_prefix(F.concat(F.lit("st_"), "c_name")).alias("api_key_prefix"))


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Events that all claim to have happened, and to have come, at the turn of the month."""
    month = F.date_trunc("month", "occurred_at")
    return sample.sample_events(spark, folder).withColumns({"occurred_at": month, "received_at": month})


def _second_page(events: DataFrame, tenant: int) -> DataFrame:
    """The page that follows the position at which the first page ends."""
    first = op.events_page_after(events, tenant, *MONTH, limit=40)
    token = first.agg(F.max("next_after")).first()[0]
    return op.events_page_after(events, tenant, *MONTH, limit=40, after=token).drop("next_after")


def _in_batches(events: DataFrame) -> DataFrame:
    """The same events as three batches store them; rows of a day are in each."""
    return events.withColumn("ingest_batch", F.concat(F.lit("b"), F.pmod(F.hash("event_id"), F.lit(3))))


def _daily(events: DataFrame) -> DataFrame:
    """What the batches add up to by day; one of them has run twice."""
    daily = partials.daily_counts(_in_batches(events))
    return daily.unionByName(daily.where("ingest_batch = 'b1'"))


def _links_of_days(events: DataFrame, tenant: int) -> DataFrame:
    links = reduce(DataFrame.unionByName, (
        partials.daily_links(_in_batches(events).where(F.col("ingest_batch") == f"b{n}")) for n in (0, 1, 1, 2)))
    return partials.identities_of_days(links, events, tenant, *UNEVEN)


def _streamed(spark: SparkSession, folder: str) -> Store:
    """The messages of the sample as files, and the store that the streams make of them."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="footfall-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    write_files(sample.sample_messages(spark, folder), f"{root}/messages")
    store, organizations = Store(f"{root}/store"), sample.sample_organizations(spark, folder)
    consume(file_messages(spark, f"{root}/messages"), lambda: organizations, store, checkpoints=f"{root}/offsets",
            availableNow=True).awaitTermination()
    return store


def _stored_by_streams(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).read(spark).select(
        "organization_id", "event_id", "event_type", "occurred_at", "user_id", "anonymous_id", "metadata")


def _accounts_of_streams(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.reconcile(_streamed(spark, folder).read_audit(spark))


# Steps, window and filters; each is asked in both ways that a funnel may be worked out.
FUNNELS = {
    "funnel_3step": ((STEPS, "7d"), {}),
    "funnel_short_window": ((STEPS, "90m"), {}),
    "funnel_4step_filtered": ((["click", *STEPS], "365d"), {"filters": ["plan:free"]}),
    "funnel_repeat_step": ((["view", "view", "purchase"], "3d"), {}),
    "funnel_8step": ((["view", "click", "error", "view", "signup", "click", "purchase", "error"], "24h"), {}),
    "funnel_no_entrants": ((["never", "view"], None), {}),
}


def _queries() -> dict[str, Query]:
    orders = sample.sample_orders
    return {
        # Time series
        "timeseries_hour": _per_tenant(lambda e, t: op.time_series(e, t, *MONTH, interval="hour")),
        "timeseries_day": _per_tenant(lambda e, t: op.time_series(e, t, *MONTH)),
        "timeseries_week": _per_tenant(lambda e, t: op.time_series(e, t, *YEARS, interval="week"), orders),
        "timeseries_month": _per_tenant(lambda e, t: op.time_series(e, t, *YEARS, interval="month"), orders),
        "timeseries_filtered": _per_tenant(lambda e, t: op.time_series(
            e, t, *MONTH, interval="hour", event_type="purchase", filters=["plan:pro", "country:SE"])),
        "timeseries_total": _per_tenant(lambda e, t: op.total(
            op.time_series(e, t, *MONTH, interval="hour", event_type="view"))),
        # Breakdown
        "breakdown_event_type": _per_tenant(lambda e, t: op.breakdown(e, t, *MONTH)),
        "breakdown_metadata": _per_tenant(lambda e, t: op.breakdown(e, t, *MONTH, group_by="metadata.plan")),
        "breakdown_missing_key": _per_tenant(lambda e, t: op.breakdown(e, t, *MONTH, group_by="metadata.beta")),
        "breakdown_limit": _per_tenant(lambda e, t: op.breakdown(
            e, t, *MONTH, group_by="metadata.k", event_type="click", filters=["plan:free"], limit=7)),
        "breakdown_orders": _per_tenant(lambda e, t: op.breakdown(e, t, *YEARS, group_by="metadata.priority"), orders),
        "breakdown_total": _per_tenant(lambda e, t: op.total(op.breakdown(e, t, *MONTH, group_by="metadata.k", limit=7))),
        # Summary and identity
        "summary": _per_tenant(lambda e, t: op.summary(e, t, *MONTH)),
        "summary_event_type": _per_tenant(lambda e, t: op.summary(e, t, *MONTH, event_type="view")),
        "summary_filter_5pct": _per_tenant(lambda e, t: op.summary(e, t, *MONTH, filters=["plan:enterprise"])),
        "summary_filter_85pct": _per_tenant(lambda e, t: op.summary(e, t, *MONTH, filters=["plan:free"])),
        "summary_no_match": _per_tenant(lambda e, t: op.summary(e, t, *MONTH, filters=["plan:none"])),
        "summary_orders": _per_tenant(lambda e, t: op.summary(e, t, *YEARS), orders),
        "filter_type_strict": _per_tenant(lambda e, t: op.summary(e, t, *MONTH, filters=["beta:true"])),
        "identity_map": _per_tenant(lambda e, t: op.identities(e, t, *MONTH)),
        # Funnel
        **{name: _funnel(*asked, **more) for name, (asked, more) in FUNNELS.items()},
        "funnel_totals": _per_tenant(_funnel_totals),
        **{f"{name}_spread": _funnel(*asked, small_rows=0, **more) for name, (asked, more) in FUNNELS.items()},
        "funnel_3step_salted": _funnel(STEPS, "7d", small_rows=0, heavy_rows=20),
        # What answers are about
        "series_header": _per_tenant(lambda e, t: op.series_header(
            op.time_series(e, t, *MONTH, interval="Week"), *MONTH, interval="Week")),
        "breakdown_header": _per_tenant(lambda e, t: op.breakdown_header(
            op.breakdown(e, t, *MONTH, group_by="metadata.plan"), *MONTH, group_by="metadata.plan")),
        "funnel_header": _per_tenant(lambda e, t: op.funnel_header(_funnel_totals(e, t), *MONTH)),
        # Raw events and catalogue
        "events_page": _per_tenant(lambda e, t: op.events_page(e, t, *MONTH)),
        "events_page_offset": _per_tenant(lambda e, t: op.events_page(
            e, t, *MONTH, filters=["country:US"], limit=50, offset=60, shallow=20)),
        "events_page_ties": _per_tenant(lambda e, t: op.events_page(e, t, *MONTH, limit=50, offset=250, shallow=20), _monthly),
        "event_types": _per_tenant(op.event_types),
        "events_page_after": _per_tenant(_second_page),
        # The same from days, as batches added them up
        "event_types_days": _per_tenant(lambda e, t: partials.event_types_of_days(_daily(e), t)),
        "tenant_audit_days": _on(lambda e: partials.audit_of_days(_daily(e))),
        "identity_map_days": _per_tenant(_links_of_days),
        "timeseries_days": _per_tenant(lambda e, t: partials.time_series_of_days(_daily(e), e, t, *UNEVEN, event_type="view")),
        "timeseries_weeks_of_days": _per_tenant(lambda e, t: partials.time_series_of_days(_daily(e), e, t, *UNEVEN, interval="week")),
        # Ingest
        "validate_requests": _validated,
        "validate_request_lists": _validated_lists,
        "validate_odd_times": _odd_requests,
        "attribute_tenant": _attributed,
        "attribute_tenant_spread": lambda s, d: _attributed(s, d, broadcast_rows=0),
        "accept_requests": _accepted,
        "message_roundtrip": _messages,
        "classify_messages": lambda s, d: _classified(s, d).select("partition", "offset", "outcome", "reason"),
        "classify_odd_times": _odd_times,
        "dead_letters": lambda s, d: _classified(s, d).where("outcome = 'rejected'").select(
            "topic", "partition", "offset", "key", "reason"),
        "dedup_events": lambda s, d: ingest.first_deliveries(_classified(s, d).where("outcome = 'valid'")).select(
            "organization_id", "event_id", "event_type", "occurred_at", "user_id", "anonymous_id", "metadata", "offset"),
        "unseen_events": lambda s, d: _fresh(s, d).select("organization_id", "event_id", "event_type", "offset"),
        "ingest_reconciliation": _reconciled,
        "stream_storage": _stored_by_streams,
        "stream_accounts": _accounts_of_streams,
        "canonical_metadata": _canonical,
        "api_key_hashes": _keys,
        "load_events": _on(lambda t: load_events(t, "l_orderkey").groupBy("event_type", "metadata").agg(
            F.count(F.lit(1)).alias("events"), F.sum("index").alias("indexes")),
            lambda s, d: s.read.parquet(f"{d}/lineitem.parquet")),
        # Maintenance
        "tenant_audit": _on(maintenance.audit),
        "purge_event_types": _on(lambda e: maintenance.purge_event_types(e, ["click", "view"])),
        "remove_tenant": _without_tenant,
        "erase_person": _on(lambda e: maintenance.erase_person(e, 1, "u-3")),
        "erase_person_resolved": _on(lambda e: maintenance.erase_person_resolved(e, 1, "u-3")),
    }


def queries() -> dict[str, Query]:
    named = _queries()
    if pipeline:
        named |= pipeline.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: _prepared(query) for name, query in named.items()}


# --- the same in SQL ----------------------------------------------------------

EVENTS = r"""
ev as (
  select regexp_replace(md5(cast(t.event_id as varchar)),
           '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') as event_id,
    t.user_id % 3 + 1 as organization_id, t.event_type, t.ts as occurred_at,
    t.ts + interval 1 second as received_at,
    concat('{"country":"', case t.event_id % 4 when 0 then 'SE' when 1 then 'NO' when 2 then 'DK' else 'US' end,
      '","k":', t.event_id % 100, ',"plan":"', case when t.event_id % 100 < 85 then 'free'
        when t.event_id % 100 < 95 then 'pro' else 'enterprise' end, '"',
      case when t.event_id % 7 = 0 then ',"beta":true' when t.event_id % 7 = 1 then ',"beta":"true"' else '' end,
      '}') as metadata,
    case when t.event_type in ('signup', 'purchase') or t.event_id % 5 = 0
      then concat('u-', t.user_id) end as user_id,
    case when t.event_id % 11 <> 0 then concat('a-', t.user_id, '-', t.event_id % 2) end as anonymous_id
  from events t
)"""

ORDERS = """
ev as (
  select o_custkey % 3 + 1 as organization_id, o_orderstatus as event_type, o_orderdate as occurred_at,
    concat('{"priority":"', o_orderpriority, '"}') as metadata,
    concat('c-', o_custkey) as user_id, cast(null as varchar) as anonymous_id
  from orders
)"""

TENANTS = "tenants as (select unnest([1, 2, 3]) as organization_id)"

IDENTITY = """
identity as (
  select organization_id, anonymous_id,
    arg_min(user_id, struct_pack(since := occurred_at, who := user_id)) as user_id
  from ev where anonymous_id is not null and user_id is not null group by organization_id, anonymous_id
)"""

# Every event that names somebody, with the person it belongs to.
PEOPLE = """
people as (
  select ev.*, case when user_id is not null then user_id else coalesce(
    (select i.user_id from identity i
      where i.organization_id = ev.organization_id and i.anonymous_id = ev.anonymous_id), anonymous_id) end as person
  from ev where user_id is not null or anonymous_id is not null
)"""


def _holds(**wanted: str) -> str:
    return " and ".join(
        f"json_type(metadata, '$.{key}') = 'VARCHAR' and metadata->>'$.{key}' = '{value}'"
        for key, value in wanted.items()
    )


def _series_sql(unit: str, start: str, end: str, table: str = EVENTS, where: str = "true") -> str:
    """A calendar; every entry asks how many events lie between it and the next."""
    return f"""with {table}, {TENANTS}, chosen as (select * from ev where {where}),
      calendar as (select opens, opens + interval 1 {unit} as closes from (
        select unnest(generate_series(date_trunc('{unit}', timestamp '{start}'), timestamp '{end}', interval 1 {unit})) as opens)
        where opens < timestamp '{end}')
      select t.organization_id::bigint as organization_id, c.opens::timestamp as bucket,
        (select count(*) from chosen x where x.organization_id = t.organization_id
          and x.occurred_at >= c.opens and x.occurred_at < c.closes) as count
      from tenants t, calendar c"""


def _breakdown_sql(value: str, table: str = EVENTS, where: str = "true", limit: int = 50) -> str:
    return f"""with {table}, counts as (
        select organization_id, {value} as value, count(*) as count from ev where {where} group by all),
      ranked as (select *, row_number() over (partition by organization_id
        order by count desc, value asc nulls last) as place from counts)
      select organization_id, value, count from ranked where place <= {limit}"""


def _summary_sql(where: str = "true", table: str = EVENTS) -> str:
    """Every number by a question of its own; people are listed first and then counted."""
    return f"""with {table}, {TENANTS}, {IDENTITY}, {PEOPLE},
      chosen as (select * from ev e where {where}),
      persons as (select distinct organization_id, person from people e where {where})
      select organization_id::bigint as organization_id,
        (select count(*) from chosen c where c.organization_id = t.organization_id) as total_events,
        (select count(*) from persons p where p.organization_id = t.organization_id) as unique_actors,
        (select count(distinct event_type) from chosen c where c.organization_id = t.organization_id) as distinct_event_types,
        (select min(occurred_at) from chosen c where c.organization_id = t.organization_id) as first_event_at,
        (select max(occurred_at) from chosen c where c.organization_id = t.organization_id) as last_event_at
      from tenants t"""


def _funnel_ctes(steps: list[str], seconds: int, where: str = "true") -> str:
    """Each person goes through their own events in order, one at a time, and notes the
    time of an event that is the step they wait for and comes in time."""
    return f"""with recursive {EVENTS.strip()}, {TENANTS}, {IDENTITY}, {PEOPLE},
      diaries as (
        select organization_id, person, list(struct_pack(at := occurred_at, kind := event_type) order by occurred_at) as diary
        from people where {where} group by organization_id, person),
      walk as (
        select organization_id, person, diary, 1 as page, []::timestamp[] as reached from diaries
        union all
        select organization_id, person, diary, page + 1,
          case when diary[page].kind = ({steps!r})[len(reached) + 1]
              and (len(reached) = 0 or diary[page].at > reached[-1] and diary[page].at <= reached[1] + interval {seconds} second)
            then list_append(reached, diary[page].at) else reached end
        from walk where page <= len(diary)),
      walked as (select organization_id, reached from walk where page > len(diary)),
      steps as (
        select t.organization_id, s.step, ({steps!r})[s.step] as event_type,
          (select count(*) from walked w where w.organization_id = t.organization_id and len(w.reached) >= s.step) as actors,
          (select median(epoch_us(w.reached[s.step]) - epoch_us(w.reached[s.step - 1])) / 1e6 from walked w
            where w.organization_id = t.organization_id and len(w.reached) >= s.step and s.step > 1) as median
        from tenants t, (select unnest(range(1, {len(steps) + 1}))::integer as step) s)"""


def _funnel_sql(steps: list[str], seconds: int, where: str = "true") -> str:
    share = "round(case when {0} > 0 then a.actors / {0} else 0 end, 7)::double"
    return _funnel_ctes(steps, seconds, where) + f"""
      select a.organization_id::bigint as organization_id, a.step, a.event_type, a.actors,
        case when a.step = 1 then 1.0::double else {share.format("b.actors")} end as conversion_from_previous,
        {share.format("f.actors")} as conversion_from_first,
        round(a.median, 7) as median_seconds_from_previous
      from steps a join steps f on f.organization_id = a.organization_id and f.step = 1
        left join steps b on b.organization_id = a.organization_id and b.step = a.step - 1"""


def _page_sql(limit: int, offset: int, where: str = "true", table: str = EVENTS) -> str:
    return f"""with {table}, placed as (select *,
        row_number() over (partition by organization_id order by occurred_at desc, received_at desc, event_id desc) as place,
        count(*) over (partition by organization_id) as available from ev where {where})
      select organization_id, event_id, event_type, occurred_at, received_at, metadata,
        case when available > {offset + limit} then {offset + limit}::bigint end as next_offset
      from placed where place > {offset} and place <= {offset + limit}"""


def _uuid_of(text: str) -> str:
    return (f"regexp_replace({text}, "
            r"'^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '\1-\2-\3-\4-\5')")


# What is wrong with the record of row n, by the rule the sample follows.
REQUEST_ERRORS = """
  case n % 53 when 0 then 'body cannot be read' when 13 then 'body cannot be read' when 14 then 'body cannot be read'
    when 1 then 'eventType is required' when 2 then 'eventType is required'
    when 11 then 'eventType must be at most 200 characters' when 3 then 'eventId must be a UUID'
    when 4 then 'occurredAt must be an ISO-8601 instant' when 19 then 'occurredAt must be an ISO-8601 instant'
    when 5 then 'metadata must be an object' when 22 then 'metadata must be an object'
    when 6 then 'userId must be a text of at most 200 characters'
    when 20 then 'userId must be a text of at most 200 characters' else '' end"""

REQUEST_TENANT = """
  case when n % 59 in (0, 1) or user_id % 30 + 1 > (select count(*) from nation) then null
    else user_id % 30 + 1 end"""

MESSAGES = f"""
msg as (
  select event_id as n, delivery, user_id as u, event_type as kind, ts, event_id * 4 + delivery as "offset",
    (user_id % 8)::integer as partition, user_id % 30 + 1 as tenant, event_id % 53 as flaw,
    {_uuid_of("md5(cast(event_id as varchar))")} as uuid
  from (select *, unnest(range(event_id % 3 + 1)) as delivery from events)
), judged as (
  select *, case when flaw in (0, 1, 5) then 'invalid' when flaw in (2, 3, 4) then 'rejected'
      when tenant > (select count(*) from nation) then 'rejected' else 'valid' end as outcome,
    case when flaw in (0, 1, 5) then null when flaw = 2 then 'no organization_id' when flaw = 3 then 'no event_type'
      when flaw = 4 then 'no occurred_at'
      when tenant > (select count(*) from nation) then 'unknown organization' end as reason
  from msg
), firsts as (
  select * from judged where outcome = 'valid'
  qualify row_number() over (partition by tenant, uuid order by partition, "offset") = 1
), fresh as (
  select * from firsts f where not exists (
    select 1 from events e where e.event_id = f.n and e.user_id % 3 + 1 = f.tenant and e.event_type <> 'click')
)"""


SPAN = "timestamp '2024-01-01' as range_start, timestamp '2024-02-01' as range_end"

# The microseconds that the time of a record stands for, by the list that the sample follows.
ODD_MICROS = """
  case event_id % 12 when 0 then epoch_us(ts) when 1 then -62167219200000000 when 2 then -62184456000000000
    when 3 then 316516204800000000 when 4 then 1714521600000000 when 5 then 1714521600000000000
    when 6 then 1714521600250000 when 7 then 9223372036854000000 end"""


def _cut_series_sql(unit: str, where: str) -> str:
    """Counts of a range that cuts days; buckets without events come from a calendar."""
    return f"""with {EVENTS}, {TENANTS}, buckets as (
        select distinct date_trunc('{unit}', day) as bucket
        from (select unnest(generate_series(timestamp '2024-01-03', timestamp '2024-01-20', interval 1 day)) as day)),
      hits as (select organization_id, date_trunc('{unit}', occurred_at) as bucket, count(*) as n from ev
        where occurred_at >= timestamp '2024-01-03 07:30:00' and occurred_at < timestamp '2024-01-20 11:00:00' and {where}
        group by all)
      select t.organization_id, b.bucket::timestamp as bucket, coalesce(h.n, 0) as count
      from tenants t, buckets b left join hits h on h.organization_id = t.organization_id and h.bucket = b.bucket"""


def oracle_sql() -> dict[str, str]:
    named = _oracle_sql()
    if pipeline:
        named |= pipeline.SQL
        if corpus_pipeline.ORACLE_SQL:
            named["pipeline"] = corpus_pipeline.ORACLE_SQL
    return named


def _oracle_sql() -> dict[str, str]:
    plan_free = _holds(plan="free")
    eight = ["view", "click", "error", "view", "signup", "click", "purchase", "error"]
    funnels = {
        "funnel_3step": _funnel_sql(STEPS, 7 * 86400),
        "funnel_short_window": _funnel_sql(STEPS, 90 * 60),
        "funnel_4step_filtered": _funnel_sql(["click", *STEPS], 365 * 86400, plan_free),
        "funnel_repeat_step": _funnel_sql(["view", "view", "purchase"], 3 * 86400),
        "funnel_8step": _funnel_sql(eight, 86400),
        "funnel_no_entrants": _funnel_sql(["never", "view"], 7 * 86400),
    }
    attributed = f"""select n as "offset", coalesce({REQUEST_TENANT}, 0) as organization_id
        from (select event_id as n, user_id from events)"""
    funnel_totals = _funnel_ctes(STEPS, 5 * 3600) + """
      select organization_id::bigint as organization_id, '300m' as conversion_window,
        max(actors) filter (step = 1) as entered, max(actors) filter (step = 3) as completed,
        round(coalesce(max(actors) filter (step = 3) / nullif(max(actors) filter (step = 1), 0), 0), 7)::double
          as overall_conversion
      from steps group by organization_id"""
    return {
        "timeseries_hour": _series_sql("hour", *MONTH),
        "timeseries_day": _series_sql("day", *MONTH),
        "timeseries_week": _series_sql("week", *YEARS, ORDERS),
        "timeseries_month": _series_sql("month", *YEARS, ORDERS),
        "timeseries_filtered": _series_sql(
            "hour", *MONTH, where=f"event_type = 'purchase' and {_holds(plan='pro', country='SE')}"),
        "timeseries_total": f"with {EVENTS} select organization_id, count(*) as total from ev where event_type = 'view' group by all",
        "breakdown_event_type": _breakdown_sql("event_type"),
        "breakdown_metadata": _breakdown_sql("metadata->>'$.plan'"),
        "breakdown_missing_key": _breakdown_sql("metadata->>'$.beta'"),
        "breakdown_limit": _breakdown_sql("metadata->>'$.k'", where=f"event_type = 'click' and {plan_free}", limit=7),
        "breakdown_orders": _breakdown_sql("metadata->>'$.priority'", ORDERS),
        "breakdown_total": "select organization_id, sum(count)::bigint as total from ("
            + _breakdown_sql("metadata->>'$.k'", limit=7) + ") group by all",
        "summary": _summary_sql(),
        "summary_event_type": _summary_sql("e.event_type = 'view'"),
        "summary_filter_5pct": _summary_sql(_holds(plan="enterprise")),
        "summary_filter_85pct": _summary_sql(plan_free),
        "summary_no_match": _summary_sql(_holds(plan="none")),
        "summary_orders": _summary_sql(table=ORDERS),
        "filter_type_strict": _summary_sql(_holds(beta="true")),
        "identity_map": f"with {EVENTS}, {IDENTITY} select organization_id, anonymous_id, user_id from identity",
        **funnels,
        **{f"{name}_spread": text for name, text in funnels.items()},
        "funnel_3step_salted": funnels["funnel_3step"],
        "series_header": f"""with {EVENTS} select organization_id, {SPAN}, 'week' as interval, count(*) as total
            from ev group by organization_id""",
        "breakdown_header": f"""with {EVENTS} select organization_id, {SPAN}, 'metadata.plan' as group_by, count(*) as total
            from ev group by organization_id""",
        "funnel_header": f"select {SPAN}, * from ({funnel_totals})",
        "funnel_totals": funnel_totals,
        "events_page": _page_sql(100, 0),
        "events_page_ties": _page_sql(50, 250, table=EVENTS.replace("t.ts as occurred_at", "date_trunc('month', t.ts) as occurred_at")
            .replace("t.ts + interval 1 second", "date_trunc('month', t.ts)::timestamp")),
        "events_page_after": f"select * exclude next_offset from ({_page_sql(40, 40)})",
        "events_page_offset": _page_sql(50, 60, _holds(country="US")),
        "event_types": f"""with {EVENTS} select organization_id, event_type, count(*) as count,
            max(occurred_at) as last_seen_at from ev group by organization_id, event_type""",
        "event_types_days": f"""with {EVENTS} select organization_id, event_type, count(*) as count,
            max(occurred_at) as last_seen_at from ev group by organization_id, event_type""",
        "tenant_audit_days": f"with {EVENTS} select organization_id, event_type, count(*) as count from ev group by all",
        "identity_map_days": f"""with {EVENTS} select organization_id, anonymous_id,
            arg_min(user_id, struct_pack(since := occurred_at, who := user_id)) as user_id
            from ev where anonymous_id is not null and user_id is not null
              and occurred_at >= timestamp '2024-01-03 07:30:00' and occurred_at < timestamp '2024-01-20 11:00:00'
            group by organization_id, anonymous_id""",
        "timeseries_days": _cut_series_sql("day", "event_type = 'view'"),
        "timeseries_weeks_of_days": _cut_series_sql("week", "true"),
        "validate_requests": f'select n as "offset", {REQUEST_ERRORS} as errors from (select event_id as n from events)',
        "validate_request_lists": f"""with single as (
              select n, n // 4 as list, n % 4 as position, n % 53 in (0, 13, 14) as broken, {REQUEST_ERRORS} as own
              from (select event_id as n from events)),
            lists as (select list, bool_or(broken) as broken, bool_or(own <> '') as refused from single group by list)
            select list, -1 as position,
              case when list % 13 = 0 then 'events must not be empty' else 'body cannot be read' end as errors
            from lists where list % 13 = 0 or broken
            union all
            select list, position::integer, concat_ws('; ',
              case when refused then 'events hold an event that is not acceptable' end, nullif(own, '')) as errors
            from single join lists l using (list) where list % 13 <> 0 and not l.broken""",
        "validate_odd_times": f"""select event_id as "offset",
            case when {ODD_MICROS} is null then 'occurredAt must be an ISO-8601 instant' else '' end as errors from events""",
        "classify_odd_times": f"""select event_id as "offset",
            case when {ODD_MICROS} is null then 'invalid' else 'valid' end as outcome, coalesce({ODD_MICROS}, 0) as micros from events""",
        "attribute_tenant": attributed,
        "attribute_tenant_spread": attributed,
        "accept_requests": f"""with r as (
              select event_id as n, user_id, event_type, ts, event_id % 53 as flaw,
                {REQUEST_TENANT.replace("n %", "event_id %")} as tenant,
                {REQUEST_ERRORS.replace("n %", "event_id %")} as errors from events)
            select (n % 8)::integer as partition, n as "offset",
              case when flaw in (7, 16) then {_uuid_of("sha256(concat('sample|', n % 8, '|', n))")}
                else {_uuid_of("md5(cast(n as varchar))")} end as event_id,
              tenant as organization_id, case when flaw = 15 then repeat('y', 200) else event_type end as event_type,
              case flaw when 8 then ts + interval 5 second when 17 then timestamp '2024-01-01 00:00:00.25'
                when 18 then timestamp '2024-01-15 10:30:00' else ts end as occurred_at,
              case flaw when 9 then '{{}}' when 12 then '{{"k":1,"plan":"pro"}}'
                else concat('{{"k":', n % 100, ',"plan":"pro"}}') end as metadata,
              case flaw when 10 then null when 21 then user_id::varchar else concat('u-', user_id) end as user_id,
              null::varchar as anonymous_id,
              case flaw when 10 then null when 21 then user_id::varchar else concat('u-', user_id) end as actor_id,
              ts + interval 5 second as received_at
            from r where tenant is not null and errors = ''""",
        "message_roundtrip": f"""with {EVENTS} select organization_id::varchar as key, event_id, organization_id, event_type,
            occurred_at, case when metadata like '%"beta"%' then concat('{{"beta":', metadata->'$.beta', ',',
              regexp_replace(metadata[2:], ',"beta":.*$', '}}')) else metadata end as metadata,
            user_id, anonymous_id, 'valid' as outcome from ev""",
        "classify_messages": f'with {MESSAGES} select partition, "offset", outcome, reason from judged',
        "dead_letters": f"""with {MESSAGES} select 'sample' as topic, partition, "offset", tenant::varchar as key, reason
            from judged where outcome = 'rejected'""",
        "dedup_events": f"""with {MESSAGES} select tenant as organization_id, uuid as event_id, kind as event_type,
            ts as occurred_at, case when flaw = 7 then null else concat('u-', u) end as user_id,
            concat('a-', u) as anonymous_id, case when flaw in (6, 9) then '{{}}'
              else concat('{{"k":', n % 100, ',"plan":"pro"}}') end as metadata, "offset" from firsts""",
        "unseen_events": f"""with {MESSAGES} select tenant as organization_id, uuid as event_id, kind as event_type,
            "offset" from fresh""",
        "stream_storage": f"""with {MESSAGES} select tenant as organization_id, uuid as event_id, kind as event_type,
            ts as occurred_at, case when flaw = 7 then null else concat('u-', u) end as user_id,
            concat('a-', u) as anonymous_id, case when flaw in (6, 9) then '{{}}'
              else concat('{{"k":', n % 100, ',"plan":"pro"}}') end as metadata from firsts""",
        "stream_accounts": f"""with {MESSAGES} select count(*) as received,
              count(*) filter (outcome = 'invalid') as invalid, count(*) filter (outcome = 'rejected') as rejected,
              (select count(*) from firsts) as persisted,
              count(*) filter (outcome = 'valid') - (select count(*) from firsts) as deduplicated, true as balanced from judged""",
        "ingest_reconciliation": f"""with {MESSAGES}, c as (select count(*) as received,
              count(*) filter (outcome = 'invalid') as invalid, count(*) filter (outcome = 'rejected') as rejected,
              (select count(*) from fresh) as persisted, count(*) filter (outcome = 'valid') as valid from judged)
            select received, invalid, rejected, persisted, valid - persisted as deduplicated, true as balanced from c""",
        "canonical_metadata": """select event_id, concat('{"a":"x","z":', props->>'$.k', '}') as metadata from events""",
        "api_key_hashes": """select c_custkey, sha256(concat('st_', c_name)) as api_key_hash,
            left(concat('st_', c_name), 11) as api_key_prefix from customer""",
        "load_events": """select 'load_test' as event_type, concat('{"build":"v', l_orderkey % 40, '","country":"',
              ['SE', 'NO', 'DK', 'FI', 'DE', 'NL', 'GB', 'US'][l_orderkey % 8 + 1], '","plan":"',
              case when l_orderkey % 100 < 85 then 'free' when l_orderkey % 100 < 95 then 'pro' else 'enterprise' end,
              '"}') as metadata, count(*) as events, sum(l_orderkey)::bigint as indexes from lineitem group by all""",
        "tenant_audit": f"with {EVENTS} select organization_id, event_type, count(*) as count from ev group by all",
        "purge_event_types": f"""with {EVENTS} select *, coalesce(user_id, anonymous_id) as actor_id from ev
            where event_type not in ('click', 'view')""",
        "remove_tenant": f"""with {EVENTS} select n_nationkey::bigint + 1 as id, n_name as name,
            (select count(*) from ev where organization_id = n_nationkey + 1) as events
            from nation where n_nationkey + 1 <> 2""",
        "erase_person": f"""with {EVENTS} select *, coalesce(user_id, anonymous_id) as actor_id from ev
            where not (organization_id = 1 and coalesce(user_id, '') = 'u-3')""",
        "erase_person_resolved": f"""with {EVENTS}, {IDENTITY} select ev.*, coalesce(ev.user_id, ev.anonymous_id) as actor_id
            from ev left join identity i on i.organization_id = ev.organization_id and i.anonymous_id = ev.anonymous_id
            where not (ev.organization_id = 1 and coalesce(ev.user_id, i.user_id, '') = 'u-3')""",
    }
